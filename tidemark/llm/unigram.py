"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

Spaces become the marker U+2581, and one is put before a text. The trie is walked from all byte positions of a
block at once; the best path is found for all units (a run of spaces and what follows it) side by side. A
character that no piece covers falls back to the pieces of its bytes. A marker that stands in the text itself
is always written in bytes, so that decoding gives back every text exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: The default model file; any SentencePiece model with byte fallback can be named instead.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
#: Fixed value: an unknown character scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
_LITERAL = b"\xff"  # stands for a marker in the text; no UTF-8 text holds this byte
MAX_PIECES = 2_000_000


class Vocabulary(NamedTuple):
    """Arrays only, so that any worker can load a broadcast one. ``spell``/``spell_at``: what each id decodes to."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    byte_id: np.ndarray
    spell: np.ndarray
    spell_at: np.ndarray
    longest: int
    cuttable: bool


def double_array(keys: Sequence[bytes], values: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a double-array trie: a step from s over byte c goes to t = base[s] + c if
    check[t] is s; value[t] is the key's value or -1. The root is 0."""
    kids: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for key, v in zip(keys, values):
        at = 0
        for c in key:
            nxt = kids[at].get(c)
            if nxt is None:
                nxt = kids[at][c] = len(kids)
                kids.append({})
                ends.append(-1)
            at = nxt
        ends[at] = v
    size = 4 * len(kids) + 4096
    base, taken = np.zeros(len(kids), np.int32), np.zeros(size, bool)
    taken[0] = True
    low = 1
    # nodes of many children first, each at the first base that leaves all of them room; only children last fill the gaps
    for node in sorted((x for x in range(len(kids)) if len(kids[x]) > 1), key=lambda x: -len(kids[x])):
        labels = np.array(sorted(kids[node]), np.int64)
        while taken[low]:
            low += 1
        b = max(1, low - int(labels[0]))
        while True:
            free = ~taken[b + labels[0] : b + labels[0] + 2048]
            for c in labels[1:]:
                free = free & ~taken[b + c : b + c + 2048]
            if free.any():
                b += int(free.argmax())
                break
            b += 2048
        base[node] = b
        taken[b + labels] = True
    gaps = np.flatnonzero(~taken[256:]) + 256
    for node, gap in zip((x for x in range(len(kids)) if len(kids[x]) == 1), gaps.tolist()):
        base[node] = gap - next(iter(kids[node]))
    place = np.zeros(len(kids), np.int64)
    for node, below in enumerate(kids):
        for c, child in below.items():
            place[child] = base[node] + c
    last = int(place.max()) + 257
    out, check, value = np.zeros(last, np.int32), np.full(last, -1, np.int32), np.full(last, -1, np.int32)
    out[place], value[place] = base, ends
    for node, below in enumerate(kids):
        check[[place[child] for child in below.values()]] = place[node]
    return out, check, value


def vocabulary(pieces: Sequence[tuple[bytes, float]], byte_ids: Sequence[int], spellings: Sequence[bytes]) -> Vocabulary:
    """From (piece, log score) by id (an empty piece is never matched), the ids of the 256 byte pieces and the
    bytes that each id decodes to. A piece with a marker after another character makes texts uncuttable:
    they are then searched whole."""
    if len(pieces) > MAX_PIECES:
        raise ValueError("too many pieces to broadcast")
    ids = [i for i, (p, _) in enumerate(pieces) if p]
    base, check, value = double_array([pieces[i][0] for i in ids], ids)
    spell_at = np.concatenate(([0], np.cumsum([len(s) for s in spellings])))
    inner = re.compile(rb"(?:(?!" + MARK + rb").)" + MARK, re.S)
    cuttable = not any(inner.search(re.sub(rb"^(?:" + MARK + rb")+", b"", pieces[i][0])) or MARK in re.sub(rb"^(?:" + MARK + rb")+", b"", pieces[i][0]) for i in ids)
    return Vocabulary(base, check, value, np.array([s for _, s in pieces]), np.array(byte_ids, np.int32), np.frombuffer(b"".join(spellings), np.uint8), spell_at, max(len(pieces[i][0]) for i in ids), cuttable)


def load_vocabulary(model_file: str = MODEL) -> Vocabulary:
    """The pieces of a SentencePiece model file, read on the driver.

    A unigram model's log scores are used as they are. Other models hold merge ranks instead of log scores;
    theirs come from the rank by Zipf's law: log score = -log(rank + 2) less the log of the total.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    given = {i: sp.get_score(i) for i in normal}
    if all(float(s).is_integer() for s in given.values()):
        order = sorted(normal, key=lambda i: (-given[i], i))
        total = np.log(sum(1.0 / (r + 2) for r in range(len(order))))
        given = {i: -np.log(r + 2) - total for r, i in enumerate(order)}
    pieces, spellings, byte_ids = [(b"", 0.0)] * n, [b""] * n, [-1] * 256
    for i in range(n):
        if i in given:
            piece = sp.id_to_piece(i).encode()
            pieces[i], spellings[i] = (piece, float(given[i])), piece.replace(MARK, b" ")
        elif sp.is_byte(i):
            b = int(sp.id_to_piece(i)[3:5], 16)
            byte_ids[b], spellings[i] = i, bytes([b])
        elif sp.is_unknown(i):
            spellings[i] = " ⁇ ".encode()
    if min(byte_ids) < 0:
        raise ValueError("the model has no byte fallback")
    return vocabulary(pieces, byte_ids, spellings)


def best_paths(v: Vocabulary, units: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units, one after the other; number of ids of each): each unit's path of greatest score.

    Between equal scores the path whose last step begins earlier wins. Units hold markers, not spaces.
    """
    raw = np.frombuffer(b"".join(units), np.uint8)
    n = len(raw)
    lens = np.fromiter(map(len, units), np.int64, len(units))
    stop = np.cumsum(lens)
    begin = stop - lens
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(units), np.int64)
    unit = np.repeat(np.arange(len(units)), lens)
    head = np.flatnonzero((raw & 0xC0) != 0x80)  # where characters start
    width = np.diff(np.append(head, n))
    width = np.minimum(width, stop[unit[head]] - head)
    room = stop[unit[head]] - head
    # walk the trie from every character at once
    starts, ends, ids = [], [], []
    at, state, idx = head, np.zeros(len(head), np.int64), np.arange(len(head))
    single = np.zeros(len(head), bool)
    depth = 0
    while len(idx):
        c = raw[at + depth].astype(np.int64)
        t = v.base[state] + c
        ok = v.check[t] == state
        at, idx, state = at[ok], idx[ok], t[ok]
        depth += 1
        found = v.value[state]
        hit = np.flatnonzero(found >= 0)
        starts.append(at[hit])
        ends.append(at[hit] + depth)
        ids.append(found[hit].astype(np.int64))
        single[idx[hit[width[idx[hit]] == depth]]] = True
        more = room[idx] > depth
        at, idx, state = at[more], idx[more], state[more]
    lone = np.flatnonzero(~single)
    starts.append(head[lone])
    ends.append(head[lone] + width[lone])
    ids.append(np.full(len(lone), -1, np.int64))
    s, e, p = map(np.concatenate, (starts, ends, ids))
    score = np.where(p >= 0, v.score[p], v.score.min() - UNKNOWN_PENALTY)
    # forward: matches by where they start in their unit; those of one place end apart within a unit
    offset = s - begin[unit[s]]
    order = np.lexsort((e, offset))
    s, e, p, score = s[order], e[order], p[order], score[order]
    cuts = np.append(np.flatnonzero(np.diff(offset[order], prepend=-1)), len(s))
    # a position's slot: units get one slot more than they have bytes
    slot_s, slot_e = s + unit[s], e + unit[s]
    best = np.full(n + len(units), -np.inf)
    best[begin + np.arange(len(units))] = 0.0
    back = np.zeros(n + len(units), np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        got = best[slot_s[a:b]] + score[a:b]
        to = slot_e[a:b]
        better = np.flatnonzero(got > best[to])
        best[to[better]] = got[better]
        back[to[better]] = a + better
    # backward, all units side by side
    live = np.flatnonzero(lens > 0)
    slot = stop[live] + live
    steps_u, steps_m = [], []
    while len(live):
        m = back[slot]
        steps_u.append(live)
        steps_m.append(m)
        slot = slot_s[m]
        go = slot > begin[live] + live
        live, slot = live[go], slot[go]
    u, m = np.concatenate(steps_u), np.concatenate(steps_m)
    rank = np.repeat(np.arange(len(steps_u)), [len(x) for x in steps_u])
    order = np.lexsort((-rank, u))
    u, m = u[order], m[order]
    piece = p[m]
    # unknown characters become their bytes; the stand-in for a literal marker has three
    spare = piece < 0
    literal = spare & (raw[s[m]] == _LITERAL[0])
    size = np.where(literal, 3, np.where(spare, e[m] - s[m], 1))
    row = np.repeat(np.arange(len(m)), size)
    k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out = piece[row].astype(np.int32)
    b = np.flatnonzero(spare[row])
    byte = np.where(literal[row[b]], np.frombuffer(MARK, np.uint8)[np.minimum(k[b], 2)], raw[np.minimum(s[m][row[b]] + k[b], n - 1)])
    out[b] = v.byte_id[byte]
    return out, np.bincount(u[row], minlength=len(units)).astype(np.int64)


_UNITS = re.compile(rb" +[^ ]*")


def encode_block(v: Vocabulary, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, one after the other; number of each). A unit that recurs is searched once."""
    codes: dict[bytes, int] = {}
    seen: list[int] = []
    counts = []
    for t in texts:
        if not t:
            counts.append(0)
            continue
        units = _UNITS.findall(b" " + t) if v.cuttable else [b" " + t]
        counts.append(len(units))
        seen += [codes.setdefault(u, len(codes)) for u in units]
    flat, size = best_paths(v, [u.replace(MARK, _LITERAL).replace(b" ", MARK) for u in codes])
    at = np.cumsum(size) - size
    code = np.array(seen, np.int64)
    z = size[code]
    ids = flat[np.repeat(at[code] - (np.cumsum(z) - z), z) + np.arange(z.sum())]
    ends = np.concatenate(([0], np.cumsum(z)))
    last = np.cumsum(np.array(counts, np.int64))
    return ids, np.diff(np.concatenate(([0], ends[last])))


def decode_block(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The texts of id runs; ids outside the vocabulary are left out."""
    known = (ids >= 0) & (ids < len(v.spell_at) - 1)
    ids = np.where(known, ids, 0)
    size = np.where(known, np.diff(v.spell_at)[ids], 0)
    at = v.spell_at[ids]
    raw = v.spell[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
    return [raw[a + 1 : b] if raw[a : a + 1] == b" " else raw[a:b] for a, b in zip(ends, ends[1:])]


def _blocks(texts: list[bytes | None], limit: int = 2 << 20) -> Iterator[tuple[int, list[bytes | None]]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or b"") <= limit):
            size += len(texts[j] or b"")
            j += 1
        yield i, texts[i:j]
        i = j


def encode(docs: DataFrame, model_file: str = MODEL, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``(keep..., n_pieces, ids, exact)``: the piece ids of every whole text, and whether they decode to it.

    Null texts have null ids and ``exact``, and 0 pieces; empty texts have no ids. Repeated rows are encoded
    each; an empty table gives an empty result; other columns are not read.
    """
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(load_vocabulary(model_file)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*shared.value)
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.binary()).to_pylist()
            for i, block in _blocks(texts):
                ids, counts = encode_block(v, [t or b"" for t in block])
                back = decode_block(v, ids, counts)
                null = np.array([t is None for t in block])
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32(), mask=np.append(null, False))
                exact = pa.array([None if t is None else t == b for t, b in zip(block, back)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, len(block)) for c in range(len(keep))), pa.array(counts, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), exact], [*keep, "n_pieces", "ids", "exact"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{kinds}n_pieces int, ids array<int>, exact boolean")


def decode(encoded: DataFrame, model_file: str = MODEL, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``(keep..., text)``: the texts of id arrays. Null arrays give null texts; null ids and ids outside the
    vocabulary are left out; bytes that are no UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(tuple(load_vocabulary(model_file)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*shared.value)
        for b in batches:
            lists = b.column(len(keep)).to_pylist()
            clean = [[x for x in row or () if x is not None] for row in lists]
            counts = np.fromiter(map(len, clean), np.int64, len(clean))
            texts = decode_block(v, np.array([x for row in clean for x in row], np.int64), counts)
            out = [None if row is None else t.decode("utf-8", "replace") for row, t in zip(lists, texts)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(len(keep))), pa.array(out, pa.string())], [*keep, "text"])

    kinds = "".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}, " for c in keep)
    return encoded.select(*keep, F.col(ids).cast("array<int>").alias(ids)).mapInArrow(run, f"{kinds}text string")
