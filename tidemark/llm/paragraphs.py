"""Substring dedup by paragraphs: MinHash banding, exact confirmation, removal by components.

A text's paragraphs end at blank lines. They take part whole, however short, and long ones besides in pieces, cut
before each word whose hash is less than those of the RADIUS words before it and no more than those of the RADIUS words
after it. Such a cut depends on the words around it alone, so a passage that repeats inside longer paragraphs falls into
the same pieces wherever it stands; a run of the same words has no cut, and no piece is shorter than RADIUS words.
Pieces and whole paragraphs are both called paragraphs below.

1. Each task names its paragraphs by a 128-bit BLAKE2b digest of their words. The same words in a larger document of
   the task repeat those of the least. For others one row goes out for the digest and one for each band of minima.
2. Where a digest has several documents, all but the least repeat it. Where a band key is shared by different paragraphs
   of several documents, those are fetched from the texts and meet in full: they are confirmed by exact Jaccard
   similarity and joined to components.
3. All but the earliest paragraph of a component are removed, as are paragraphs whose words stand in a smaller
   document. A document never repeats itself here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import cut, lean, parts_by_size
from .suffix import ANCHOR, ANSWER, BLOCKS, KEEP, KNOWN, SPANS, _batch, _by_text, _firsts, _gather, _home, _joined, _of_kind, _pack, _route, _table, _texts, _unpack, _whole, each_row, homes, known_rows, removed
from .textkit import Shingler, blocks, mix64

RADIUS = 7
ROWS = 2
RECALL = 0.99
BANDS = minhash.tuned(0.75, ROWS, RECALL)
WIDTH = 5
FLUSH = 4 << 20  # bytes of text whose paragraphs travel together
NAME = 5  # kind of the blocks of digests
REPEATS, OPEN = 0, 1


def _sums(hashes: np.ndarray, place: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of the words from each start to the next: the sum of a random function of (place, word)."""
    return np.add.reduceat(mix64(hashes + mix64(place.astype(np.uint64) + np.uint64(1))), start)


class Paragraphs:
    """The pieces and then the whole paragraphs of a block of texts: parallel arrays over them.

    ``doc``: index of the text; ``first``, ``last``: its bytes in the text; ``word``, ``words``: its first word in
    the block and number of words; ``tag``: a hash of its words, by which a document knows its own paragraphs.
    """

    def __init__(self, texts: list[bytes], cutter: Shingler):
        hashes, counts = cutter.words(texts)
        self.texts, self.hashes, n = texts, hashes, len(hashes)
        self.start, self.end, self.lower = cutter.start, cutter.end, cutter.lower
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(lens + 1) - lens - 1
        doc_of = np.repeat(np.arange(len(texts)), counts)
        if not n:
            self.doc = self.first = self.last = self.word = self.words = np.zeros(0, np.int64)
            self.tag = np.zeros(0, np.uint64)
            return
        raw = np.frombuffer(b" ".join(texts), np.uint8)
        ends = np.flatnonzero(raw == 10)
        para = np.searchsorted(ends[1:][np.diff(ends) == 1], cutter.start)
        fresh = np.ones(n, bool)
        fresh[1:] = (doc_of[1:] != doc_of[:-1]) | (para[1:] != para[:-1])
        new = fresh.copy()
        whole = np.flatnonzero(fresh)
        length = np.diff(np.append(whole, n))
        place = np.arange(n) - np.repeat(whole, length)
        inside = np.flatnonzero((place >= RADIUS) & (np.repeat(length, length) - 1 - place >= RADIUS))
        low, have = hashes, 1  # low[i]: the least of RADIUS words from i on
        while have < RADIUS:
            s = min(have, RADIUS - have)
            low = np.minimum(low[:-s], low[s:])
            have += s
        if len(inside):
            new[inside] = (hashes[inside] < low[inside - RADIUS]) & (hashes[inside] <= low[inside + 1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, n))
        divided = np.diff(np.append(np.searchsorted(at, whole), len(at))) > 1  # of one piece: it stands there already
        self.word, self.words = np.append(at, whole[divided]), np.append(size, length[divided])
        sums = [_sums(hashes, np.arange(n) - np.repeat(at, size), at), _sums(hashes, place, whole)[divided]]
        self.tag = mix64(np.concatenate(sums) + self.words.astype(np.uint64))
        self.doc = doc_of[self.word]
        self.first = cutter.start[self.word] - begin[self.doc]
        self.last = cutter.end[self.word + self.words - 1] - begin[self.doc]

    def names(self) -> np.ndarray:
        """(paragraphs, 2) uint64: the digest of every paragraph's words, as ``minhash.digest`` has it.

        All words of the block are lower-cased and set one space apart at once; a paragraph is a slice of that.
        """
        raw = np.frombuffer(b" ".join([*self.texts, b""]), np.uint8)
        size = self.end - self.start
        kept = np.zeros(len(raw) + 1, np.int8)  # from each word's first byte to the one after its last
        kept[self.start] += 1
        kept[self.end + 1] -= 1
        even = raw.copy()
        even[self.end] = 0x20
        even = self.lower[even[np.cumsum(kept[:-1], dtype=np.int8) > 0]].tobytes()
        at = np.cumsum(size + 1) - size - 1
        ends = at[self.word + self.words - 1] + size[self.word + self.words - 1]
        named = hashlib.blake2b
        got = b"".join([named(even[a:z], digest_size=16).digest() for a, z in zip(at[self.word].tolist(), ends.tolist())])
        return np.frombuffer(got, np.uint64).reshape(-1, 2)

    def band_keys(self, of: np.ndarray, cutter: Shingler, signer: minhash.Signer) -> np.ndarray:
        """(paragraphs, bands) uint64 of those numbered ``of``, each of at least WIDTH words."""
        runs = cutter.runs(self.hashes)
        x = np.append((runs ^ (runs >> np.uint64(32))).astype(np.uint32), np.uint32(0))
        ends = np.stack([self.word[of], self.word[of] + self.words[of] - WIDTH + 1], axis=1).ravel()
        minima = np.stack([np.minimum.reduceat(x * a + b, ends)[::2] for a, b in zip(signer.a[:, 0], signer.b[:, 0])], axis=1)
        return mix64(signer.bands(minima).view(np.uint64))


def _tools(bands: int, rows: int) -> tuple[Shingler, minhash.Signer]:
    return Shingler(WIDTH), minhash.Signer(minhash.Params(bands=bands, rows=rows))


_LOW = np.uint64((1 << 8 * KEEP) - 1)


def _mark(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    return mix64(mix64(doc.astype(np.int64).view(np.uint64)) + name)


def said_of(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """Blocks of digests and of band keys with their least documents, and of ranges known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, signer = _tools(bands, rows)
        for ids, texts in _by_text(batches, FLUSH):
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            seen: list[tuple[np.ndarray, np.ndarray]] = []
            total = 0
            for i, block in blocks(texts, 1 << 19):
                p = Paragraphs(block, cutter)
                if len(p.doc):
                    name = p.names()
                    for col, v in zip(cols, (ids[i + p.doc], p.first, p.last, name[:, 0], name[:, 1], p.tag)):
                        col.append(v)
                    keys = np.zeros((len(p.doc), bands), np.uint64)
                    long = np.flatnonzero(p.words >= WIDTH)  # the set of fewer words is their sequence: equal or disjoint
                    if len(long):
                        keys[long] = p.band_keys(long, cutter, signer)
                    seen.append((keys, p.words >= WIDTH))
                    total += len(p.doc)
            if not total:
                continue
            doc, first, last, one, two, tag = map(np.concatenate, cols)
            keys, long = (np.concatenate(x) for x in zip(*seen))
            order = np.lexsort((doc, two, one))
            new = _firsts([one[order], two[order]])
            held = order[np.flatnonzero(new)]
            repeats = order[doc[order] > doc[held][np.cumsum(new) - 1]]
            out = known_rows(doc[repeats], first[repeats], last[repeats], n)
            held = held[np.argsort(doc[held], kind="stable")]  # neighbours compress
            for part, at in _route((one[held] % np.uint64(n)).astype(np.int64), n):
                at = held[at]
                out.append((NAME, part, _pack(one[at].view(np.int64), two[at].view(np.int64), tag[at].view(np.int64), doc[at])))
            held = held[long[held]]
            key, row = keys[held].ravel(), np.repeat(held, bands)
            for part, at in _route(((key >> np.uint64(8 * KEEP)) % np.uint64(n)).astype(np.int64), n):
                out.append((ANCHOR, part, _pack(key[at] & _LOW, tag[row[at]] & _LOW, doc[row[at]])))
            if out:
                yield _batch(out)

    return docs.mapInArrow(run, BLOCKS)


def answers(found: DataFrame, n: int) -> DataFrame:
    """What is known of digests and band keys that documents share: (mark, verdict) for the documents' homes."""

    def run(t: pa.Table) -> pa.Table:
        kind = t["kind"][0].as_py() if t.num_rows else KNOWN
        if kind == KNOWN:
            return t
        if kind == NAME:
            one, two, tag, doc = _gather(t["block"], np.int64, np.int64, np.int64, np.int64)
            order = np.lexsort((doc, two, one))
            one, two, tag, doc = one[order], two[order], tag[order], doc[order]
            new = _firsts([one, two])
            say = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            mark, doc, verdict = _mark(doc[say], tag[say].view(np.uint64)), doc[say], REPEATS
        else:
            key, name, doc = _gather(t["block"], np.uint64, np.uint64, np.int64)
            order = np.lexsort((doc, name, key))
            key, name, doc = key[order], name[order], doc[order]
            start = np.flatnonzero(_firsts([key]))
            least = _firsts([key, name])
            several = np.add.reduceat(least.astype(np.int64), start) > 1
            several &= np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
            say = least & np.repeat(several, np.diff(np.append(start, len(key))))
            mark, at = np.unique(_mark(doc[say], name[say]), return_index=True)
            doc, verdict = doc[say][at], OPEN
        return _table([(ANSWER, p, _pack(mark[at].view(np.int64), np.full(len(at), verdict, np.uint8))) for p, at in _route(_home(doc, n), n)])

    return found.groupBy("kind", "part").applyInArrow(run, BLOCKS)


def colliding(texts: DataFrame, said: DataFrame) -> DataFrame:
    """Per home: ranges of paragraphs known to repeat, and the paragraphs that share a band with different ones."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        mark, verdict = _gather(_of_kind(right, ANSWER), np.int64, np.uint8)
        marks = [np.unique(mark[verdict == v].view(np.uint64)) for v in (REPEATS, OPEN)]
        known = [tuple(_gather(_of_kind(right, KNOWN), np.int64, np.int64, np.int64))]
        out: list[tuple[int, int, bytes]] = []
        cutter = Shingler(WIDTH)
        part = (left if left.num_rows else right)["part"][0].as_py()
        for ids, own in _texts(left["block"]) if len(mark) else ():
            for i, block in blocks(own, 1 << 19):
                p = Paragraphs(block, cutter)
                if not len(p.doc):
                    continue
                d = ids[i + p.doc]
                repeats = np.isin(_mark(d, p.tag), marks[REPEATS])
                opened = np.flatnonzero(~repeats & np.isin(_mark(d, p.tag & _LOW), marks[OPEN]))
                known.append((d[repeats], p.first[repeats], p.last[repeats]))
                if len(opened):
                    a, b = p.first[opened], p.last[opened]
                    body = b"".join(block[t][x:y] for t, x, y in zip(p.doc[opened].tolist(), a.tolist(), b.tolist()))
                    out.append((SPANS, part, _pack(d[opened], a, b) + body))
        d, a, b = _joined(*(np.concatenate(x) for x in zip(*known)))
        if len(d):
            out.append((KNOWN, part, _pack(d, a, b)))
        return _table(out)

    return texts.groupBy("part").cogroup(said.groupBy("part")).applyInArrow(run, BLOCKS)


def _items(blocks_: DataFrame) -> DataFrame:
    """``(id, text)`` of the paragraphs in blocks; an id is (document, first byte, end)."""
    kind = pa.struct([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in map(_whole, b.column(0).to_pylist()):
                d, a, z = _unpack(block, np.int64, np.int64, np.int64)
                at = 8 + 24 * len(d) + np.concatenate(([0], np.cumsum(z - a)))
                texts = pa.array([block[x:y] for x, y in zip(at.tolist(), at[1:].tolist())], pa.binary()).cast(pa.string())
                ids = pa.StructArray.from_arrays([pa.array(d), pa.array(a), pa.array(z)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([ids, texts], ["id", "text"])

    return blocks_.select("block").mapInArrow(run, "id struct<doc:long,start:long,end:long>, text string")


def _ranges(rows: DataFrame, n: int) -> DataFrame:
    """Blocks of (doc, start, end) rows for the documents' homes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = known_rows(*(b.column(c).to_numpy() for c in range(3)), n)
            if got:
                yield _batch(got)

    return rows.mapInArrow(run, BLOCKS)


def dedup_paragraphs(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` for every document.

    ``spans`` are the bytes of removed paragraphs (what stands between two neighbouring ones stays); ``kept`` is
    what is left. Null and empty texts have no bytes and no spans. Rows without an id, or with a repeated one, are
    treated as ``suffix.each_row`` says. An empty table gives an empty result.
    """
    lean(docs.sparkSession)
    n = parts_by_size(docs)

    def dedup(given: DataFrame) -> DataFrame:
        texts = homes(given, n, FLUSH)
        met = cut(colliding(texts, answers(said_of(given, bands, rows, n), n)))
        # numbers, fixed by the checkpoint, are a fifth as wide as (document, first byte, end) in every shuffle
        items = cut(_items(met.filter(F.col("kind") == SPANS)).withColumn("no", F.monotonically_increasing_id()))
        groups = minhash.near_components(items, minhash.Params(bands=20, rows=5, width=WIDTH), id_col="no", unique=True, rarest=True)
        joined = groups.filter(F.col("id") != F.col("component")).select(F.col("id").alias("no"), "component")
        joined = cut(joined.unionByName(joined.select(F.col("component").alias("no"), "component").distinct()).join(items.select("no", "id"), "no"))
        first = joined.groupBy("component").agg(F.min("id.doc").alias("least"))
        gone = joined.join(first, "component").filter(F.col("id.doc") != F.col("least")).select(F.col("id.doc").alias("d"), F.col("id.start").alias("a"), F.col("id.end").alias("b"))
        return removed(texts, met.filter(F.col("kind") == KNOWN).unionByName(_ranges(gone, n)), 1)

    return each_row(docs, doc_id, text, dedup)


def paragraph_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` from the operator's spans and kept bytes."""
    out = dedup_paragraphs(docs)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
