"""Substring removal across documents by hash-compared suffix sorting.

Every ``length``-byte string (a window) has an anchor: the leftmost of its GRAM-byte grams with the least
hash. Equal windows have equal anchors at equal places, so windows are compared only where anchors agree.
Windows that follow each other and share an anchor form a run; a run's bytes are its span.

1. Each task reduces its runs to one row per (anchor, span), held by the least document; the same span in other
   documents of the task is compared with it byte by byte and known to repeat it. Rows travel in packed blocks.
2. Where an anchor is shared by documents, its spans are ``open``: they are fetched from the texts (equal ones of a
   block once, again compared by bytes) and meet by anchor, or window by window where an anchor has very many spans.
3. What meets is suffix-sorted: by the first eight bytes, then by a mergesort whose comparisons find the common
   extension by binary search over prefix polynomial hashes. Neighbours that agree for the whole length are
   verified byte by byte. Whole spans are sorted first; then the windows of those that repeat no other.
   What stands above the least document of its class is a repeat.
4. Covered bytes are cut from the texts.

No byte is removed on a hash: all that hashes do is to choose what is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, named, parts_by_size
from .textkit import _powers, blocks, mix64

GRAM = 16
KEEP = 5  # bytes kept of an anchor's hash and of a span's; the part that an anchor goes to is chosen by other bits
FLUSH = 16 << 20  # bytes of text whose runs travel together
LEVEL = 6  # of compression of all blocks that travel
MANY = 4096  # spans of one anchor beyond which its windows travel by their own content

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


class PrefixHashes:
    """Prefix polynomial hashes of a byte array: any substring's hash in constant time."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        up = _powers(_BASE, n + 1)
        self.raw, self.down = raw, _powers(_INV, n + 1)
        self.up = up
        self.acc = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.acc[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.acc[end] - self.acc[start]) * self.down[start]

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length, up to ``most``, of the common extension at i and j, by binary search."""
        lo, hi = np.zeros(len(i), np.int64), most.astype(np.int64)
        while True:
            wide = lo < hi
            if not wide.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = self.of(i, i + mid) == self.of(j, j + mid)
            lo = np.where(wide & same, mid, lo)
            hi = np.where(wide & ~same, mid - 1, hi)


def suffix_sort(h: PrefixHashes, starts: np.ndarray, groups: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Order of the suffixes at ``starts``, cut at ``length`` bytes, within each group; ties keep input order.

    Each suffix must have ``length`` bytes, all of a group the same. The first eight bytes are compared as a number;
    what they leave equal is merge-sorted, all runs of a level at once, each comparison taking a logarithmic number
    of hashes.
    """
    n = len(starts)
    if n < 2:
        return np.arange(n)
    length = np.broadcast_to(np.asarray(length, np.int64), n)
    first = np.zeros(n, np.uint64)
    for k in range(min(8, int(length.min()))):
        first = (first << np.uint64(8)) | h.raw[starts + k].astype(np.uint64)
    order = np.lexsort((first, groups))
    f, g = first[order], groups[order]
    new = np.ones(n, bool)
    new[1:] = (f[1:] != f[:-1]) | (g[1:] != g[:-1])
    seg_start = np.flatnonzero(new)
    seg_len = np.diff(np.append(seg_start, n))
    if not (seg_len > 1).any():
        return order
    at = np.repeat(seg_start, seg_len)  # start of every place's segment
    size = np.repeat(seg_len, seg_len)
    places = np.flatnonzero(size > 1)
    width, largest = 1, int(seg_len.max())
    while width < largest:
        p = places[size[places] > width]
        if not len(p):
            break
        off = p - at[p]
        run = off // width
        left = run % 2 == 0
        sib = at[p] + np.where(left, run + 1, run - 1) * width  # where the run to merge with begins
        top = at[p] + size[p]
        sib_end = np.minimum(sib + width, top)
        own, most = starts[order[p]], length[order[p]]
        lo, hi = np.minimum(sib, top), np.maximum(np.minimum(sib, top), sib_end)
        base = lo.copy()
        while True:  # how many of the other run come before this suffix
            wide = np.flatnonzero(lo < hi)
            if not len(wide):
                break
            mid = (lo[wide] + hi[wide]) >> 1
            i, j, z = own[wide], starts[order[mid]], most[wide]
            ext = h.common(i, j, z)
            e = np.minimum(ext, z - 1)
            less = h.raw[j + e] < h.raw[i + e]  # the other one comes first
            go = np.where(ext >= z, ~left[wide], less)
            lo[wide] = np.where(go, mid + 1, lo[wide])
            hi[wide] = np.where(go, hi[wide], mid)
        pair = at[p] + (run - run % 2) * width
        to = pair + (off - run * width) + (lo - base)
        merged = order.copy()
        merged[to] = order[p]
        order = merged
        width *= 2
    return order


def same_bytes(raw: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray, limit: int = 1 << 18) -> np.ndarray:
    """Whether the ``size`` bytes (at least one) at i and at j are equal, about ``limit`` bytes at a time."""
    out = np.zeros(len(i), bool)
    total = np.cumsum(size)
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
        z = size[a:b]
        at = np.cumsum(z) - z
        step = np.arange(z.sum()) - np.repeat(at, z)
        out[a:b] = np.logical_and.reduceat(raw[np.repeat(i[a:b], z) + step] == raw[np.repeat(j[a:b], z) + step], at)
        a = b
    return out


def repeated_windows(h: PrefixHashes, starts: np.ndarray, groups: np.ndarray, docs: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Whether each string of ``length`` bytes also starts in a smaller document of its group."""
    n = len(starts)
    out = np.zeros(n, bool)
    if not n:
        return out
    length = np.broadcast_to(np.asarray(length, np.int64), n)
    order = suffix_sort(h, starts, groups, length)
    s, g, z = starts[order], groups[order], length[order]
    new = np.ones(n, bool)
    same = np.flatnonzero(g[1:] == g[:-1])
    if len(same):
        same = same[h.common(s[same], s[same + 1], z[same]) >= z[same]]
        # hashes may collide: bytes decide
        new[same[same_bytes(h.raw, s[same], s[same + 1], z[same])] + 1] = False
    seg = np.cumsum(new) - 1
    least = np.minimum.reduceat(docs[order], np.flatnonzero(new))
    out[order] = docs[order] > least[seg]
    return out


def equal_spans(raw: np.ndarray, at: np.ndarray, size: np.ndarray, names: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeats, rest): rows whose bytes are those of the first row of the same names in a smaller document, and
    rows to go on with: first rows, and rows whose names agree by chance. The rest of a first row's document go with it."""
    order = np.lexsort((docs, *names))
    first = _firsts([x[order] for x in names])
    holder = order[np.flatnonzero(first)][np.cumsum(first) - 1]
    later = np.flatnonzero(~first)
    row, held = order[later], holder[later]
    equal = size[row] == size[held]
    equal[equal] = same_bytes(raw, at[row[equal]], at[held[equal]], size[row[equal]])
    own = docs[row] == docs[held]
    return row[equal & ~own], np.concatenate((order[first], row[~equal]))


def _joined(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of one document that touch or overlap, as one."""
    o = np.lexsort((a, d))
    d, a, b = d[o], a[o], b[o]
    new = np.ones(len(d), bool)
    if len(d):
        new[1:] = (d[1:] != d[:-1]) | (a[1:] > b[:-1])
    s = np.flatnonzero(new)
    last = np.append(s, len(d))[1:] - 1
    return d[s], a[s], np.maximum.reduceat(b, s) if len(s) else b[last]


class Runs:
    """The runs of windows of a block of texts: parallel arrays over runs.

    ``doc``: index of the text; ``first``: start of the first window in its text, ``at``: in the block; ``count``:
    windows; ``key``: hash of the anchor; ``span``: hash of the span.
    """

    def __init__(self, texts: list[bytes], length: int):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(lens) - lens
        self.raw, self.begin = raw, begin
        n, w = len(raw), length - GRAM + 1
        if n < length:
            self.doc = self.first = self.at = self.count = np.zeros(0, np.int64)
            self.key = self.span = self.place = np.zeros(0, np.uint64)
            return
        self.hashes = PrefixHashes(raw)
        g = raw.astype(np.uint64) + np.uint64(1)
        step, base = 1, _BASE
        while step < GRAM:  # grams by doubling: one of 2k bytes is one of k, times a power, plus the next
            g = g[:-step] * np.uint64(base) + g[step:]
            base = base * base & 0xFFFFFFFFFFFFFFFF
            step *= 2
        g = mix64(g)
        m = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
        have = 1
        while have < w:  # least of w neighbours by doubling; the last step overlaps
            s = min(have, w - have)
            m = np.minimum(m[:-s], m[s:])
            have += s
        start = np.arange(len(m))
        ok = np.zeros(n, bool)
        for b, size in zip(begin.tolist(), lens.tolist()):
            if size >= length:
                ok[b : b + size - length + 1] = True
        ok = ok[: len(m)]
        new = ok.copy()
        new[1:] &= (m[1:] != m[:-1]) | ~ok[:-1]
        first = np.flatnonzero(new)
        last_of = ok.copy()
        last_of[:-1] &= new[1:] | ~ok[1:]
        last = np.flatnonzero(last_of)
        del start
        anchor = (m[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.doc = np.searchsorted(begin, first, "right") - 1
        # empty texts share a begin; the last of them is the one with bytes
        self.count = last - first + 1
        self.at = first
        self.first = first - begin[self.doc]
        low = np.uint64((1 << 8 * KEEP) - 1)
        self.key = g[anchor] & low
        self.place = g[anchor] >> np.uint64(8 * KEEP)
        self.span = mix64(self.hashes.of(first, last + length) + self.count.astype(np.uint64)) & low


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as one block; hashes take KEEP bytes."""
    out = [len(arrays[0]).to_bytes(8, "little")]
    for a in arrays:
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :KEEP]).tobytes() if a.dtype == np.uint64 else np.ascontiguousarray(a).tobytes())
    return b"".join(out)


def _mark(doc: np.ndarray, key: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The 64-bit name by which a document's span finds its answer at the document's home."""
    return mix64(mix64(mix64(doc.view(np.uint64)) + key * np.uint64(0x9E3779B97F4A7C15)) + span)


def _squeezed(block: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(block)


def _whole(block: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(block)


def _unpack(block: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = int.from_bytes(block[:8], "little"), 8, []
    for kind in kinds:
        if kind is np.uint64:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :KEEP] = np.frombuffer(block, np.uint8, n * KEEP, at).reshape(n, KEEP)
            out.append(wide.view(np.uint64).ravel())
            at += n * KEEP
        else:
            out.append(np.frombuffer(block, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return out


def _gather(column, *kinds) -> list[np.ndarray]:
    got = [_unpack(_whole(x), *kinds) for x in column.to_pylist()]
    return [np.concatenate([g[k] for g in got]) if got else np.zeros(0, kind) for k, kind in enumerate(kinds)]


def _route(place: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(destination, rows) for every destination that gets rows."""
    order = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[order], np.arange(n + 1))
    for p in range(n):
        if ends[p] < ends[p + 1]:
            yield p, order[ends[p] : ends[p + 1]]


def _home(docs: np.ndarray, n: int) -> np.ndarray:
    """The part that a document's text and all answers about it go to."""
    return (mix64(docs.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _by_text(batches: Iterator[pa.RecordBatch], flush: int = FLUSH) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, texts) of about ``flush`` bytes each."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            ids.append(i)
            texts.append(t or b"")
            size += len(texts[-1]) + 64
            if size >= flush:
                yield np.array(ids, np.int64), texts
                ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


BLOCKS = "kind int, part int, block binary"
_NAMES = ["kind", "part", "block"]
ANCHOR, ANSWER, TEXT, SPANS, KNOWN = 0, 1, 2, 3, 4
OPEN, SPREAD = 1, 2


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([_squeezed(r[2]) for r in rows], pa.binary())], _NAMES)


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _firsts(sorted_cols: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(sorted_cols[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_cols])
    return new


def known_rows(d: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    """Blocks of known ranges for the documents' homes."""
    d, a, b = _joined(d, a, b)
    return [(KNOWN, p, _pack(d[at], a[at], b[at])) for p, at in _route(_home(d, n), n)]


def anchors(docs: DataFrame, length: int, n: int) -> DataFrame:
    """Blocks of (anchor, span, least document), and of ranges known to repeat a smaller document of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _by_text(batches):
            cols: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
            base = 0
            for i, block in blocks(texts, 1 << 19):
                r = Runs(block, length)
                for col, v in zip(cols, (r.place % np.uint64(n), r.key, r.span, ids[i + r.doc], r.first, base + r.at, r.count)):
                    col.append(v)
                base += sum(map(len, block))
            place, key, span, doc, first, at, count = map(np.concatenate, cols)
            raw = np.frombuffer(b"".join(texts), np.uint8)
            repeats, rest = equal_spans(raw, at, count + length - 1, [span, key], doc)
            rows = known_rows(doc[repeats], first[repeats], first[repeats] + count[repeats], n)
            rest = rest[np.argsort(doc[rest], kind="stable")]  # neighbours compress
            for p, of in _route(place[rest].astype(np.int64), n):
                of = rest[of]
                rows.append((ANCHOR, p, _pack(key[of], span[of], doc[of])))
            if rows:
                yield _batch(rows)

    return docs.mapInArrow(run, BLOCKS)


def answers(found: DataFrame, n: int) -> DataFrame:
    """What is known of anchors that several documents share: blocks of (mark, verdict) for the documents' homes."""

    def run(t: pa.Table) -> pa.Table:
        if not t.num_rows or t["kind"][0].as_py() == KNOWN:
            return t
        key, span, doc = _gather(t["block"], np.uint64, np.uint64, np.int64)
        order = np.lexsort((span, key))
        key, span, doc = key[order], span[order], doc[order]
        start = np.flatnonzero(_firsts([key]))
        size = np.diff(np.append(start, len(key)))
        kinds = np.add.reduceat(_firsts([key, span]).astype(np.int64), start)
        mixed = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        verdict = np.repeat(np.where(mixed, np.where(kinds > MANY, SPREAD, OPEN), 255).astype(np.uint8), size)
        say = np.flatnonzero(verdict != 255)
        say = say[np.argsort(doc[say], kind="stable")]
        mark, doc, verdict = _mark(doc[say], key[say], span[say]).view(np.int64), doc[say], verdict[say]
        return _table([(ANSWER, p, _pack(mark[at], verdict[at])) for p, at in _route(_home(doc, n), n)])

    return found.groupBy("kind", "part").applyInArrow(run, BLOCKS)


def homes(docs: DataFrame, n: int, flush: int = FLUSH) -> DataFrame:
    """The texts themselves, in compressed blocks for their homes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _by_text(batches, flush):
            rows = []
            for p, at in _route(_home(ids, n), n):
                own = [texts[i] for i in at]
                lens = np.fromiter(map(len, own), np.int64, len(own))
                rows.append((TEXT, p, _pack(ids[at], lens) + b"".join(own)))
            if rows:
                yield _batch(rows)

    return docs.mapInArrow(run, BLOCKS)


def _texts(column) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    for block in column.to_pylist():
        data = _whole(block)
        ids, lens = _unpack(data, np.int64, np.int64)
        at = 8 + 16 * len(ids)
        own = []
        for size in lens.tolist():
            own.append(data[at : at + size])
            at += size
        yield ids, own


def _of_kind(t: pa.Table, kind: int):
    return t.filter(pc.equal(t["kind"], kind))["block"]


def _bytes_of(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of ranges, one after the other."""
    return raw[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def open_spans(texts: DataFrame, said: DataFrame, length: int, n: int) -> DataFrame:
    """Per home: ranges of window starts known to repeat, and the spans that must be compared."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        mark, verdict = _gather(_of_kind(right, ANSWER), np.int64, np.uint8)
        mark = mark.view(np.uint64)
        order = np.argsort(mark, kind="stable")
        mark, verdict = mark[order], verdict[order]
        known = [tuple(_gather(_of_kind(right, KNOWN), np.int64, np.int64, np.int64))]
        rows: list[tuple[int, int, bytes]] = []
        sent: list[tuple[np.ndarray, ...]] = []
        for ids, own in _texts(left["block"]) if len(mark) else ():
            for i, block in blocks(own, 1 << 19):
                r = Runs(block, length)
                d = ids[i + r.doc]
                m = _mark(d, r.key, r.span)
                at = np.minimum(np.searchsorted(mark, m), len(mark) - 1)
                what = np.where(mark[at] == m, verdict[at], 255)
                for state in (OPEN, SPREAD):
                    q = np.flatnonzero(what == state)
                    if not len(q):
                        continue
                    first, at_byte, count, k, name, dd = r.first[q], r.at[q], r.count[q], r.key[q], r.span[q], d[q]
                    if state == SPREAD:  # each window goes by its own content
                        rep = np.repeat(np.arange(len(q)), count)
                        shift = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
                        first, at_byte, dd = first[rep] + shift, at_byte[rep] + shift, dd[rep]
                        name = r.hashes.of(at_byte, at_byte + length)
                        k = mix64(name) & np.uint64((1 << 8 * KEEP) - 1)
                        count = np.ones(len(rep), np.int64)
                    repeats, _ = equal_spans(r.raw, at_byte, count + length - 1, [name, k], dd)
                    known.append((dd[repeats], first[repeats], first[repeats] + count[repeats]))
                    go = np.ones(len(dd), bool)
                    go[repeats] = False
                    k, dd, first, count, at_byte = (x[go] for x in (k, dd, first, count, at_byte))
                    sent.append((k, dd, first, count, _bytes_of(r.raw, at_byte, count + length - 1)))
        if sent:
            k, d, f, c, raw = (np.concatenate(x) for x in zip(*sent))
            size = c + length - 1
            start = np.cumsum(size) - size
            for p, at in _route((k % np.uint64(n)).astype(np.int64), n):
                rows.append((SPANS, p, _pack(k[at], d[at], f[at], c[at]) + _bytes_of(raw, start[at], size[at]).tobytes()))
        d, a, b = _joined(*(np.concatenate(x) for x in zip(*known)))
        if len(d):
            rows.append((KNOWN, (left if left.num_rows else right)["part"][0].as_py(), _pack(d, a, b)))
        return _table(rows)

    return texts.groupBy("part").cogroup(said.groupBy("part")).applyInArrow(run, BLOCKS)


def compared(spans: DataFrame, length: int, n: int) -> DataFrame:
    """Suffix-sort the spans that share an anchor, then the windows of those that repeat no other: ranges of
    repeated window starts, for the homes. Ranges that are known already pass."""

    def run(t: pa.Table) -> pa.Table:
        if not t.num_rows or t["kind"][0].as_py() == KNOWN:
            return t
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for block in map(_whole, t["block"].to_pylist()):
            k, d, f, c = _unpack(block, np.uint64, np.int64, np.int64, np.int64)
            for col, v in zip(cols, (k, d, f, c, np.frombuffer(block, np.uint8, offset=8 + (KEEP + 24) * len(k)))):
                col.append(v)
        k, d, f, c, raw = map(np.concatenate, cols)
        size = c + length - 1
        start = np.cumsum(size) - size
        group = np.unique(k, return_inverse=True)[1]
        order = np.lexsort((d, group))
        ends = np.append(np.flatnonzero(_firsts([group[order]])), len(order))
        weight = np.concatenate(([0], np.cumsum(size[order])))[ends]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        i = 0
        while i < len(ends) - 1:  # whole groups, about half a megabyte at once
            j = max(i + 1, int(np.searchsorted(weight, weight[i] + (1 << 19), "right")) - 1)
            rows = order[ends[i] : ends[j]]
            i = j
            z = size[rows]
            at = np.cumsum(z) - z
            h = PrefixHashes(_bytes_of(raw, start[rows], z))
            gone = repeated_windows(h, at, group[rows] * (2 * length) + z, d[rows], z)
            out.append((d[rows[gone]], f[rows[gone]], f[rows[gone]] + c[rows[gone]]))
            g = group[rows] - group[rows[0]]
            left = np.bincount(g[~gone])  # spans of a group; one alone has nothing to repeat
            go = ~gone
            go[go] = left[g[go]] > 1
            rows, at = rows[go], at[go]
            cnt = c[rows]
            rep = np.repeat(np.arange(len(rows)), cnt)
            shift = np.arange(len(rep)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            hit = repeated_windows(h, at[rep] + shift, group[rows][rep], d[rows][rep], length)
            w = (f[rows][rep] + shift)[hit]
            out.append((d[rows][rep][hit], w, w + 1))
        d, a, b = (np.concatenate(x) for x in zip(*out))
        return _table(known_rows(d, a, b, n))

    return spans.groupBy("kind", "part").applyInArrow(run, BLOCKS)


def removed(texts: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)``: the covered byte spans of every text and its other bytes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        d, a, b = _gather(right["block"], np.int64, np.int64, np.int64)
        order = np.lexsort((a, d))
        d, a, b = d[order], a[order], b[order]
        ids_out, n_out, spans_out, kept_out = [], [], [], []
        for ids, own in _texts(left["block"]):
            lo, hi = np.searchsorted(d, ids, "left"), np.searchsorted(d, ids, "right")
            for i, t, x, y in zip(ids.tolist(), own, lo.tolist(), hi.tolist()):
                spans, kept = [], t
                if x < y:
                    s, e = a[x:y], np.maximum.accumulate(b[x:y] + length - 1)
                    new = np.ones(len(s), bool)
                    new[1:] = s[1:] > e[:-1]
                    at = np.flatnonzero(new)
                    s, e = s[at].tolist(), e[np.append(at[1:], len(e)) - 1].tolist()
                    spans = [{"start": p, "end": q} for p, q in zip(s, e)]
                    kept = b"".join(t[p:q] for p, q in zip([0, *e], [*s, len(t)]))
                ids_out.append(i)
                n_out.append(len(t))
                spans_out.append(spans)
                kept_out.append(kept)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": pa.array(ids_out, pa.int64()), "n_bytes": pa.array(n_out, pa.int64()), "spans": pa.array(spans_out, kind), "kept": pa.array(kept_out, pa.binary())})

    return texts.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def each_row(docs: DataFrame, doc_id: str, text: str, dedup) -> DataFrame:
    """``dedup`` of the documents (one row an id, no nulls) as one row for every row of ``docs``.

    Rows without an id are left whole. Of rows that share an id the one of the least text takes part; rows equal to
    it share its result, others are left whole.
    """
    given = docs.select(named(doc_id).cast("long").alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("text"))
    odd = cut(given.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | F.col("doc_id").isNull()).select("doc_id"))
    if odd.isEmpty():
        return dedup(given)
    of_odd = given.filter(F.col("doc_id").isNotNull()).join(odd, "doc_id", "left_semi")
    once = given.filter(F.col("doc_id").isNotNull()).join(odd, "doc_id", "left_anti")
    held = of_odd.groupBy("doc_id").agg(F.min("text").alias("text"))
    out = cut(dedup(once.unionByName(held)))
    again = of_odd.unionByName(given.filter(F.col("doc_id").isNull())).withColumnRenamed("doc_id", "_id")
    known = out.join(held.withColumnRenamed("text", "_text"), "doc_id")
    whole = {"n_bytes": F.octet_length("text").cast("long"), "spans": F.array().cast(out.schema["spans"].dataType), "kept": F.encode("text", "UTF-8")}
    again = again.join(known, (F.col("_id") == F.col("doc_id")) & (F.col("text") == F.col("_text")), "left").select(F.col("_id").alias("doc_id"), *[F.coalesce(c, w).alias(c) for c, w in whole.items()])
    return out.join(odd, "doc_id", "left_anti").unionByName(again)


def dedup_substrings(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` for every document.

    ``spans`` are the maximal runs of bytes covered by a ``length``-byte string that also starts in a document
    with a smaller id; ``kept`` is what is left, joined. Null and empty texts have no bytes and no spans. Rows
    without an id, or with a repeated one, are treated as ``each_row`` says. An empty table gives an empty result.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    lean(docs.sparkSession)
    n = parts_by_size(docs)

    def dedup(given: DataFrame) -> DataFrame:
        texts = homes(given, n)
        # one plan from end to end: the shuffled texts serve both steps that read them, and spans are written once
        return removed(texts, compared(open_spans(texts, answers(anchors(given, length, n), n), length, n), length, n), length)

    return each_row(docs, doc_id, text, dedup)


def removal_digest(docs: DataFrame, length: int = 50) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` from the operator's spans and kept bytes."""
    out = dedup_substrings(docs, length)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
