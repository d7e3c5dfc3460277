"""b-bit MinHash near-duplicates: band candidates, bit-count estimates, exact confirmation, components.

Items have an id of any orderable type and a text. An item's set is the distinct 5-word shingles of its
lower-cased text. The steps:

1. One pass over the texts gives each item its set's size, a BLAKE2b digest of its whole word sequence, the band
   keys of its minima and its signature: the low 2 bits of each of the minima, packed.
2. Items of the same words in the same order are one class, held by its least id; copies are never paired.
   Equal sets in another order are links like any others.
3. Classes that share a band key meet at the least id of the key's bucket (a star, not all pairs). Pairs whose
   bit counts leave no doubt are dropped; all others are confirmed on full sets. The pairs of a leader with many
   are dealt by salt.
4. Where a bucket still spans several components, its members of different components are compared in blocks
   by bit counts, and what may reach the threshold is confirmed likewise; in buckets where that is far more
   pairs than rows, full sets are held against each other in place, each pair at most once a bucket, until the
   bucket is connected. Blocks are bounded by rows and by shingles.
5. Components of the confirmed links.

Nothing is capped: a pair is given up only if no band agrees or its bit counts are ``MARGIN`` standard
deviations below the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, lean, named
from .components import components
from .textkit import Shingler, blocks, mix64

BITS = 2
MARGIN = 5.5
BLOCK = 8192  # rows of a bucket that one task compares with as many others
GROUP = 4096  # rows, about, of small buckets that one call compares, each bucket for itself
SHINGLES = 1 << 21  # shingles, about, of the rows of a bucket whose full sets one task compares with as many others
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Params(NamedTuple):
    """Bands of rows; a pair of similarity s shares a band with probability 1 - (1 - s**rows)**bands."""

    bands: int = 32
    rows: int = 4
    num: int = 75  # the threshold is num/100 exactly, by integers
    width: int = 5

    @property
    def recall(self) -> float:
        return 1 - (1 - (self.num / 100) ** self.rows) ** self.bands

    @property
    def least_estimate(self) -> float:
        """Estimates below this are hopeless: the threshold less MARGIN standard deviations of an estimate."""
        t, by_luck, k = self.num / 100, 2.0**-BITS, self.bands * self.rows
        match = t + (1 - t) * by_luck
        return (match - MARGIN * math.sqrt(match * (1 - match) / k) - by_luck) / (1 - by_luck)


def tuned(threshold: float, rows: int, recall: float) -> int:
    """The least number of bands of ``rows`` with which a pair at the threshold meets with ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class Signer:
    """Minima of ``bands * rows`` hash functions x -> a*x + b modulo 2**32 over a set's hashes."""

    def __init__(self, p: Params):
        k = p.bands * p.rows
        seeds = mix64(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.p, self.k = p, k
        self.a = ((seeds[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]
        self.b = (seeds[k:] >> np.uint64(32)).astype(np.uint32)[:, None]
        self.low = np.uint32((1 << BITS) - 1)
        self.shift = np.arange(0, 64, BITS, dtype=np.uint64)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        out = np.full(self.k, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 1024):
            y = self.a * x[None, i : i + 1024]
            y += self.b
            np.minimum(out, y.min(axis=1), out=out)
        return out

    def bands(self, minima: np.ndarray) -> np.ndarray:
        """(n, k) minima -> (n, bands) keys, different for each band."""
        m = minima.reshape(len(minima), self.p.bands, self.p.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.p.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), m.shape[:2]).copy()
        for r in range(self.p.rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
        return key.view(np.int64)

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """(n, k) minima -> (n, words) uint64 of their low bits."""
        low = (minima & self.low).astype(np.uint64)
        pad = -low.shape[1] % (64 // BITS)
        low = np.pad(low, ((0, 0), (0, pad))).reshape(len(low), -1, 64 // BITS)
        return np.bitwise_or.reduce(low << self.shift, axis=2)


def estimate(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Similarity from packed signatures, corrected for low bits that agree by luck."""
    d = x ^ y
    d = (d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)
    match = 1.0 - np.bitwise_count(d).sum(axis=-1, dtype=np.int64) / k
    by_luck = 2.0**-BITS
    return (match - by_luck) / (1 - by_luck)


def reaches(inter: int, a: int, b: int, num: int) -> bool:
    return 100 * inter >= num * (a + b - inter)


def digest(text: bytes) -> bytes:
    """128 bits of BLAKE2b of a text's words, lower-cased, one space between."""
    return hashlib.blake2b(b" ".join(text.translate(_LOWER).split()), digest_size=16).digest()


def features(items: DataFrame, p: Params, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, n, f, sig, bands)`` of every item; ``f``, ``sig`` and ``bands`` are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, signer = Shingler(p.width), Signer(p)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for i, block in blocks(texts):
                sets = list(cutter.sets(block))
                n = np.fromiter(map(len, sets), np.int32, len(sets))
                full = n > 0
                minima = np.stack([signer.minima(s) if len(s) else np.zeros(signer.k, np.uint32) for s in sets])
                f = [digest(t) if ok else None for t, ok in zip(block, full)]
                sig = [bytes(r) if ok else None for r, ok in zip(signer.packed(minima), full)]
                keys = [r if ok else None for r, ok in zip(signer.bands(minima), full)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(block)), pa.array(n), pa.array(f, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "f", "sig", "bands"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(id_col, text_col).mapInArrow(run, f"id {kind}, n int, f binary, sig binary, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """``(a, b, ok)``: whether the full sets of a pair reach the threshold. ``texts``: (id, text).

    Where a ``b`` has very many pairs, its text goes to several salts, each with some of them.
    """
    t = texts.select(F.col("id").alias("_id"), "text")
    pairs = cut(pairs)
    leaders = cut(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_pairs")))
    led = leaders.join(t.withColumnsRenamed({"_id": "b", "text": "tb"}), "b")
    both = hot_join(pairs, led, "b", "_pairs", "a").join(t.withColumnsRenamed({"_id": "a", "text": "ta"}), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Shingler(p.width)
        known: dict[bytes, np.ndarray] = {}

        def sets_of(texts: list[bytes]) -> list[np.ndarray]:
            new = list({t: None for t in texts if t not in known})
            for _, block in blocks(new):
                known.update(zip(block, cutter.sets(block)))
            return [known[t] for t in texts]

        for big in batches:
            for i in range(0, big.num_rows, 256):
                b = big.slice(i, 256)
                if sum(map(len, known)) > 8 << 20:
                    known.clear()
                left = sets_of(b.column(2).cast(pa.binary()).to_pylist())
                right = sets_of(b.column(3).cast(pa.binary()).to_pylist())
                ok = [reaches(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), p.num) for x, y in zip(left, right)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}, ok boolean")


def hopeful(pairs: DataFrame, sigs: DataFrame, p: Params) -> DataFrame:
    """The pairs ``(a, b)`` whose sizes and signature bit counts may reach the threshold. ``sigs``: (id, n, sig)."""
    k, least = p.bands * p.rows, p.least_estimate
    s = sigs.select(F.col("id").alias("_id"), "n", "sig")
    both = pairs.join(s.withColumnsRenamed({"_id": "a", "n": "na", "sig": "sa"}), "a").join(s.withColumnsRenamed({"_id": "b", "n": "nb", "sig": "sb"}), "b")
    both = both.filter((F.lit(100) * F.least("na", "nb").cast("long") >= F.lit(p.num) * F.greatest("na", "nb").cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in (2, 3))
                keep = pa.array(estimate(x, y, k) >= least)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def _blocks_of(members: DataFrame, shingles: int | None = None, groups: int = 0) -> DataFrame:
    """Members with the pair of blocks (lo, hi) in which they are compared; a bucket of up to BLOCK rows (and of up
    to that many ``shingles``) is one. ``at``: the bucket, or one of so many ``groups`` for a bucket of one block."""
    need = F.ceil(F.count(F.lit(1)) / BLOCK)
    sizes = members.groupBy("key").agg((F.greatest(need, F.ceil(F.sum("n") / shingles)) if shingles else need).cast("int").alias("_nb"))
    m = members.join(sizes, "key")
    m = m.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    if groups:
        m = m.withColumn("at", F.when(F.col("_nb") > 1, F.struct(F.lit(True).alias("alone"), F.col("key").alias("no"))).otherwise(F.struct(F.lit(False).alias("alone"), F.pmod(F.xxhash64("key"), F.lit(groups)).alias("no"))))
    return m.withColumns({"lo": F.least("blk", "_o"), "hi": F.greatest("blk", "_o")}).drop("_nb", "_o")


class _Bucket:
    """Two blocks of one bucket (or one block with itself), row by row: which rows of other components may still
    reach the threshold. ``label`` is each row's component and may be joined on the way, which leaves less to do;
    no list of pairs is ever held."""

    def __init__(self, t: pa.Table, p: Params):
        self.p, self.k, self.least = p, p.bands * p.rows, p.least_estimate
        if "sig" in t.column_names:
            self.sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint64).reshape(t.num_rows, -1)
        self.n = t["n"].to_numpy().astype(np.int64)
        code: dict = {}
        self.label = np.array([code.setdefault(repr(x), len(code)) for x in t["comp"].to_pylist()])
        blk, lo, hi = t["blk"].to_numpy(), t["lo"][0].as_py(), t["hi"][0].as_py()
        self.same = lo == hi
        self.left = np.flatnonzero(blk == lo)
        self.right = self.left if self.same else np.flatnonzero(blk == hi)

    def rows(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row, rows that it may be linked to, best estimates first)."""
        for at, i in enumerate(self.left.tolist()):
            js = self.right[at + 1 :] if self.same else self.right
            js = js[self.label[js] != self.label[i]]
            js = js[100 * np.minimum(self.n[js], self.n[i]) >= self.p.num * np.maximum(self.n[js], self.n[i])]
            if len(js):
                e = estimate(self.sig[js], self.sig[i][None, :], self.k)
                ok = np.flatnonzero(e >= self.least)
                if len(ok):
                    yield i, js[ok[np.argsort(-e[ok], kind="stable")]]

    def join(self, i: int, j: int) -> None:
        self.label[self.label == self.label[j]] = self.label[i]


def _across(members: DataFrame, p: Params, kind: str) -> DataFrame:
    """``(x, y, dense)``: pairs of members ``(key, id, comp, n, sig)`` of one bucket but of different components
    whose bit counts may reach the threshold; or, where such pairs outnumber the rows four times, the bucket's
    key in ``dense`` instead, so that the rows made stay in proportion to the rows read."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        xs, ys, most = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 4 * t.num_rows
        for row, others in _Bucket(t, p).rows():
            xs.append(np.full(len(others), row))
            ys.append(others)
            most -= len(others)
            if most < 0:
                none = pa.nulls(1, t["id"].type)
                return pa.table({"x": none, "y": none, "dense": t["key"].slice(0, 1)})
        i, j = np.concatenate(xs), np.concatenate(ys)
        return pa.table({"x": t["id"].take(pa.array(i)), "y": t["id"].take(pa.array(j)), "dense": pa.nulls(len(i), pa.int64())})

    return _blocks_of(members).groupBy("key", "lo", "hi").applyInArrow(run, f"x {kind}, y {kind}, dense long")


def _estimated_links(members: DataFrame, tried: DataFrame, texts: DataFrame, p: Params, kind: str) -> DataFrame:
    """``(a, b)``: links between components of buckets, by bit counts and then full sets. ``tried``: pairs (a, b) to pass over."""
    met = cut(_across(members, p, kind))
    more = met.filter(F.col("dense").isNull()).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    extra = confirm(more.join(tried.select("a", "b"), ["a", "b"], "left_anti"), texts, p).filter("ok").select("a", "b")
    dense = met.filter(F.col("dense").isNotNull()).select(F.col("dense").alias("key")).distinct()
    if not dense.isEmpty():
        extra = extra.unionByName(_class_links(members.join(dense, "key", "left_semi").select("key", "id", "comp"), texts, p, kind))
    return extra


def _meeting(members: DataFrame, texts: DataFrame, p: Params, kind: str) -> DataFrame:
    """``(id, comp, n, s)`` of those members ``(key, id, comp)`` that can have a link to another component: the set's
    size, and those of its shingles that members of several components hold.

    ``s`` is in one order, the shingles of the fewest members first. Two sets of different components meet in
    shingles of ``s`` alone. If they reach the threshold they share one of the first |s| - ceil(num/100 * size) + 1 of
    each: were none of a set's first so many in the other, too few would be left. So sets with words enough of their
    own have no link, however common their other shingles are.
    """
    one = members.select("id", "comp").dropDuplicates(["id"]).join(texts, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Shingler(p.width)
        for batch in batches:
            for i, block in blocks(batch.column(2).cast(pa.binary()).to_pylist()):
                sets = [x.view(np.int64) for x in cutter.sets(block)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(block)), batch.column(1).slice(i, len(block)), pa.array(sets, pa.list_(pa.int64()))], ["id", "comp", "s"])

    sets = cut(one.mapInArrow(run, f"id {kind}, comp {kind}, s array<long>"))
    each = sets.select("id", "comp", F.size("s").alias("n"), F.explode("s").alias("h"))
    met = each.groupBy("h").agg(F.count(F.lit(1)).alias("_c"), F.min("comp").alias("_x"), F.max("comp").alias("_y")).filter(F.col("_x") != F.col("_y")).select("h", "_c")
    held = each.join(met, "h").groupBy("id", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("_c", "h"))).alias("s"))
    first = (F.size("s") + 1 - F.ceil(F.col("n") * F.lit(p.num) / F.lit(100))).cast("int")
    held = cut(held.withColumn("first", first).filter(F.col("first") > 0).withColumn("s", F.col("s.h")))
    keyed = held.select("id", "comp", F.explode(F.slice("s", F.lit(1), F.col("first"))).alias("h"))
    still = keyed.groupBy("h").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).filter(F.col("_x") != F.col("_y")).select("h")
    ids = keyed.join(still, "h", "left_semi").select("id").distinct()
    return held.join(ids, "id", "left_semi").select("id", "comp", "n", "s")


def _links(members: DataFrame, sets: DataFrame, p: Params, kind: str) -> DataFrame:
    """``(a, b)``: links between members ``(key, id)`` of a bucket with their ``sets`` ``(id, n, s, comp)``, enough of
    them to connect what the bucket's links connect.

    Sets meet where they share one of their rarest shingles, as in ``_meeting``; all that a set meets are
    counted at once, and what is connected by then is passed over, so no list of pairs leaves the task. About GROUP
    rows of small buckets are compared at a time, each bucket for itself: a shingle counts with its bucket's key.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.select(["key", "id", "comp", "n", "s", "blk", "lo", "hi"]).combine_chunks()
        bucket = _Bucket(t, p)
        label, n = bucket.label, bucket.n
        held = np.asarray(t["s"].combine_chunks().value_lengths()).astype(np.int64)
        shingles = t["s"].combine_chunks().flatten().to_numpy().view(np.uint64)
        shingles = mix64(shingles + np.repeat(mix64(t["key"].to_numpy().view(np.uint64)), held))
        code, count = np.unique(shingles, return_inverse=True, return_counts=True)[1:]
        begin = np.cumsum(held) - held
        owner = np.repeat(np.arange(len(n)), held)
        order = np.lexsort((code, count[code], owner))
        place = np.arange(len(order)) - np.repeat(begin, held)
        most = np.maximum(held - -(-p.num * n // 100) + 1, 0)
        first = order[place < np.repeat(most, held)]
        firsts = np.split(code[first], np.cumsum(most)[:-1])
        first = first[np.argsort(code[first], kind="stable")]
        holders, low, high = owner[first], *(np.searchsorted(code[first], np.arange(len(count)), side) for side in ("left", "right"))
        other = np.ones(len(n), bool)
        if not bucket.same:
            other[bucket.left] = False
        here = np.zeros(len(count), bool)
        largest = np.bincount(label).argmax()
        xs, ys = [], []
        for i in bucket.left[label[bucket.left] != largest].tolist() if bucket.same else bucket.left.tolist():
            if not len(firsts[i]):
                continue
            js = np.concatenate([holders[low[c] : high[c]] for c in firsts[i].tolist()])
            js = js[(label[js] != label[i]) & other[js]]
            js = np.unique(js[100 * np.minimum(n[js], n[i]) >= p.num * np.maximum(n[js], n[i])])
            if not len(js):
                continue
            here[code[begin[i] : begin[i] + held[i]]] = True
            z = held[js]
            at = np.cumsum(z) - z
            both = np.add.reduceat(here[code[np.arange(z.sum()) + np.repeat(begin[js] - at, z)]].astype(np.int64), at)
            here[code[begin[i] : begin[i] + held[i]]] = False
            for j in js[100 * both >= p.num * (n[js] + n[i] - both)].tolist():
                if label[i] != label[j]:
                    bucket.join(i, j)
                    xs.append(i)
                    ys.append(j)
        return pa.table({"a": t["id"].take(pa.array(xs, pa.int64())), "b": t["id"].take(pa.array(ys, pa.int64()))})

    groups = -(-members.count() // GROUP) or 1
    return _blocks_of(members.join(sets, "id"), SHINGLES, groups).groupBy("at", "lo", "hi").applyInArrow(run, f"a {kind}, b {kind}")


def _class_links(members: DataFrame, texts: DataFrame, p: Params, kind: str) -> DataFrame:
    """``(a, b)``: links between components of buckets of members ``(key, id, comp)``, by full sets.

    Members of one size that hold the same shingles in common with other components (``s`` of ``_meeting``) have the
    same similarity to each other and the same to any other member, as far as components differ. So they are compared
    as one, the least of them, and all are linked with it if that is near one more of its own kind or any other.
    Digests only gather the kinds; their sets are held against each other.
    """
    sets = _meeting(members, texts, p, kind).withColumn("d", F.md5(F.concat_ws(",", F.col("n").cast("string"), F.col("s").cast("array<string>"))))
    sets = cut(sets)
    kinds = sets.groupBy("d").agg(F.count(F.lit(1)).alias("_pairs"), F.min_by(F.struct("id", "n", "s"), "id").alias("r"))
    of = hot_join(sets, cut(kinds), "d", "_pairs", "id").withColumn("rep", F.when((F.col("n") == F.col("r.n")) & (F.col("s") == F.col("r.s")), F.col("r.id")).otherwise(F.col("id")))
    of = cut(of.select("id", "rep", "comp"))
    own = 100 * F.size("s") >= F.lit(p.num) * (2 * F.col("n") - F.size("s"))
    spread = of.groupBy("rep").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y"))
    # a kind's label is a component's only where all its members are connected or near each other
    label = F.struct((own | (F.col("_x") == F.col("_y"))).alias("whole"), F.when(own | (F.col("_x") == F.col("_y")), F.col("_x")).otherwise(F.col("id")).alias("of"))
    kinds = sets.join(spread.withColumnRenamed("rep", "id"), "id").select("id", "n", "s", own.alias("own"), label.alias("comp"))
    # an id has a key a band at most, so its keys travel as one row
    keys = members.groupBy("id").agg(F.collect_list("key").alias("keys"))
    rest = keys.join(of, "id").select(F.explode("keys").alias("key"), F.col("rep").alias("id")).distinct()
    # buckets with the very same members need be compared once
    once = rest.groupBy("key").agg(F.count(F.lit(1)).alias("_c"), F.min("id").alias("_m"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("_s")).filter(F.col("_c") > 1).groupBy("_c", "_m", "_s").agg(F.min("key").alias("key")).select("key")
    links = cut(_links(cut(rest.join(once, "key", "left_semi")), kinds.drop("own"), p, kind))
    near = links.select(F.col("a").alias("rep")).union(links.select("b")).union(kinds.filter("own").select("id")).distinct()
    return links.unionByName(of.filter(F.col("id") != F.col("rep")).join(near, "rep", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b")))


def near_components(items: DataFrame, p: Params = Params(), id_col: str = "id", text_col: str = "text", unique: bool = False, rarest: bool = False) -> DataFrame:
    """``(id, n, component)`` of every item: its set's size and the least id that it reaches by links.

    Items with empty sets (null, empty or blank texts) are alone. Rows that share an id are one item that holds
    each of their texts, and each gets a row. Rows with a null id get a null component and link nothing. An
    empty table gives an empty result; other columns are not read. ``unique`` says that no id is repeated;
    ``rarest``, that members of open buckets are first reduced to those with a rare shingle in common with another
    component, which suits short items that hold parts of very common passages.
    """
    lean(items.sparkSession)
    kind = items.schema[id_col].dataType.simpleString()
    texts = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    feats = cut(features(texts, p))
    texts = texts.filter(F.col("id").isNotNull())
    full = feats.filter((F.col("n") > 0) & F.col("id").isNotNull())
    classes = full.groupBy("f").agg(F.min("id").alias("rep"))
    same = None  # links between the classes of one id's texts
    again = None if unique else cut(full.groupBy("id").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > 1).select("id"))
    if not unique and not again.isEmpty():
        repeated = full.join(again, "id", "left_semi").dropDuplicates(["id", "f"])
        full = full.join(again, "id", "left_anti").unionByName(repeated)
        texts = texts.join(again, "id", "left_anti").unionByName(texts.join(again, "id", "left_semi").distinct())
        same = repeated.join(classes, "f").filter(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    held = full.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    keyed = held.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("_last")).filter(F.col("lead") != F.col("_last")).select("key", "lead")
    members = cut(keyed.join(shared, "key"))
    sigs = held.select("id", "n", "sig")
    star = members.filter(F.col("id") != F.col("lead")).select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    tried = cut(confirm(hopeful(star, sigs, p), texts, p))
    links = tried.filter("ok").select("a", "b")
    links = links if same is None else links.unionByName(same)
    comp = cut(components(links))
    # buckets that still span several components
    labelled = members.join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    open_keys = labelled.groupBy("key").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).filter(F.col("_x") != F.col("_y")).select("key")
    rest = cut(labelled.join(open_keys, "key", "left_semi"))
    if not rest.isEmpty():
        if rarest:
            extra = _class_links(rest, texts, p, kind)
        else:
            # buckets with the very same members need be compared once
            once = rest.groupBy("key").agg(F.count(F.lit(1)).alias("_c"), F.min("id").alias("_m"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("_s")).groupBy("_c", "_m", "_s").agg(F.min("key").alias("key")).select("key")
            extra = _estimated_links(cut(rest.join(once, "key", "left_semi").join(sigs, "id")), tried, texts, p, kind)
        comp = cut(components(links.unionByName(extra)))
    class_of = classes.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").select("f", F.coalesce("component", "rep").alias("component"))
    return feats.select("id", "n", "f").join(class_of, "f", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def near_duplicates(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: one row a document; the least id of each group is kept.

    Rows without an id have no component and are kept; rows that share an id are one document of several texts.
    """
    out = near_components(docs.select(named(doc_id).alias("id"), named(text).alias("text")), p)
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
