"""Hard-negative mining: a nearest-neighbour join over Voronoi cells.

Rows are integer vectors with a label. An anchor's positives are the rows of its label with the largest inner
products; the negatives of a positive are the rows of other labels with the largest inner products among those
within a window below the positive's.

One more component, the root of (largest squared norm - own squared norm), turns inner products into distances:
``|a|^2 + M - 2 a.y`` is the squared distance of the extended row to the extended anchor, whose component is 0.
Rows and anchors go to the cell of the nearest pivot; a pivot is an extended anchor. A cell's radius (over its
anchors) and the distances that its anchors still need bound which rows can serve it: by the triangle inequality
a row at distance r from the pivot lies within [r - radius, r + radius] of each anchor there. Rows are sent to
those buckets of cells alone, in blocks, and joined exactly there. A task holds one block of each side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, named, stored
from .whitening import by_dimension, integers

MAX_PIVOTS = 1024  # the driver and every task hold them; cells beyond only grow larger
ANCHORS_A_CELL = 64
ANCHORS = 4096  # anchors of one bucket and block
ROWS = 8192  # rows of one block
MOST = 1 << 56  # a hundred times this still is a long
SLACK = 1e-9  # of a squared distance: more than rounding can move it


@dataclass
class Cells:
    """Extended pivots by dimension, numbered through; ``most`` is the largest squared norm. The last cell of a
    dimension without a pivot is number -1 for all of them."""

    pivots: dict[int, np.ndarray]
    first: dict[int, int]
    most: float

    def squared(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        """Squared distances of rows (extended) or anchors to the pivots of their dimension."""
        p = self.pivots[x.shape[1]]
        x = x.astype(float)
        own = (x * x).sum(axis=1)
        rest = np.zeros(len(x)) if anchors else np.maximum(self.most - own, 0.0)
        return np.maximum((own + rest)[:, None] - 2 * (x @ p.T) + (p * p).sum(axis=1)[None, :], 0.0)

    def slack(self) -> float:
        return SLACK * max(self.most, 1.0)


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles where every partial sum is, else in longs or Python's integers.
    Those beyond MOST count as MOST."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0)) * a.shape[1]
    if top < 1 << 53:
        return (a.astype(float) @ x.astype(float).T).astype(np.int64)
    return a @ x.T if top < MOST else np.clip(a.astype(object) @ x.astype(object).T, -MOST, MOST).astype(np.int64)


def first_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _vectors(t: pa.Table, column: str = "x") -> np.ndarray:
    return t[column].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)


def _cells(rows: DataFrame) -> Cells:
    """Pivots: a bounded choice of anchors by hash, whatever the table's size."""
    sized = rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c)).alias("most"), F.count_if("anchor").alias("anchors")).first()
    n = max(1, min(MAX_PIVOTS, sized.anchors // ANCHORS_A_CELL))
    chosen = rows.filter("anchor").select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(n).collect()
    pivots: dict[int, list] = {}
    for r in chosen:
        pivots.setdefault(len(r.x), []).append(r.x)
    first, at = {}, 0
    for d, p in sorted(pivots.items()):
        first[d], at = at, at + len(p)
    return Cells({d: np.array(p, float) for d, p in pivots.items()}, first, float(sized.most or 0.0))


def _placed(rows: DataFrame, cells: Cells) -> DataFrame:
    """``rows`` with the cell and, for anchors, their distance to its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, reach = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            anchor = b.column("anchor").to_numpy(zero_copy_only=False)
            for d, at, x in by_dimension(b, "x"):
                for is_anchor in (False, True) if d in cells.pivots else ():
                    some = anchor[at] == is_anchor
                    far = cells.squared(x[some], is_anchor)
                    cell[at[some]] = far.argmin(axis=1) + cells.first[d]
                    if is_anchor:
                        reach[at[some]] = np.sqrt(far.min(axis=1) + cells.slack())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(reach)], [*b.schema.names, "cell", "reach"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, cell int, reach double")


def _buckets(cells: DataFrame) -> dict[int, tuple[int, int]]:
    """``cell -> (first bucket, number of buckets)``: small cells share a bucket, a large one has several."""
    out, bucket, room = {}, 0, ANCHORS
    for r in sorted(cells.select("cell", "anchors").collect()):
        if r.anchors > room and room < ANCHORS:
            bucket, room = bucket + 1, ANCHORS
        many = -(-r.anchors // ANCHORS)
        out[r.cell] = (bucket, many)
        bucket, room = (bucket + many, ANCHORS) if many > 1 else (bucket, room - r.anchors)
    return out


def _sent(rows: DataFrame, cells: Cells, radius: dict[int, float], least: dict[int, float], most: dict[int, float], buckets: dict[int, tuple[int, int]], blocks: int) -> DataFrame:
    """Each row once for each bucket with a cell that it might serve: one where it can lie at a distance between
    ``least`` and ``most`` of an anchor (cells without bounds are served by all rows of their dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places: list[np.ndarray] = []
            to: list[np.ndarray] = []
            for d, at, x in by_dimension(b, "x"):
                hit: dict[int, np.ndarray] = {}
                r = np.sqrt(cells.squared(x)) if d in cells.pivots else None
                here = [-1] if r is None else range(cells.first[d], cells.first[d] + r.shape[1])
                for g in here:
                    if g not in buckets or g not in most:
                        continue
                    slack = np.sqrt(cells.slack())
                    fits = np.ones(len(x), bool) if r is None else (r[:, g - cells.first[d]] - radius[g] <= most[g] + slack) & (r[:, g - cells.first[d]] + radius[g] >= least[g] - slack)
                    for k in range(buckets[g][0], buckets[g][0] + buckets[g][1]):
                        hit[k] = hit[k] | fits if k in hit else fits
                for k, fits in hit.items():
                    places.append(at[fits])
                    to.append(np.full(int(fits.sum()), k, np.int32))
            if places:
                out = b.take(pa.array(np.concatenate(places)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(to))], [*out.schema.names, "bucket"])

    sent = rows.select("row", "id", "label", "x").mapInArrow(run, f"row long, id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, x array<bigint>, bucket int")
    return sent.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("d", F.size("x"))


def _asked(anchors: DataFrame, buckets: dict[int, tuple[int, int]], blocks: int) -> DataFrame:
    """Each anchor in its bucket, once for each block of rows. Names begin with ``a_``, as both sides come of one table."""
    spread = F.create_map(*[F.lit(v) for c, (first, many) in buckets.items() for v in (c, F.struct(F.lit(first), F.lit(many)))])
    to = anchors.withColumn("_b", spread[F.col("cell")]).withColumn("bucket", (F.col("_b.col1") + F.pmod(F.xxhash64("row"), F.col("_b.col2"))).cast("int")).drop("_b")
    to = to.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("d", F.size("x"))
    return to.select(*[F.col(c).alias(f"a_{c}") for c in to.columns])


def _joined(sent: DataFrame, asked: DataFrame, run, kind: str) -> DataFrame:
    keys = ("d", "bucket", "block")
    return sent.groupBy(*keys).cogroup(asked.groupBy(*[f"a_{k}" for k in keys])).applyInArrow(run, kind)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` is ``(id, label, x, anchor)``: integer vectors. A negative's score lies within ``low`` to ``high`` percent
    of the positive's. Rows of another dimension have no inner product with an anchor and are neither. Every row stands
    for itself: rows that repeat an id or a vector can be positives of each other, and an anchor is never its own.
    """
    spark = rows.sparkSession
    none = "anchor_id {0}, positive_id {0}, rank int, negative_id {0}, positive_score long, negative_score long".format(rows.schema["id"].dataType.simpleString())
    numbered = stored(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "label", "x", "anchor"), "negatives-rows")
    cells = _cells(numbered)
    placed = stored(_placed(numbered, cells), "negatives-placed")
    discard(numbered)
    anchors = placed.filter("anchor").drop("anchor")
    held = anchors.groupBy("cell").agg(F.count(F.lit(1)).alias("anchors"), F.max("reach").alias("radius"))
    buckets, radius = _buckets(held), {r.cell: r.radius for r in held.collect()}
    if not buckets:
        return spark.createDataFrame([], none)
    blocks = max(1, -(-placed.count() // ROWS))
    ids, labels = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    top = f"anchor long, anchor_id {ids}, a_label {labels}, a_x array<bigint>, cell int, id {ids}, score long"

    def same(sent: pa.Table, asked: pa.Table) -> pa.Table:
        """Of each anchor the best rows of its label in this block, each with the anchor's own columns."""
        at: list[np.ndarray] = []
        place: list[np.ndarray] = []
        found: list[np.ndarray] = []
        if sent.num_rows and asked.num_rows:
            x, id_, row, label = _vectors(sent), sent["id"].to_numpy(), sent["row"].to_numpy(), sent["label"].to_numpy()
            a, a_row, a_label = _vectors(asked, "a_x"), asked["a_row"].to_numpy(), asked["a_label"].to_numpy()
            for value in np.unique(a_label):
                here, mine_ = np.flatnonzero(label == value), np.flatnonzero(a_label == value)
                for k in range(0, len(mine_), 256) if len(here) else ():
                    for i, scores in zip(mine_[k : k + 256], products(a[mine_[k : k + 256]], x[here])):
                        other = row[here] != a_row[i]
                        best = first_k(scores[other], id_[here][other], positives)
                        at.append(here[other][best])
                        found.append(scores[other][best])
                        place.append(np.full(len(best), i))
        some = np.concatenate(place).astype(np.int64) if place else np.zeros(0, np.int64)
        own = asked.take(pa.array(some))
        score = np.concatenate(found) if found else np.zeros(0, np.int64)
        near = sent["id"].take(pa.array(np.concatenate(at) if at else np.zeros(0, np.int64)))
        return pa.table([own["a_row"], own["a_id"], own["a_label"], own["a_x"], own["a_cell"], near, pa.array(score.tolist(), pa.int64())], ["anchor", "anchor_id", "a_label", "a_x", "cell", "id", "score"])

    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    best = lambda found: found.withColumn("_k", rank).filter(F.col("_k") <= positives)
    # what the home cell offers bounds how far an anchor has to look
    counts = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}
    home_blocks = F.create_map(*[F.lit(v) for c in buckets for v in (c, max(1, -(-counts.get(c, 0) // ROWS)))])
    home = placed.filter(F.col("cell").isin(list(buckets))).withColumn("d", F.size("x")).withColumn("bucket", F.col("cell")).withColumn("block", F.pmod(F.xxhash64("row"), home_blocks[F.col("cell")]).cast("int"))
    home = home.select("row", "id", "label", "x", "bucket", "block", "d")
    near = anchors.withColumn("d", F.size("x")).withColumn("bucket", F.col("cell")).withColumn("block", F.explode(F.sequence(F.lit(0), home_blocks[F.col("cell")] - 1)))
    near = near.select(*[F.col(c).alias(f"a_{c}") for c in near.columns])
    squared = F.aggregate("a_x", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    known = best(_joined(home, near, same, top)).groupBy("anchor").agg(F.max("cell").alias("cell"), F.max(squared).alias("own"), F.min("score").alias("worst"), F.count(F.lit(1)).alias("known"))
    bound = known.groupBy("cell").agg(F.max(F.sqrt(F.greatest(F.col("own") + cells.most - 2.0 * F.col("worst"), F.lit(0.0)))).alias("far"), F.sum(F.when(F.col("known") == positives, 1).otherwise(0)).alias("sure"))
    size = {r.cell: r.anchors for r in held.collect()}
    far = {c: float("inf") for c in buckets} | {r.cell: r.far for r in bound.collect() if r.sure == size[r.cell]}
    found = _joined(_sent(placed, cells, radius, dict.fromkeys(far, 0.0), far, buckets, blocks), _asked(anchors, buckets, blocks), same, top)
    wanted = best(found).groupBy("anchor", "anchor_id", "a_label", "cell").agg(F.first("a_x").alias("x"), F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("p"))
    wanted = stored(wanted.select(F.col("anchor").alias("row"), F.col("anchor_id").alias("id"), F.col("a_label").alias("label"), "cell", "x", F.col("p.id").alias("ids"), F.transform("p.s", lambda s: -s).alias("scores")), "negatives-positives")
    # negatives lie between two distances of an anchor, so a cell needs rows between two distances only
    own = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    to = lambda score: F.sqrt(F.greatest(F.col("own") + cells.most - 2.0 * score, F.lit(0.0)))
    spans = wanted.withColumn("own", own).withColumn("score", F.explode("scores")).filter(F.col("score") >= 0)
    spans = spans.groupBy("cell").agg(F.min(to(F.col("score") * (high / 100))).alias("least"), F.max(to(F.col("score") * (low / 100))).alias("most")).collect()
    least, most = {r.cell: r.least for r in spans}, {r.cell: r.most for r in spans}

    def other(sent: pa.Table, asked: pa.Table) -> pa.Table:
        """Of each anchor and positive the best rows of other labels within the window in this block."""
        out: list[tuple] = []
        if sent.num_rows and asked.num_rows:
            x, id_, label = _vectors(sent), sent["id"].to_numpy(), sent["label"].to_numpy()
            a, a_label = _vectors(asked, "a_x"), asked["a_label"].to_numpy()
            near, given = asked["a_ids"].to_pylist(), asked["a_scores"].to_pylist()
            anchor, anchor_id = asked["a_row"].to_pylist(), asked["a_id"].to_pylist()
            for k in range(0, len(a), 256):
                for i, scores in enumerate(products(a[k : k + 256], x), k):
                    lowest, highest = min((s for s in given[i] if s >= 0), default=1), max(given[i])
                    some = np.flatnonzero((label != a_label[i]) & (100 * scores >= low * lowest) & (100 * scores <= high * highest))
                    for n, (p, s) in enumerate(zip(near[i], given[i])):
                        at = some[(100 * scores[some] >= low * s) & (100 * scores[some] <= high * s)]
                        at = at[first_k(scores[at], id_[at], negatives)]
                        out += [(anchor[i], anchor_id[i], n, p, s, v, w) for v, w in zip(id_[at].tolist(), scores[at].tolist())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, kinds)], names=["anchor", "anchor_id", "n", "positive_id", "positive_score", "negative_id", "negative_score"])

    key = pa.int32() if ids == "int" else pa.string() if ids == "string" else pa.int64()
    kinds = [pa.int64(), key, pa.int32(), key, pa.int64(), key, pa.int64()]
    asked = _asked(wanted, buckets, blocks)
    found = _joined(_sent(placed, cells, radius, least, most, buckets, blocks), asked, other, f"anchor long, anchor_id {ids}, n int, positive_id {ids}, positive_score long, negative_id {ids}, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "n").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """The registered mining: entries floored at 1/256, anchors where ``vec_id`` is divisible by 50, labels moved on
    where it is divisible by 7.

    Rows with a null id, label or vector, or a null, non-finite or huge entry (2^53 and beyond when scaled) take no part;
    ties go to the smaller id, rows of one id are judged each, an empty table or one without anchors gives no rows, and
    other columns are not read. Inner products beyond 2^56 count as 2^56.
    """
    rows = integers(embeddings.select("vec_id", "embedding", "label").filter("vec_id IS NOT NULL AND label IS NOT NULL").filter(F.size("embedding") > 0), "embedding", 256.0)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast(embeddings.schema["label"].dataType)
    return mine(rows.select(F.col("vec_id").alias("id"), moved.alias("label"), "x", (F.col("vec_id") % 50 == 0).alias("anchor")))


def oracle() -> str:
    """The same in DuckDB SQL: all rows against the anchors."""
    return """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, CAST(list_inner_product(a.x, e.x) AS BIGINT) AS score FROM e a JOIN e ON a.vec_id % 50 = 0 AND a.r <> e.r),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= 5),
q AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.n ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM q WHERE rank <= 3"""
