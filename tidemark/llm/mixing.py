"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source gets a target number of words (its weight's share of all words, at most ``max_epochs`` times its
own words, the excess reshared by weight). Its documents, in a fixed shuffled order, then get virtual finish
times: words of the source up to and with this document (over the epochs so far) divided by the target. The copies of
all sources, ``max_epochs`` of each document, queue in one global order of virtual time, and the queue is cut where
the total budget, all words of the input, is reached: a copy is taken if more of it lies within the budget than
beyond. So the sum is off by half a document at most; a source is off its target by about its own documents' size
times what the others leave over.

No source is gathered in one task: running sums are taken inside small slices of the shuffled order, whose
offsets come from a pre-aggregated table of slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, named

#: The weights that sources take in turn.
WEIGHTS = (5, 2, 1)

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(named(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """``(src, total, weight, target)`` from ``(src, total)``, one row per source.

    Water filling: sources in order of cap over weight stop at their cap as long as the level that the rest
    would share is not below it. One row per source meets in a task here, never one per document.
    """
    by_name = Window.orderBy(F.col("src").isNull(), "src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("total") * float(max_epochs))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    before = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), F.col("src").isNull(), "src").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"all_w": F.sum("weight").over(everything), "all_t": F.sum("total").over(everything).cast("double")})
    s = s.withColumn("level", (F.col("all_t") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    rest_t = F.col("all_t") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    rest_w = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    return s.select("src", "total", "weight", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * rest_t / rest_w).alias("target"))


def _running(df: DataFrame, key: list[str], slice_col: str, order: list, value: str, out: str) -> DataFrame:
    """``out``: sum of ``value`` up to this row in the order (key, slice, order), with no whole key in one task."""
    sums = df.groupBy(*key, slice_col).agg(F.sum(value).alias("_v"))
    up_to = Window.partitionBy(*key or [F.lit(1)]).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(slice_col).alias("_slice"), F.coalesce(F.sum("_v").over(up_to), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*key, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col(slice_col) == F.col("_slice")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.withColumn("_in", F.sum(value).over(within)).join(starts, same).withColumn(out, F.col("_start") + F.col("_in")).drop("_in", "_start", "_slice", *[f"_{k}" for k in key])


def _time_slice(finish: Column, slices: int) -> Column:
    """The slice of a virtual time: even ones up to 2, then as many for each doubling, so they stay few."""
    late = 2 * slices + F.floor((F.log2(F.greatest(finish, F.lit(2.0))) - 1) * slices)
    return F.when(finish < 2, F.floor(finish * slices)).otherwise(late).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = 3, slice_rows: int = 2_000, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every document.

    Null texts and texts without words have size 0 and are taken 0 times. A null source is a source of its
    own, last in the order. Ties in the shuffled order (repeated rows of one id) fall to row contents alike, so
    rows that are repeated share one order key and are kept apart by their size only; reruns agree. Rows without
    an id take part alike. An empty table gives an empty result. Other columns are not read.
    """
    sized = cut(docs.select(named(doc_id).alias("doc_id"), named(source).alias("src"), n_words(text).alias("size")))
    n = sized.count()
    slices = max(1, min(-(-n // slice_rows), 1 << 16))
    per_source = sized.groupBy("src").agg(F.sum("size").alias("total"))
    targets = cut(source_targets(per_source, weights, max_epochs).select(F.col("src").alias("_src"), "total", "target"))
    hexed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    d = sized.withColumn("key", hexed).withColumn("slice", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 4294967296.0 * slices).cast("int"))
    d = _running(d, ["src"], "slice", ["key", "doc_id", "size"], "size", "upto")
    d = d.join(targets, F.col("src").eqNullSafe(F.col("_src"))).drop("_src")
    copies = d.filter((F.col("size") > 0) & (F.col("target") > 0)).select("doc_id", "src", "key", "size", "upto", "total", "target", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    copies = copies.withColumn("finish", (F.col("epoch") * F.col("total") + F.col("upto")) / F.col("target"))
    copies = copies.withColumn("slice", _time_slice(F.col("finish"), slices))
    budget = sized.agg(F.sum("size").alias("budget"))  # one row
    order = ["finish", F.col("src").isNull(), "src", "key", "doc_id", "size", "epoch"]
    # slices that begin past the budget have nothing to sort
    begun = copies.groupBy("slice").agg(F.sum("size").alias("_v"))
    begun = begun.withColumn("_before", F.coalesce(F.sum("_v").over(Window.partitionBy(F.lit(1)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = begun.join(F.broadcast(budget)).filter(F.col("_before") < F.col("budget")).agg(F.max("slice").alias("_last"))
    near = copies.join(F.broadcast(last)).filter(F.col("slice") <= F.col("_last")).drop("_last")
    taken = _running(near, [], "slice", order, "size", "queued").join(F.broadcast(budget)).filter(2 * F.col("queued") - F.col("size") <= 2 * F.col("budget"))
    # repeated rows of one id have the same copies; each is told apart by its place in its source's order
    taken = taken.groupBy("doc_id", "src", "upto").agg(F.sum("size").alias("taken")).select(F.col("doc_id").alias("_id"), F.col("src").alias("_src"), F.col("upto").alias("_upto"), "taken")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("src").eqNullSafe(F.col("_src")) & (F.col("upto") == F.col("_upto")) & (F.col("size") > 0)
    out = d.join(taken, same, "left")
    return out.select("doc_id", "size", F.col("total").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def oracle(weights=WEIGHTS, max_epochs: int = 3) -> str:
    """The same mix in DuckDB SQL (unique ids and non-null ids are assumed here)."""
    listed = ", ".join(f"{float(w)}::DOUBLE" for w in weights)
    return f"""
WITH d AS (SELECT doc_id, source AS src, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS key FROM documents),
s0 AS (SELECT src, sum(size)::BIGINT AS total FROM d GROUP BY src),
s1 AS (SELECT *, list_extract([{listed}], ((row_number() OVER (ORDER BY src IS NULL, src) - 1) % {len(weights)} + 1)::INT) AS w, total * {float(max_epochs)}::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, (sum(total) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM s1
       WINDOW b AS (ORDER BY cap / w, src IS NULL, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap <= level * w AS capped FROM s2),
s AS (SELECT src, total, CASE WHEN capped THEN cap ELSE w * (sum(total) OVER ()::DOUBLE - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target FROM s3),
r AS (SELECT d.doc_id, d.src, key, size, total, target, sum(size) OVER (PARTITION BY d.src ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN s ON d.src IS NOT DISTINCT FROM s.src),
c AS (SELECT *, (epoch * total + upto)::DOUBLE / target AS finish FROM r, range({max_epochs}) e(epoch) WHERE size > 0 AND target > 0),
q AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, src IS NULL, src, key, doc_id, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS waits FROM c),
-- a copy goes in while half of it or more still fits into the words that are left
t AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM q WHERE size <= 2 * ((SELECT sum(total) FROM s0) - waits) GROUP BY doc_id)
SELECT r.doc_id, size, total AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM r LEFT JOIN t ON r.doc_id = t.doc_id"""
