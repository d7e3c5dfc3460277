"""Approximate nearest neighbours by a hash-prefix forest (largest inner product).

Vectors lie in shards of a bounded number of rows. A shard keeps, for each tree, the sorted array of its
vectors' long hash strings (signs of random projections; vectors shorter than the shard's longest get one more
component, so that angles order as inner products do). A query descends each tree to its longest matching
prefix; all trees then ascend together, level by level, until their ranges of equal prefixes hold enough
candidates. Candidates are scored exactly on the original vectors and each query's best over all shards stay.

Queries come in blocks too, so a task holds one shard and one block of queries, however many of either there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import named

TREES = 48
BITS = 20
SHARE = 1.3  # candidates (over all trees, repeats counted) that end the ascent, as a share of a shard's rows
SHARD_ROWS = 16384
QUERY_ROWS = 4096


class Forest:
    """The sorted hash strings of one shard's vectors (rows of a float array)."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11):
        self.v, self.bits = vectors, bits
        norms = (vectors * vectors).sum(axis=1)
        self.most = float(norms.max(initial=0.0))
        self.planes = np.random.default_rng(seed).normal(size=(vectors.shape[1] + 1, trees * bits))
        code = self._codes(np.column_stack([vectors, np.sqrt(np.maximum(self.most - norms, 0.0))]))
        self.order = np.argsort(code, axis=0, kind="stable")
        self.sorted = np.take_along_axis(code, self.order, axis=0)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        powers = (1 << np.arange(self.bits)[::-1]).astype(np.int64)
        out = [((x[i : i + 2048] @ self.planes) > 0).reshape(-1, self.planes.shape[1] // self.bits, self.bits) @ powers for i in range(0, len(x), 2048)]
        return np.concatenate(out) if out else np.zeros((0, self.planes.shape[1] // self.bits), np.int64)

    def ranges(self, queries: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and tree the range of the sorted array that the ascent has reached when the trees
        together hold ``enough`` entries: (queries, trees) starts and ends."""
        code = self._codes(np.column_stack([queries, np.zeros(len(queries))]))
        lo, hi = np.zeros(code.shape, np.int64), np.zeros(code.shape, np.int64)
        open_ = np.ones(len(queries), bool)
        for depth in range(self.bits, -1, -1):
            up = self.bits - depth
            rows = np.flatnonzero(open_)
            if not len(rows):
                break
            prefix = code[rows] >> up
            for t in range(code.shape[1]):
                lo[rows, t] = np.searchsorted(self.sorted[:, t], prefix[:, t] << up, "left")
                hi[rows, t] = np.searchsorted(self.sorted[:, t], (prefix[:, t] + 1) << up, "left")
            open_[rows] = (hi[rows] - lo[rows]).sum(axis=1) < enough
        return lo, hi

    def search(self, queries: np.ndarray, enough: int):
        """For each query the rows that are candidates and their inner products, right but for rounding."""
        lo, hi = self.ranges(queries, enough)
        seen = np.zeros(len(self.v), bool)
        for q, a, b in zip(queries, lo, hi):
            for t in np.flatnonzero(b > a).tolist():
                seen[self.order[a[t] : b[t], t]] = True
            rows = np.flatnonzero(seen)
            seen[rows] = False
            yield rows, self.v[rows] @ q


def exact_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order, so equal vectors have equal ones wherever they stand."""
    return (vectors * query).sum(axis=1)


def contenders(scores: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places of all that can be among the k largest if each score is off by up to half of ``slack``."""
    return np.flatnonzero(scores >= np.partition(scores, -k)[-k] - slack) if len(scores) > k else np.arange(len(scores))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def usable(vectors: DataFrame, vec_id: str, column: str) -> DataFrame:
    """``(vec_id, v, dim)`` of the vectors that take part: not null, not zero, all components finite."""
    v = named(column)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    ok = vectors.filter(named(vec_id).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return ok.select(named(vec_id).alias("vec_id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"))


def search(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", column: str = "embedding", trees: int = TREES, share: float = SHARE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each vector for which ``is_query`` holds.

    Queries are vectors of the table itself and never find rows of their own id. Fewer than k candidates are all
    returned; a shard always yields at least k if it has them. Vectors of different dimensions have no inner product
    and lie in shards apart: a query finds those of its own dimension. Rows that repeat an id are candidates each; a
    query that is repeated is asked once for each dimension. An empty table gives an empty result; other columns are not read.
    """
    ok = usable(vectors, vec_id, column)
    sizes = ok.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"), F.ceil(F.sum(F.when(is_query, 1).otherwise(0)) / query_rows).cast("int").alias("blocks")).filter("blocks > 0")
    asked = ok.filter(is_query).groupBy("vec_id", "dim").agg(F.min("v").alias("v")).join(sizes, "dim")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    rows = ok.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")).withColumn("block", every("blocks"))
    queries = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("blocks")).cast("int")).withColumn("shard", every("shards"))
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("vec_id", "v", "dim", "shard", "block")])  # both sides come from one table

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"query_id": left.schema.field("vec_id").type, "vec_id": left.schema.field("vec_id").type, "score": pa.float64()}
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], kind) for c, kind in kinds.items()})
        flat = lambda t, c: t[c].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        left = left.sort_by("vec_id")
        ids, qs = left["vec_id"].to_numpy(), right["q_vec_id"].to_numpy()
        forest = Forest(flat(left, "v"), trees)
        enough = max(8 * (k + 1), int(share * len(ids)))
        out_q, out_v, out_s = [], [], []
        asked, slack = flat(right, "q_v"), 8 * forest.v.shape[1] * np.finfo(float).eps * float(np.sqrt(forest.most))
        for q, v, (at, scores) in zip(qs, asked, forest.search(asked, enough)):
            other = ids[at] != q
            at = at[other][contenders(scores[other], k, slack * float(np.sqrt(v @ v)))]
            scores = exact_products(forest.v[at], v)
            top = best(ids[at], scores, k)
            out_q.append(np.full(len(top), q))
            out_v.append(ids[at[top]])
            out_s.append(scores[top])
        return pa.table({"query_id": pa.array(np.concatenate(out_q), kinds["query_id"]), "vec_id": pa.array(np.concatenate(out_v), kinds["vec_id"]), "score": np.concatenate(out_s)})

    kind = vectors.schema[vec_id].dataType.simpleString()
    found = rows.groupBy("dim", "shard", "block").cogroup(queries.groupBy("q_dim", "q_shard", "q_block")).applyInArrow(run, f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame) -> DataFrame:
    """The registered search: queries are the rows whose id is divisible by 20."""
    return search(embeddings, F.col("vec_id") % 20 == 0)
