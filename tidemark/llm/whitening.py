"""Embedding whitening: a compensated covariance over all distinct vectors, its eigenvectors, and the projections.

Vectors are integers (a registered query scales and floors the embeddings), so that counts, sums and deviations
are exact. Every distinct vector counts once. Centred outer products are accumulated in double-double: products
and sums are split by error-free transformations into a rounded part and its exact error, and tasks hand on high
and low parts, which are merged in the order of the tasks. What a task or the driver holds is a square of the
dimension, however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, named, stored
from .eigen import symmetric_eigen

LANES = 16384  # products that are accumulated side by side: rows of a batch go to lanes by turns
PIECE = 4096  # entries of the matrix in one row of partial sums
SLOTS = 64  # partial sums are merged in this many groups of tasks first
EXACT = 2.0**53  # integers below this are exact in double precision


def two_sum(a, b):
    """``a + b`` and what its rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a):
    """``a`` as the sum of two numbers of 26 bits each, whose products are exact."""
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def merged(high, low, high2, low2):
    """The sum of two double-double numbers."""
    s, e = two_sum(high, high2)
    return two_sum(s, e + low + low2)


class Outer:
    """Sums of outer products of rows ``(high, low)`` in double-double, upper triangle only."""

    def __init__(self, d: int):
        self.i, self.j = np.triu_indices(d)
        self.lanes = max(1, LANES // max(1, len(self.i)))
        self.high, self.low = np.zeros((2, self.lanes, len(self.i)))

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        for k in range(0, len(high), self.lanes):
            x, y = high[k : k + self.lanes], low[k : k + self.lanes]
            n = len(x)
            up, down = halves(x)
            a, b = x[:, self.i], x[:, self.j]
            p = a * b
            u, v, r, s = up[:, self.i], up[:, self.j], down[:, self.i], down[:, self.j]
            lost = ((u * v - p) + u * s + r * v) + r * s
            lost += a * y[:, self.j] + y[:, self.i] * b
            self.high[:n], e = two_sum(self.high[:n], p)
            self.low[:n] += e + lost
        self.high, self.low = two_sum(self.high, self.low)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        high, low = self.high[0], self.low[0]
        for k in range(1, self.lanes):
            high, low = merged(high, low, self.high[k], self.low[k])
        return high, low


def by_dimension(b: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(dimension, places in the batch, integer matrix)`` of a batch of vectors; empty vectors are passed over."""
    x = b.column(column)
    sizes = np.diff(x.offsets.to_numpy())
    flat, starts = x.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, flat[starts[at][:, None] + np.arange(d)]


@dataclass
class Model:
    """What is known of the vectors of one dimension."""

    n: int
    sums: list[int]
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the components with a spread
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # a component a row
    explained: np.ndarray = field(default_factory=lambda: np.zeros(0))
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        means = [Fraction(s, self.n) for s in self.sums]
        high = np.array([float(m) for m in means])
        low = np.array([float(m - Fraction(h)) for m, h in zip(means, high.tolist())])
        c, e = two_sum(x.astype(float), -high)
        return two_sum(c, e - low)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of the component's eigenvalue. Each row is summed in the same order."""
        c = self.centred(x)[0]
        return np.stack([(c * v).sum(axis=1) / np.sqrt(e) for v, e in zip(self.vectors, self.values)], axis=1) if len(self.values) else np.zeros((len(x), 0))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """``sum (n x - S)^2`` exactly; null where a long cannot hold it."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if most**2 * x.shape[1] < 1 << 63:
            return ((self.n * x - np.array(self.sums)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def integers(vectors: DataFrame, column: str, scale: float) -> DataFrame:
    """``vectors`` with ``x``, the floors of the scaled entries, without the rows that take no part: null vectors and
    those that hold null, non-finite or, scaled, inexact entries (2^53 and beyond)."""
    v = named(column)
    scaled = lambda c: F.lit(scale) * c.cast("double")
    fine = F.forall(v, lambda c: F.coalesce(F.abs(scaled(c)) < EXACT, F.lit(False)) & ~F.isnan(c))
    return vectors.filter(v.isNotNull() & fine).withColumn("x", F.transform(v, lambda c: F.floor(scaled(c)).cast("long")))


def _moments(rows: DataFrame) -> dict[int, Model]:
    """Count and exact sums of the vectors of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for d, at, x in by_dimension(b, "x"):
                safe = int(np.abs(x).max()) * len(x) < 1 << 62
                sums = (x if safe else x.astype(object)).sum(axis=0).tolist()
                n, old = held.get(d, (0, [0] * d))
                held[d] = (n + len(at), [a + s for a, s in zip(old, sums)])
        for d, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], ["d", "at", "n", "s"])

    found = rows.mapInArrow(run, "d int, at int, n long, s decimal(38,0)").groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    sums: dict[int, dict] = {}
    for r in found:
        sums.setdefault(r.d, {})[r.at] = r
    return {d: Model(at[0].n, [int(at[k].s) for k in range(d)]) for d, at in sums.items()}


def _outer_sums(rows: DataFrame, models: dict[int, Model], points) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The sums of outer products of ``points(model, x)`` over all rows, for each dimension: high and low parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Outer] = {}
        for b in batches:
            for d, _, x in by_dimension(b, "x"):
                high, low = points(models[d], x)
                held.setdefault(d, Outer(high.shape[1])).add(high, low)
        part = TaskContext.get().partitionId()
        for d, sums in held.items():
            high, low = sums.total()
            for k in range(0, len(high), PIECE):
                yield pa.RecordBatch.from_pylist([{"d": d, "piece": k // PIECE, "part": part, "high": high[k : k + PIECE].tolist(), "low": low[k : k + PIECE].tolist()}], schema)

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        high, low = (np.stack([np.asarray(v) for v in t[c].to_pylist()]) for c in ("high", "low"))
        h, v = high[0], low[0]
        for k in range(1, len(high)):
            h, v = merged(h, v, high[k], low[k])
        first = t.slice(0, 1)
        return pa.table([first["d"], first["piece"], first["part"], pa.array([h.tolist()], pa.list_(pa.float64())), pa.array([v.tolist()], pa.list_(pa.float64()))], schema)

    schema = pa.schema([("d", pa.int32()), ("piece", pa.int32()), ("part", pa.int32()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))])
    kind = "d int, piece int, part int, high array<double>, low array<double>"
    partial = rows.mapInArrow(run, kind).groupBy("d", "piece", F.col("part") % SLOTS).applyInArrow(lambda key, t: merge(t), kind)
    whole = partial.groupBy("d", "piece").applyInArrow(lambda key, t: merge(t), kind)
    out: dict[int, dict] = {}
    for r in whole.collect():
        out.setdefault(r.d, {})[r.piece] = (np.array(r.high), np.array(r.low))
    return {d: tuple(np.concatenate([p[k][part] for k in range(len(p))]) for part in (0, 1)) for d, p in out.items()}


def _square(high: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle of double-double sums over n, rounded once."""
    q = high / n
    p = q * n
    u, v = halves(q)
    r, s = halves(float(n))
    lost = ((u * r - p) + u * s + v * r) + v * s
    q = q + (((high - p) - lost) + low) / n
    d = round((np.sqrt(8 * len(q) + 1) - 1) / 2)
    out = np.zeros((d, d))
    i, j = np.triu_indices(d)
    out[i, j] = out[j, i] = q
    return out


def fit(rows: DataFrame, components: int = 4) -> dict[int, Model]:
    """The model of each dimension of the integer vectors ``x``, each distinct vector counted once.

    Components whose eigenvalue is zero to rounding have no spread to divide by and are left out.
    """
    distinct = stored(rows.select("x").filter(F.size("x") > 0).distinct(), "whitening")
    models = _moments(distinct)
    for d, (high, low) in _outer_sums(distinct, models, lambda m, x: m.centred(x)).items():
        m = models[d]
        spread = _square(high, low, m.n)
        values, vectors = symmetric_eigen(spread)
        some = [k for k in range(min(components, d)) if values[k] > max(values[0], 0.0) * d * 2.0**-50]
        m.values, m.vectors, m.explained = values[some], np.ascontiguousarray(vectors[:, some].T), values[some] / max(np.trace(spread), 2.0**-1000)
    seen = {d: m for d, m in models.items() if len(m.values)}
    if seen:
        white = lambda m, x: (w := m.whitened(x), np.zeros_like(w))
        for d, (high, low) in _outer_sums(distinct.filter(F.size("x").isin(list(seen))), models, white).items():
            models[d].identity_error = float(np.abs(_square(high, low, models[d].n) - np.eye(len(models[d].values))).max())
    discard(distinct)
    return models


def whiten(rows: DataFrame, models: dict[int, Model], id_col: str = "vec_id") -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)`` for each row and component."""
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_dimension(b, "x"):
                m = models[d]
                w, k = m.whitened(x), len(m.values)
                ids, off = b.column(0).take(pa.array(np.repeat(at, k))), pa.array(m.deviations(x), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(ids), m.n)), off.take(pa.array(np.repeat(np.arange(len(at)), k))),
                     pa.array(w.reshape(-1)), pa.array(np.tile(m.explained, len(at))), pa.array(np.full(len(ids), m.identity_error))], names)

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(named(id_col), "x").mapInArrow(run, f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten_embeddings(embeddings: DataFrame, scale: float = 256.0, components: int = 4, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Whitened projections of all embeddings, floored at a grid of ``1 / scale``.

    Rows with a null vector or one that holds null, non-finite or huge entries (scaled 2^53 and beyond) are dropped;
    rows with a null or repeated id are judged each; copies count once in the fit and are returned each. Vectors of
    different dimensions are fitted apart. An empty vector and an empty table give no rows, and a component without spread
    (a single distinct vector) gives none either. A deviation that a long cannot hold is null. Other columns are not read.
    """
    rows = integers(embeddings.select(named(id_col), named(column)), column, scale)
    return whiten(rows, fit(rows, components), id_col)
