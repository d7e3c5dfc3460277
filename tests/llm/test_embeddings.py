"""Whitening and hard negatives against brute force, on copies, repeated ids, ties, nulls, odd dimensions and empty tables."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY
from tidemark.llm import eigen, negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, row string, cell string, id double"


def make_rows(seed=5, n=700, d=12, bad=True):
    """Clustered vectors, a third of the rows one and the same, repeated ids, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    v = np.round((centres[rng.integers(0, 6, n)] + 0.5 * rng.normal(size=(n, d))).astype(np.float32), 2)
    v[: n // 3] = v[0]
    out = [(int(i), v[i].tolist(), int(rng.integers(0, 4)), 1, "r", "c", 0.5) for i in range(n)]
    out += [out[100], out[150], (50, v[400].tolist(), 2, 1, "r", "c", 0.5)]
    if bad:
        odd = [None, [], [1.0, None, *[0.0] * (d - 2)], [math.nan] * d, [math.inf] * d, [1e30] * d]
        out += [(2000 + i, e, 1, 1, "r", "c", 0.5) for i, e in enumerate(odd)] + [(None, v[1].tolist(), 1, 1, "r", "c", 0.5), (2050, v[1].tolist(), None, 1, "r", "c", 0.5)]
        out += [(3000 + 25 * i, [float(i), 1.0, -0.001], 1 + i % 2, 1, "r", "c", 0.5) for i in range(8)]
    return out


def takes_part(e):
    return e is not None and len(e) > 0 and all(c is not None and math.isfinite(c) and abs(c) < 1e15 for c in e)


def grid(e):
    return tuple(math.floor(256 * float(np.float32(c))) for c in e)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(7)


def mined_by_force(rows):
    kept = [(i, (label + 1) % 10 if i % 7 == 0 else label, grid(e)) for i, e, label, *_ in rows if i is not None and label is not None and takes_part(e)]
    out = []
    for n, (a, label, x) in enumerate(kept):
        if a % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i, other == label) for m, (i, other, y) in enumerate(kept) if m != n and len(y) == len(x)]
        for s, p, _ in sorted(r for r in scored if r[2])[:5]:
            near = sorted(r[:2] for r in scored if not r[2] and 50 * -s <= 100 * -r[0] <= 95 * -s)[:3]
            out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(near, 1)]
    return Counter(out)


@pytest.mark.parametrize("pivots", [64, 4])
def test_op12_equals_brute_force(spark, vectors, monkeypatch, pivots):
    monkeypatch.setattr(negatives, "ANCHORS_A_CELL", pivots)
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    monkeypatch.setattr(negatives, "ROWS", 100)
    got = Counter(tuple(r) for r in negatives.mine_embeddings(vectors).collect())
    want = mined_by_force(make_rows())
    assert got == want and len(want) > 50


def test_op12_no_anchor_and_empty(spark, vectors):
    assert negatives.mine_embeddings(vectors.limit(0)).count() == 0
    assert negatives.mine_embeddings(vectors.filter("vec_id % 50 <> 0")).count() == 0
    one = negatives.mine_embeddings(vectors.filter("vec_id = 350"))
    assert one.count() == 0 and one.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_op12_cells_spare_rows(spark, monkeypatch):
    """Clusters far apart: rows are sent to the cells of their own cluster only."""
    monkeypatch.setattr(negatives, "ANCHORS_A_CELL", 4)
    rng = np.random.default_rng(2)
    rows = [(i, (1000 * np.eye(8)[i % 8] + rng.normal(size=8)).tolist(), i % 3, 1, "r", "c", 0.5) for i in range(1600)]
    df = spark.createDataFrame(rows, SCHEMA)
    ints = whitening.integers(df, "embedding", 256.0).select(F.col("vec_id").alias("id"), "label", "x", (F.col("vec_id") % 5 == 0).alias("anchor")).withColumn("row", F.col("id"))
    cells = negatives._cells(ints)
    placed = negatives._placed(ints, cells)
    used = {r.cell: r.r for r in placed.filter("anchor").groupBy("cell").agg(F.max("reach").alias("r")).collect()}
    near = {c: 300 * 256.0 for c in used}
    sent = negatives._sent(placed, cells, used, dict.fromkeys(used, 0.0), near, {c: (c, 1) for c in used}, 1)
    assert len(used) > 16 and sent.count() == len(used) * len(rows) // 8


def test_op12_products_stay_exact():
    big = np.array([[1 << 40, 3], [-(1 << 52), 1]])
    assert negatives.products(big[:1], big).tolist() == [[1 << 56, -(1 << 56)]]
    odd = np.array([[(1 << 25) + 1, 1]])
    assert negatives.products(odd, odd).tolist() == [[((1 << 25) + 1) ** 2 + 1]]


def test_op11_equals_brute_force(spark, vectors):
    rows = [r for r in make_rows() if takes_part(r[1])]
    got = whitening.whiten_embeddings(vectors).collect()
    for d in (12, 3):
        mine = [(r[0], grid(r[1])) for r in rows if len(r[1]) == d]
        fit = np.array(sorted({x for _, x in mine}), dtype=object)
        n, sums = len(fit), fit.sum(axis=0)
        exact = {x: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in mine}
        values, vectors_ = np.linalg.eigh(((c := (fit - sums / n).astype(float)).T @ c) / n)
        values, vectors_ = values[::-1], vectors_[:, ::-1]
        some = [k for k in range(min(4, d)) if values[k] > 1e-9 * values[0]]
        here = [r for r in got if r.vec_id is None or (r.vec_id >= 3000) == (d == 3)]
        here = [r for r in here if r.n == n]
        assert Counter((r.vec_id, r.component, r.deviation) for r in here) == Counter((i, k + 1, exact[x]) for i, x in mine for k in some)
        for k in some:
            told = sorted(((r.vec_id, r.whitened) for r in here if r.component == k + 1 and r.vec_id is not None))
            want = {i: float(((np.array(x) - sums / n).astype(float) * vectors_[:, k]).sum() / math.sqrt(values[k])) for i, x in mine if i not in (None, 50)}
            sign = np.sign(sum(w * want.get(i, 0) for i, w in told))
            assert max(abs(sign * w - want[i]) for i, w in told if i != 50) < 1e-9
        assert max(abs(r.explained - values[r.component - 1] / values.sum()) for r in here) < 1e-9
        assert max(r.identity_error for r in here) < 1e-9


def test_op11_equal_rows_get_equal_values(vectors):
    values = {r.component: r.n for r in whitening.whiten_embeddings(vectors.filter("vec_id < 700")).filter("vec_id < 233 AND vec_id <> 50").groupBy("component").agg(F.count_distinct("whitened").alias("n")).collect()}
    assert set(values.values()) == {1}


def test_op11_degenerate_tables(spark, vectors):
    assert whitening.whiten_embeddings(vectors.limit(0)).count() == 0
    assert whitening.whiten_embeddings(vectors.filter("vec_id < 50")).count() == 0  # one distinct vector: no spread
    two = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten_embeddings(two).collect()} == {1}


def test_op11_sums_keep_what_doubles_lose():
    """Cancellation: a double sum of these products loses all digits of the small ones."""
    x = np.array([[1e8 + 1, 3.0], [1e-8, 7.0], [-1e8 - 1, 11.0]] * 5)
    sums = whitening.Outer(2)
    sums.add(x, np.zeros_like(x))
    high, low = sums.total()
    from fractions import Fraction

    for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 1))):
        exact = sum(Fraction(a[i]) * Fraction(a[j]) for a in x.tolist())
        assert abs(Fraction(float(high[k])) + Fraction(float(low[k])) - exact) <= abs(exact) * Fraction(1, 2**95)


@pytest.mark.parametrize("kind", ["random", "equal", "low rank", "graded", "blocks", "one"])
def test_op11_eigen_solver(kind):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    a = {"random": q @ np.diag(rng.random(40)) @ q.T, "equal": 3 * np.eye(40), "low rank": q[:, :3] @ q[:, :3].T, "graded": q @ np.diag(10.0 ** -np.arange(40)) @ q.T, "blocks": np.kron(np.eye(10), np.ones((4, 4))), "one": np.array([[5.0]])}[kind]
    a = (a + a.T) / 2
    values, vectors = eigen.symmetric_eigen(a)
    assert (np.diff(values) <= 0).all()
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * max(1, values[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13


def test_op12_on_given_table(spark):
    df = spark.read.parquet(f"{TINY}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert Counter(tuple(r) for r in negatives.mine_embeddings(df).collect()) == mined_by_force(rows)
