"""Many regressions in one pass, against brute force: stationarity, the optimum, selection and its rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY
from tidemark.operators import evaluation as E
from tidemark.operators import matches as M
from tidemark.operators import multinomial as X
from tidemark.operators import selection
from tidemark.plans import registry_models
from tidemark.plans.registry import FOLDS

COLUMNS = ("u", "v", "w", "flat")


def rows_of(seed=4, days=12, a_day=9):
    r = random.Random(seed)
    return [(d * 100 + i, d, ("H", "D", "A")[(i + (i * d) % 2) % 3], r.gauss(i % 3, 1), 50 + 30 * r.gauss(0, 1), r.gauss(-(i % 2), 0.1), 7.0) for d in range(1, days + 1) for i in range(a_day)]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(rows_of(), "match_id long, matchday int, result string, u double, v double, w double, flat double")
    return df.withColumn("kickoff", F.timestamp_seconds(F.col("matchday") * 604800)).repartition(5)


def by_force(table, fold, columns):
    """Standardized design, classes and validation rows of one fold, from plain rows."""
    fit_end, start, end = fold
    fit = [r for r in table if r[1] <= fit_end]
    x = np.array([[r[3 + COLUMNS.index(c)] for c in columns] for r in fit])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    y = np.array([E.LABELS.index(r[2]) for r in fit])
    return (x - mean) / scale, y, (mean, scale), [r for r in table if start <= r[1] <= end]


def gradient(w, x, y, c):
    z = np.column_stack([x, np.ones(len(x))])
    s = z @ w.T
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    g = c * p.T @ z
    g[:, :-1] += w[:, :-1]
    return g


def test_all_candidates_are_stationary(spark, rows):
    folds = ((4, 5, 6), (6, 7, 8), (8, 9, 12))
    sets = {"full": COLUMNS, "part": ("w", "u")}
    jobs = selection.candidates(sets, (0.01, 0.1, 1.0, 10.0), len(folds))
    cut, fit, val = selection.fold_masks(rows, folds)
    parts = X.masked(cut, COLUMNS, fit, val)
    fits = X.solve(parts, COLUMNS, jobs)
    assert [f.candidate for f in fits] == jobs and len(jobs) == 24
    for f in fits:
        x, y, scaled, valid = by_force(rows_of(), folds[f.candidate.fold], f.candidate.columns)
        assert np.abs(gradient(f.weights, x, y, f.candidate.c)).max() < 1e-6
        assert abs(f.weights[:, -1].sum()) < 1e-9 and f.steps < 15
    told = {(r.match_id, r.model_id, r.fold): r for r in X.predict(parts, COLUMNS, fits, ["match_id"], {"prior": {f.candidate.fold: f.fold.counts / f.fold.n for f in fits}}).collect()}
    assert len(told) == sum((1 + 8) * 9 * (e - s + 1) for _, s, e in folds)
    for f in fits:
        _, _, (mean, scale), valid = by_force(rows_of(), folds[f.candidate.fold], f.candidate.columns)
        for r in valid:
            z = np.append((np.array([r[3 + COLUMNS.index(c)] for c in f.candidate.columns]) - mean) / scale, 1.0)
            p = np.exp(f.weights @ z)
            got = told[r[0], f.candidate.model_id, f.candidate.fold + 1]
            assert np.allclose(p / p.sum(), [got[q] for q in E.PROBS], atol=1e-12)
            assert got.predicted == E.LABELS[int(np.argmax([got[q] for q in E.PROBS]))]


def test_solver_agrees_with_another_solver(rows):
    fits, out = X.fit_predict(rows.filter("matchday <= 8"), rows.filter("matchday > 8"), {"m": (COLUMNS[:3], 0.5)})
    _, other = E.logistic(rows.filter("matchday <= 8"), rows.filter("matchday > 8"), COLUMNS[:3], c=0.5)
    mine, theirs = ({r.match_id: [r[p] for p in E.PROBS] for r in df.collect()} for df in (out, other))
    assert mine.keys() == theirs.keys() and all(np.allclose(mine[k], theirs[k], atol=1e-4) for k in mine)


def test_separable_classes_take_shorter_steps(spark):
    """A weak penalty on classes that a line divides: full Newton steps overshoot, halved ones arrive."""
    df = spark.createDataFrame([(i, ("H", "D", "A")[i % 3], float(100 * (i % 3)) + i / 50) for i in range(60)], "match_id long, result string, u double")
    fit = X.fit_predict(df, df, {"m": (("u",), 1e6)})[0][0]
    x = np.array([100 * (i % 3) + i / 50 for i in range(60)])
    g = gradient(fit.weights, ((x - x.mean()) / x.std())[:, None], np.array([i % 3 for i in range(60)]), 1e6)
    assert np.abs(g).max() < 1e-3 and fit.gradient <= 6e-5
    with pytest.raises(X.NotConverged, match="m"):
        X.solve(X.masked(df, ["u"], [F.lit(True)], [F.lit(False)]), ["u"], [X.Candidate("m", ("u",), 1e6)], most=2)


def test_bad_rows_and_designs_are_errors(rows):
    with pytest.raises(ValueError, match="not finite"):
        X.fit_predict(rows.withColumn("u", F.when(F.col("match_id") != 101, F.col("u"))), rows, {"m": (("u",), 1.0)})
    with pytest.raises(ValueError, match="a class has no fit row"):
        X.fit_predict(rows.filter("result <> 'D'"), rows, {"m": (("u",), 1.0)})
    with pytest.raises(ValueError, match="positive"):
        X.fit_predict(rows, rows, {"m": (("u",), 0.0)})
    for folds in (((4, 4, 5),), ((4, 5, 7), (6, 7, 8)), ((4, 6, 5),)):
        with pytest.raises(ValueError, match="bad fold"):
            selection.select(rows, folds, {"one": ["u"]}, [1.0])


def test_late_rows_belong_to_no_side(rows):
    """A row of the fit window that kicks off after the first validation match is neither fitted nor validated."""
    late = rows.withColumn("kickoff", F.when(F.col("match_id") == 201, F.timestamp_seconds(F.lit(90 * 604800))).otherwise(F.col("kickoff")))
    cut, fit, val = selection.fold_masks(late, ((4, 5, 6),))
    assert cut.filter(fit[0]).count() == 35 and cut.filter(val[0]).count() == 18


def test_selection_over_the_given_tables(spark):
    train = registry_models.split(spark, TINY)[0]
    ranked, pred = selection.select(train, FOLDS, M.SETS, registry_models.CS)
    assert len(M.FEATURES) == 35 and len(M.SETS["without_match_counts"]) == 31
    got, told = ranked.collect(), pred.collect()
    assert len(got) == 8 and selection.validation_violations(pred).count() == 0
    loss = {}
    for r in told:
        loss.setdefault(r.model_id, {}).setdefault(r.fold, []).append(-math.log(r[E.PROBS[E.LABELS.index(r.actual)]]))
    assert len(loss) == 9
    scores = {m: (np.mean(sum(f.values(), [])), np.std([np.mean(v) for v in f.values()], ddof=1) / math.sqrt(len(f))) for m, f in loss.items()}
    best = min((r for r in got), key=lambda r: (scores[r.model_id][0], r.feature_count, r.c))
    limit = sum(scores[best.model_id])
    order = sorted(got, key=lambda r: (scores[r.model_id][0] > limit, (r.feature_count, r.c) if scores[r.model_id][0] <= limit else (0, 0), scores[r.model_id][0]))
    assert [r.model_id for r in sorted(got, key=lambda r: r.selection_rank)] == [r.model_id for r in order]
    assert all(math.isclose(r.loss, scores[r.model_id][0], abs_tol=1e-9) and math.isclose(r.se, scores[r.model_id][1], abs_tol=1e-9) for r in got)
    some = pred.filter("NOT (model_id = 'dummy__prior' AND fold = 1)")
    assert selection.validation_violations(some).count() == pred.filter("model_id = 'dummy__prior' AND fold = 1").count()


def test_ablations_equal_single_fits(rows):
    train, test = rows.filter("matchday <= 8"), rows.filter("matchday > 8")
    both = {r.feature_set: r.log_loss for r in selection.ablations(train, test, {"a": ("u",), "b": ("u", "w")}, 0.3).collect()}
    for name, columns in (("a", ("u",)), ("b", ("u", "w"))):
        p = X.fit_predict(train, test, {name: (columns, 0.3)})[1].withColumnRenamed("result", "actual")
        assert math.isclose(E.metrics(p, ["model_id"]).first().log_loss, both[name], abs_tol=1e-12)
