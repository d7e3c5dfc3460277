"""Many multinomial regressions at once: all candidates are fitted side by side, one pass over the rows a step.

A candidate is a choice of columns, a weight C and a fold; the model is the L2-penalised multinomial regression on
columns standardized over the fold's fit rows, ``C * sum(loss) + |w|^2 / 2`` with free intercepts. A step sends the
current coefficients of all unfinished candidates to the tasks; each task returns its sums of loss, gradient and
curvature for each of them, and these are merged by candidate. The driver holds one square of the coefficients
for each candidate and takes damped Newton steps, so a handful of passes fits all, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import scratch
from .evaluation import LABELS, PROBS

SLOTS = 64  # partial sums are merged in this many groups of tasks first


class NotConverged(RuntimeError):
    """A candidate was not stationary after the last step."""


@dataclass(frozen=True)
class Candidate:
    """``fold`` is the place in the rows' arrays of masks, counted from 0."""

    model_id: str
    columns: tuple[str, ...]
    c: float
    fold: int = 0


@dataclass
class Fold:
    """Fit rows, class counts, means and population deviations (1 where that is 0) of one fold."""

    n: int
    counts: np.ndarray
    means: np.ndarray
    scales: np.ndarray


@dataclass
class Fit:
    """A solved candidate: coefficients a class a row, the intercept last (they sum to 0 over the classes)."""

    candidate: Candidate
    weights: np.ndarray
    steps: int
    gradient: float
    fold: Fold = field(repr=False)


def masked(rows: DataFrame, features: Sequence[str], fit: Sequence[Column], test: Sequence[Column], label: str = "result", labels: Sequence[str] = LABELS) -> DataFrame:
    """``rows`` with ``_x`` (the features), ``_y`` (the label's place) and the masks ``_fit`` and ``_test`` of each fold."""
    place = F.coalesce(*[F.when(F.col(label) == y, i) for i, y in enumerate(labels)], F.lit(-1))
    flags = lambda masks: F.array(*[F.coalesce(m, F.lit(False)) for m in masks])
    return rows.withColumns({"_x": F.array(*[F.col(c).cast("double") for c in features]), "_y": place, "_fit": flags(fit), "_test": flags(test)})


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` written once to the shared folder and read again: every pass then reads one narrow table, whatever it took
    to make it, also after executors are lost."""
    path = scratch(rows.sparkSession, "candidates")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _arrays(b: pa.RecordBatch, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = b.num_rows
    matrix = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return matrix("_x").astype(float), b.column("_y").to_numpy(), matrix(mask).astype(bool)


def _merged(partial: DataFrame, add) -> dict[int, np.ndarray]:
    """Rows ``(id, part, v)`` of all tasks as one array an id, added in the order of the tasks: within slots, then over them."""
    kind = "id int, part int, v array<double>"

    def run(key, t):
        t = t.sort_by("part")
        total = None
        for v in t["v"].to_pylist():
            total = np.asarray(v) if total is None else add(total, np.asarray(v))
        return pa.table({"id": t["id"].slice(0, 1), "part": t["part"].slice(0, 1), "v": pa.array([total.tolist()], pa.list_(pa.float64()))})

    whole = partial.groupBy("id", F.col("part") % SLOTS).applyInArrow(run, kind).groupBy("id").applyInArrow(run, kind)
    return {r.id: np.array(r.v) for r in whole.collect()}


def _batch(held: Mapping[int, np.ndarray]) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([part] * len(held), pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], ["id", "part", "v"])


def _folds(rows: DataFrame, p: int, k: int) -> dict[int, Fold]:
    """Counts, means and deviations of each fold's fit rows: centred sums, merged without cancellation."""

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = a[0], b[0]
        if not n or not m:
            return b + 0 if not n else a + 0
        shift = b[1 : p + 1] - a[1 : p + 1]
        return np.concatenate([[n + m], a[1 : p + 1] + shift * (m / (n + m)), a[p + 1 : 2 * p + 1] + b[p + 1 : 2 * p + 1] + shift**2 * (n * m / (n + m)), a[2 * p + 1 :] + b[2 * p + 1 :]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            x, y, fit = _arrays(b, "_fit")
            for f in range(fit.shape[1]):
                z, at = x[fit[:, f]], y[fit[:, f]]
                if len(z):
                    mean = z.mean(axis=0)
                    bad = (~np.isfinite(z)).any(axis=1).sum() + (at < 0).sum()
                    one = np.concatenate([[len(z)], mean, ((z - mean) ** 2).sum(axis=0), np.bincount(at[at >= 0], minlength=k), [bad]])
                    held[f] = add(held[f], one) if f in held else one
        if held:
            yield _batch(held)

    out = {}
    for f, v in _merged(rows.select("_x", "_y", "_fit").mapInArrow(run, "id int, part int, v array<double>"), add).items():
        counts = v[2 * p + 1 : 2 * p + 1 + k]
        if v[-1]:
            raise ValueError(f"fold {f}: {int(v[-1])} fit rows without a known label or with values that are not finite")
        if not counts.all():
            raise ValueError(f"fold {f}: a class has no fit row: {counts.astype(int).tolist()}")
        scale = np.sqrt(v[p + 1 : 2 * p + 1] / v[0])
        out[f] = Fold(int(v[0]), counts, v[1 : p + 1], np.where(scale == 0, 1.0, scale))
    return out


def _design(x: np.ndarray, at: Sequence[int], fold: Fold) -> np.ndarray:
    z = (x[:, at] - fold.means[at]) / fold.scales[at]
    return np.column_stack([z, np.ones(len(z))])


def _shares(z: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class probabilities of each row and the logarithm of their common divisor."""
    s = z @ w.T
    top = s.max(axis=1, keepdims=True)
    e = np.exp(s - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0] - 0.0


def _sums(rows: DataFrame, trials: Mapping[int, np.ndarray], jobs: Sequence[Candidate], at: Sequence[Sequence[int]], folds: Mapping[int, Fold]) -> dict[int, np.ndarray]:
    """Loss, gradient and curvature (its upper class blocks) of each trial, summed over its fold's fit rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            x, y, fit = _arrays(b, "_fit")
            designs: dict[tuple, np.ndarray] = {}
            for j, w in trials.items():
                f, k = jobs[j].fold, len(w)
                some = fit[:, f]
                if not some.any():
                    continue
                key = (f, tuple(at[j]))
                if key not in designs:
                    designs[key] = _design(x[some], at[j], folds[f])
                z, target = designs[key], y[some]
                p, log_total = _shares(z, w)
                loss = (log_total - (z * w[target]).sum(axis=1)).sum()
                error = p.copy()
                error[np.arange(len(target)), target] -= 1.0
                blocks = [z.T @ (z * (p[:, a] * ((a == c) - p[:, c]))[:, None]) for a in range(k) for c in range(a, k)]
                v = np.concatenate([[loss], (error.T @ z).reshape(-1), *[m.reshape(-1) for m in blocks]])
                held[j] = held[j] + v if j in held else v
        if held:
            yield _batch(held)

    return _merged(rows.select("_x", "_y", "_fit").mapInArrow(run, "id int, part int, v array<double>"), np.add)


def _curvature(v: np.ndarray, k: int, q: int) -> np.ndarray:
    out, at = np.zeros((k, q, k, q)), 0
    for a in range(k):
        for c in range(a, k):
            m = v[at : at + q * q].reshape(q, q)
            out[a, :, c, :], out[c, :, a, :] = m, m.T
            at += q * q
    return out.reshape(k * q, k * q)


def solve(rows: DataFrame, features: Sequence[str], jobs: Sequence[Candidate], labels: Sequence[str] = LABELS, most: int = 100, tol: float = 1e-7) -> list[Fit]:
    """The fits of all candidates over rows from ``masked``, in the candidates' order. Each pass reads the rows anew: settle
    them first where they are dear to make.

    A candidate is done when no entry of its objective's gradient exceeds ``tol`` (or 1e-12 of the weight of its rows,
    which sums in doubles cannot tell from 0); one that is not after ``most`` passes is an error, as are fit rows with
    missing values and folds that lack a class.
    """
    if bad := [j for j in jobs if not (np.isfinite(j.c) and j.c > 0)]:
        raise ValueError(f"C must be positive and finite: {bad[0].model_id}")
    k, place = len(labels), {c: i for i, c in enumerate(features)}
    at = [[place[c] for c in j.columns] for j in jobs]
    rows = rows.select("_x", "_y", "_fit")
    folds = _folds(rows, len(features), k)
    if lost := {j.fold for j in jobs} - set(folds):
        raise ValueError(f"folds without fit rows: {sorted(lost)}")
    penalty = [np.tile(np.append(np.ones(len(a)), 0.0), (k, 1)) for a in at]
    known = [np.zeros((k, len(a) + 1)) for a in at]
    value: list[float] = [np.inf] * len(jobs)
    slope: list[np.ndarray | None] = [None] * len(jobs)
    towards: list[np.ndarray | None] = [None] * len(jobs)
    length, done, steps = [1.0] * len(jobs), [np.inf] * len(jobs), [0] * len(jobs)
    trials = dict(enumerate(known))
    for _ in range(most):
        sums = _sums(rows, trials, jobs, at, folds)
        following = {}
        for j, w in trials.items():
            v, q, c = sums[j], w.shape[1], jobs[j].c
            f = c * v[0] + 0.5 * float((penalty[j] * w * w).sum())
            steps[j] += 1
            if towards[j] is not None and not f <= value[j] + 1e-4 * length[j] * float((slope[j] * towards[j]).sum()) + 1e-12 * abs(value[j]):
                length[j] /= 2
            else:
                g = c * v[1 : 1 + k * q].reshape(k, q) + penalty[j] * w
                known[j], value[j], slope[j], length[j] = w, f, g, 1.0
                done[j] = float(np.abs(g).max())
                if done[j] <= max(tol, 1e-12 * c * folds[jobs[j].fold].n):
                    continue
                h = c * _curvature(v[1 + k * q :], k, q) + np.diag(penalty[j].reshape(-1))
                intercepts = np.arange(k) * q + q - 1
                h[np.ix_(intercepts, intercepts)] += c * folds[jobs[j].fold].n / k  # a common shift changes nothing: keep their sum
                towards[j] = -np.linalg.solve(h, g.reshape(-1)).reshape(k, q)
            following[j] = known[j] + length[j] * towards[j]
        trials = following
        if not trials:
            return [Fit(job, known[j], steps[j], done[j], folds[job.fold]) for j, job in enumerate(jobs)]
    raise NotConverged(", ".join(f"{jobs[j].model_id} in fold {jobs[j].fold}" for j in trials))


def priors(rows: DataFrame, features: Sequence[str], labels: Sequence[str] = LABELS) -> dict[int, np.ndarray]:
    """The class shares of each fold's fit rows."""
    return {f: x.counts / x.n for f, x in _folds(rows, len(features), len(labels)).items()}


def predict(rows: DataFrame, features: Sequence[str], fits: Sequence[Fit], keep: Sequence[str], prior: Mapping[str, Mapping[int, np.ndarray]] | None = None, labels: Sequence[str] = LABELS, probs: Sequence[str] = PROBS) -> DataFrame:
    """``(keep, model_id, fold, probs, predicted)``: each fit over its fold's test rows, in one pass for all.

    ``prior`` adds models that give all rows of a fold the same shares. Ties go to the first label.
    """
    place = {c: i for i, c in enumerate(features)}
    known = [(f.candidate.model_id, f.candidate.fold, [place[c] for c in f.candidate.columns], f.weights, f.fold) for f in fits]
    flat = [(name, f, shares) for name, by_fold in (prior or {}).items() for f, shares in by_fold.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _, test = _arrays(b, "_test")
            some = {f: np.flatnonzero(test[:, f]) for f in range(test.shape[1])}
            parts = [(name, f, some[f], _shares(_design(x[some[f]], at, fold), w)[0]) for name, f, at, w, fold in known if len(some[f])]
            parts += [(name, f, some[f], np.tile(shares, (len(some[f]), 1))) for name, f, shares in flat if len(some[f])]
            for name, f, rows_, p in parts:
                own = b.select(list(keep)).take(pa.array(rows_))
                n = len(rows_)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([name] * n), pa.array([f + 1] * n, pa.int32()), *[pa.array(np.ascontiguousarray(p[:, i])) for i in range(len(labels))]], [*keep, "model_id", "fold", *probs])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    out = rows.select(*keep, "_x", "_y", "_test").mapInArrow(run, f"{kinds}, model_id string, fold int, " + ", ".join(f"{p} double" for p in probs))
    return out.withColumn("predicted", S.argmax_label(list(labels), [F.col(p) for p in probs]))


def fit_predict(train: DataFrame, test: DataFrame, models: Mapping[str, tuple[Sequence[str], float]], keep: Sequence[str] = ("match_id", "result")) -> tuple[list[Fit], DataFrame]:
    """Fits on ``train`` and predictions over ``test`` of several models ``{model_id: (columns, C)}``, solved together."""
    features = list(dict.fromkeys(c for columns, _ in models.values() for c in columns))
    need = list(dict.fromkeys([*keep, "result", *features]))
    both = train.select(*need, F.lit(True).alias("_train")).unionByName(test.select(*need, F.lit(False).alias("_train")))
    rows = settled(masked(both, features, [F.col("_train")], [~F.col("_train")]).select(*keep, "_x", "_y", "_fit", "_test"))
    fits = solve(rows, features, [Candidate(name, tuple(columns), float(c)) for name, (columns, c) in models.items()])
    return fits, predict(rows, features, fits, keep)


def coefficients(fits: Sequence[Fit], spark, labels: Sequence[str] = LABELS) -> DataFrame:
    """``(model_id, fold, label, feature, coefficient)`` on the standardized scale; the intercept under its own name."""
    rows = [(f.candidate.model_id, f.candidate.fold + 1, y, c, float(v)) for f in fits for y, w in zip(labels, f.weights) for c, v in zip((*f.candidate.columns, "intercept"), w)]
    return spark.createDataFrame(rows, "model_id string, fold int, label string, feature string, coefficient double")
