"""Model selection on expanding folds, final models and ablations: all candidates are solved in the same passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evaluation as E
from . import multinomial as X

PRIOR = "dummy__prior"


class FrozenConfigurationChanged(ValueError):
    """A final model's configuration is not the selected one."""


def select_features(columns: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """The wanted columns in their order; an empty, repeated or unknown choice is an error."""
    if not wanted or len(set(wanted)) < len(wanted) or (unknown := [c for c in wanted if c not in columns]):
        raise ValueError(f"bad feature choice: {list(wanted)[:5]}")
    return list(wanted)


def candidate_id(model: str, feature_set: str, c: float) -> str:
    return f"{model}__{feature_set}__C_{c:g}"


def check_design(folds: Sequence[tuple[int, int, int]]) -> None:
    """Folds expand: each is fitted before it is validated, and validation windows follow each other without overlap."""
    last = None
    for fit_end, start, end in folds:
        if not fit_end < start <= end or (last is not None and start <= last):
            raise ValueError(f"bad fold: fit to {fit_end}, validation {start} to {end}")
        last = end


def fold_masks(rows: DataFrame, folds: Sequence[tuple[int, int, int]]) -> tuple[DataFrame, list[Column], list[Column]]:
    """``rows`` with each fold's cutoff (its first validation kickoff), and the masks of its fit and validation rows.

    Rows of the fit window that kick off on or after the cutoff belong to neither.
    """
    day, kick = F.col("matchday"), F.col("kickoff")
    inside = [day.between(start, end) for _, start, end in folds]
    cutoffs = rows.agg(*[F.min(F.when(m, kick)).alias(f"_cutoff_{i}") for i, m in enumerate(inside)])
    out = rows.crossJoin(F.broadcast(cutoffs))  # one row
    return out, [(day <= fit_end) & (kick < F.col(f"_cutoff_{i}")) for i, (fit_end, _, _) in enumerate(folds)], inside


def candidates(feature_sets: Mapping[str, Sequence[str]], cs: Sequence[float], folds: int) -> list[X.Candidate]:
    return [X.Candidate(candidate_id("logistic", name, c), tuple(columns), float(c), f) for name, columns in feature_sets.items() for c in cs for f in range(folds)]


def select(rows: DataFrame, folds: Sequence[tuple[int, int, int]], feature_sets: Mapping[str, Sequence[str]], cs: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """(ranked candidates, validation predictions) of every feature set and C over the folds, and the prior's predictions.

    All candidates are solved together (``multinomial.solve``). The loss is pooled over the folds' predictions, its
    standard error is that of the folds' means; the prior is scored but not ranked.
    """
    check_design(folds)
    features = list(dict.fromkeys(c for columns in feature_sets.values() for c in select_features(rows.columns, columns)))
    cut, fit, validation = fold_masks(rows, folds)
    parts = X.masked(cut.filter(F.col("matchday") <= folds[-1][2]), features, fit, validation)
    parts = X.settled(parts.select("match_id", "matchday", "result", "_x", "_y", "_fit", "_test"))
    fits = X.solve(parts, features, candidates(feature_sets, cs, len(folds)))
    shares = {f.candidate.fold: f.fold.counts / f.fold.n for f in fits}
    told = X.predict(parts, features, fits, ["match_id", "matchday", "result"], {PRIOR: shares}).withColumnRenamed("result", "actual")
    design = [(candidate_id("logistic", name, c), name, len(columns), float(c)) for name, columns in feature_sets.items() for c in cs]
    listed = rows.sparkSession.createDataFrame([*design, (PRIOR, None, None, None)], "model_id string, feature_set string, feature_count int, c double")
    pred = told.join(F.broadcast(listed), "model_id")
    scored = candidate_scores(pred)
    ranked = E.one_standard_error(scored.filter(F.col("model_id") != PRIOR).withColumnRenamed("log_loss", "loss"))
    return ranked, pred


def candidate_scores(pred: DataFrame) -> DataFrame:
    """Each model's metrics pooled over all folds, and the spread of the folds' log losses."""
    by = ["model_id", "feature_set", "feature_count", "c"]
    per_fold = E.metrics(pred, ["model_id", "fold"])
    spread = E.fold_summary(per_fold, ["model_id"], "log_loss")
    design = pred.select(*by).distinct()
    return E.metrics(pred, ["model_id"]).join(spread, "model_id").join(design, "model_id")


def validation_violations(pred: DataFrame) -> DataFrame:
    """``(match_id, models, times)`` of matches that not every model predicts exactly once: models must be judged on the
    same matches, and folds may not share one."""
    per = pred.groupBy("match_id").agg(F.count_distinct("model_id").alias("models"), F.count(F.lit(1)).alias("times"))
    known = pred.select("model_id").distinct().agg(F.count(F.lit(1)).alias("known"))
    return per.crossJoin(F.broadcast(known)).filter((F.col("models") != F.col("known")) | (F.col("times") != F.col("known"))).drop("known")


def final_model(train: DataFrame, test: DataFrame, ranked: DataFrame, features: Sequence[str], c: float, feature_set: str):
    """The final fit, refused unless its configuration is the one that the selection ranked first."""
    best = ranked.filter("selection_rank = 1").first()["model_id"]
    wanted = candidate_id("logistic", feature_set, c)
    if best != wanted:
        raise FrozenConfigurationChanged(f"selected {best}")
    return X.fit_predict(train, test, {wanted: (features, c)})


def ablations(train: DataFrame, test: DataFrame, sets: Mapping[str, Sequence[str]], c: float) -> DataFrame:
    """Metrics of a fit on each feature set, in the order given; all sets are solved together."""
    _, out = X.fit_predict(train, test, {name: (columns, c) for name, columns in sets.items()})
    listed = train.sparkSession.createDataFrame([(name, i) for i, name in enumerate(sets)], "model_id string, position int")
    pred = out.withColumnRenamed("result", "actual").join(F.broadcast(listed), "model_id").withColumnRenamed("model_id", "feature_set")
    return E.metrics(pred, ["feature_set", "position"]).orderBy("position")
