"""Registered queries of the models: selection, reference and final fits, ablations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matches as M
from ..operators import multinomial as X
from ..operators import selection
from .fixtures import view
from .registry import FOLDS, LAST, TRAIN_END, query

CS = (0.01, 0.1, 1.0, 10.0)
#: Of the ablations: every second kind of feature, and the ratings alone.
PARTS = {
    "ratings": ("elo_difference_before",),
    "form": tuple(c for c in M.FEATURES if "last_5" in c),
    "season": tuple(c for c in M.FEATURES if "last_5" not in c),
    "home": tuple(c for c in M.FEATURES if c.startswith("home_")),
}


def features(spark, d):
    return M.numerical_features(view(spark, d, "fx_match"), TRAIN_END, LAST)


def split(spark, d):
    rows = features(spark, d)
    return rows.filter("dataset_split = 'train'"), rows.filter("dataset_split = 'test'")


@query()
def ml_11_candidate_selection(spark, d):
    """Two feature sets, four weights and three folds, solved together, scored and ranked."""
    return selection.select(split(spark, d)[0], FOLDS, M.SETS, CS)[0]


@query()
def ml_11_set_05_chk_20_validation_violations(spark, d):
    """Matches that not every candidate predicts exactly once: counted by model, with their number, which is 0."""
    pred = selection.select(split(spark, d)[0], FOLDS, M.SETS, CS)[1]
    bad = selection.validation_violations(pred).agg(F.count(F.lit(1)).alias("violations"))
    return pred.groupBy("model_id", "fold").agg(F.count(F.lit(1)).alias("rows"), F.sum("match_id").alias("ids")).crossJoin(F.broadcast(bad))


@query()
def ml_09_10_reference_and_final_predictions(spark, d):
    """The reference model (35 columns, C = 1) and the selected one (31 columns, C = 0.01) over the test rows."""
    models = {"reference": (M.SETS["full"], 1.0), "final": (M.SETS["without_match_counts"], 0.01)}
    return X.fit_predict(*split(spark, d), models)[1].drop("fold")


@query()
def ml_08_coefficients(spark, d):
    """The same models' coefficients by class and feature."""
    models = {"reference": (M.SETS["full"], 1.0), "final": (M.SETS["without_match_counts"], 0.01)}
    return X.coefficients(X.fit_predict(*split(spark, d), models)[0], spark).drop("fold")


@query()
def ml_15_ablations(spark, d):
    return selection.ablations(*split(spark, d), PARTS, 0.01)
