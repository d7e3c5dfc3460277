"""Stored predictions and features read strictly, and the report of an evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from . import checks as C
from . import evaluation as E
from . import matches as M
from . import news as N

# Columns of a prediction file after the metadata.
PROBABILITIES = tuple(f"probability_{x}" for x in E.LABELS)
PREDICTION = (*M.METADATA, "actual_result", "predicted_result", *PROBABILITIES)


def read_exact_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV file whose header is exactly the schema's columns in their order; a value that is not of its type is an error."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    head = spark.read.option("header", False).option("multiLine", True).csv(path).first()
    if head is None or [(x or "").lstrip("﻿") for x in head] != wanted.names:
        raise ValueError(f"expected the columns {wanted.names}, found {None if head is None else list(head)}")
    return spark.read.schema(wanted).option("header", True).option("multiLine", True).option("mode", "FAILFAST").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").csv(path)


def match_metadata(matches: DataFrame, train_end: int, last: int, keep: Sequence[str] = ()) -> DataFrame:
    """The columns that every feature and prediction row begins with, and ``keep``."""
    return matches.withColumn("dataset_split", M.split_label(F.col("matchday"), train_end, last)).select(*M.METADATA, *keep)


def news_features(matches: DataFrame, notes: DataFrame, train_end: int, last: int, indicators: Sequence[str] = N.INDICATORS) -> DataFrame:
    """The news feature table: metadata, the means and shares of both sides, the result; matches without notes are left out."""
    f = N.side_features(notes, indicators)
    return match_metadata(matches, train_end, last, ("result",)).join(f, "match_id").select(*M.METADATA, *f.columns[1:], "result")


def prediction_rows(predictions: DataFrame, matches: DataFrame, train_end: int, last: int) -> DataFrame:
    """Predictions ``(match_id, actual, predicted, probabilities)`` as rows of a prediction file."""
    p = predictions.select("match_id", F.col("actual").alias("actual_result"), F.col("predicted").alias("predicted_result"), *[F.col(a).alias(b) for a, b in zip(E.PROBS, PROBABILITIES)])
    return match_metadata(matches, train_end, last).join(p, "match_id").select(*PREDICTION)


def prediction_violations(p: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Matches given twice, rows that are no test rows, unknown classes, probabilities that are none, and predictions that
    are not the likeliest class."""
    key, probs = ["match_id"], [F.col(c) for c in PROBABILITIES]
    return C.report(
        C.unique(p, key), C.holds(p, "split", F.col("dataset_split") == "test", key), C.holds(p, "class", F.col("actual_result").isin(*E.LABELS), key),
        C.probabilities(p, PROBABILITIES, key, tolerance=tolerance), C.holds(p, "likeliest", F.col("predicted_result") == S.argmax_label(list(E.LABELS), probs), key),
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A prediction file (columns beyond the known ones are left out), refused with ``CheckFailed`` if it has violations."""
    raw = spark.read.option("header", True).csv(path)
    if lacking := [c for c in PREDICTION if c not in raw.columns]:
        raise ValueError(f"missing columns: {lacking}")
    long = ("match_id", "season", "matchday", "home_team_id", "away_team_id")
    out = raw.select(*[F.col(c).cast("double" if c in PROBABILITIES else "long" if c in long else "timestamp" if c == "kickoff" else "string").alias(c) for c in PREDICTION])
    C.enforce(prediction_violations(out))
    return out


def evaluation_report(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """``(section, name, value)``: rows and classes of both parts of the split, metrics and confusion of the predictions.

    ``rows`` have ``dataset_split`` and ``result``, ``predictions`` ``actual``, ``predicted`` and the probabilities. Three
    aggregates, none of which depends on the data's size in what it keeps.
    """
    one = lambda section, name, value: F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), value.cast("double").alias("value"))
    here = lambda part: F.col("dataset_split") == part
    counts = [one("split", f"{part}_row_count", F.count_if(here(part))) for part in ("train", "test")]
    counts += [one(f"{part}_class_counts", y, F.count_if(here(part) & (F.col("result") == y))) for part in ("train", "test") for y in E.LABELS]
    cells = [one("confusion", f"{a}|{b}", F.count_if((F.col("actual") == a) & (F.col("predicted") == b))) for a in E.LABELS for b in E.LABELS]
    m = E.metrics(predictions.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")
    scores = m.select(F.explode(F.array(*[one("metrics", c, F.col(c)) for c in m.columns])).alias("x"))
    explode = lambda df, structs: df.agg(F.array(*structs).alias("a")).select(F.explode("a").alias("x"))
    return explode(rows, counts).unionByName(scores).unionByName(explode(predictions, cells)).select("x.*")


def report_document(report: DataFrame, experiment: str, season: int, features: Sequence[str], inputs: dict[str, str], model: dict) -> dict:
    """The report as a nested document with what it was made from. ``report`` has a fixed, small number of rows."""
    out: dict = {"experiment": experiment, "season": season, "input_paths": inputs, "model": model, "target_classes": list(E.LABELS), "feature_columns": list(features)}
    for r in report.orderBy("section", "name").collect():
        whole = r["section"] != "metrics" or r["name"] == "rows"
        out.setdefault(r["section"], {})[r["name"]] = int(r["value"]) if whole else r["value"]
    cells = out.pop("confusion", {})
    out["confusion_matrix"] = {"labels": list(E.LABELS), "orientation": "rows=true classes, columns=predicted classes", "values": [[cells.get(f"{a}|{b}", 0) for b in E.LABELS] for a in E.LABELS]}
    return out
