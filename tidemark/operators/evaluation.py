"""Evaluation operators: metrics, confusion, calibration, exact tests, priors, standardization, model selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

LABELS = ("H", "D", "A")
PROBS = ("p_h", "p_d", "p_a")


def with_row_metrics(pred: DataFrame, labels: Sequence[str] = LABELS, probs: Sequence[str] = PROBS) -> DataFrame:
    """Adds log_loss, brier and correct to prediction rows."""
    p_true = F.coalesce(*[F.when(F.col("actual") == y, F.col(p)) for y, p in zip(labels, probs)])
    brier = sum(((F.when(F.col("actual") == y, 1.0).otherwise(0.0) - F.col(p)) ** 2 for y, p in zip(labels, probs)), F.lit(0.0))
    return pred.withColumns({"log_loss": S.row_log_loss(p_true), "brier": brier, "correct": F.col("actual") == F.col("predicted")})


def class_table(pred: DataFrame, keys: Sequence[str], labels: Sequence[str] = LABELS) -> DataFrame:
    """Per key and class: support, predicted count, precision, recall and F1 (0 where undefined)."""
    rows = pred.groupBy(*keys).agg(*[f for y in labels for f in (F.count_if(F.col("actual") == y).alias(f"s_{y}"), F.count_if(F.col("predicted") == y).alias(f"n_{y}"), F.count_if((F.col("actual") == y) & (F.col("predicted") == y)).alias(f"t_{y}"))])
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(y).alias("label"), F.col(f"s_{y}").alias("support"), F.col(f"n_{y}").alias("predicted_n"), F.col(f"t_{y}").alias("hits")) for y in labels])).alias("x")).select(*keys, "x.*")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return long.withColumns({"precision": ratio(F.col("hits"), F.col("predicted_n")), "recall": ratio(F.col("hits"), F.col("support")), "f1": ratio(2 * F.col("hits"), F.col("predicted_n") + F.col("support"))})


def metrics(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: rows, log loss, accuracy, macro F1, Brier score."""
    m = with_row_metrics(pred).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg("log_loss").alias("log_loss"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("brier").alias("brier"))
    f1 = class_table(pred, keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))
    return m.join(f1, list(keys))


def confusion(pred: DataFrame, keys: Sequence[str], labels: Sequence[str] = LABELS) -> DataFrame:
    """Rows true, columns predicted, zero-filled in the labels' order."""
    per = pred.groupBy(*keys).agg(*[F.count_if((F.col("actual") == y) & (F.col("predicted") == z)).alias(f"{y}{z}") for y in labels for z in labels])
    return per.select(*keys, F.explode(F.array(*[F.struct(F.lit(y).alias("actual"), *[F.col(f"{y}{z}").alias(f"n_{z}") for z in labels]) for y in labels])).alias("x")).select(*keys, "x.*")


def calibration(pred: DataFrame, keys: Sequence[str], labels: Sequence[str] = LABELS, probs: Sequence[str] = PROBS) -> DataFrame:
    """Per class: observed share against the mean predicted probability."""
    per = pred.groupBy(*keys).agg(*[f for y, p in zip(labels, probs) for f in (F.avg((F.col("actual") == y).cast("double")).alias(f"o_{y}"), F.avg(p).alias(f"m_{y}"))])
    return per.select(*keys, F.explode(F.array(*[F.struct(F.lit(y).alias("label"), F.col(f"o_{y}").alias("observed"), F.col(f"m_{y}").alias("expected")) for y in labels])).alias("x")).select(*keys, "x.*")


def paired(pred: DataFrame, baseline: int, candidate: int, model: str = "mdl") -> DataFrame:
    """Both models' row metrics side by side, with the gain in log loss."""
    m = with_row_metrics(pred)
    side = lambda v, p: m.filter(F.col(model) == v).select("match_id", "league", "matchday", F.col("log_loss").alias(f"{p}_loss"), F.col("correct").alias(f"{p}_correct"))
    return side(baseline, "base").join(side(candidate, "cand").drop("league", "matchday"), "match_id").withColumn("gain", F.col("base_loss") - F.col("cand_loss"))


def sign_flip_test(gains: DataFrame, keys: Sequence[str], block: str = "matchday", value: str = "gain", most: int = 20) -> DataFrame:
    """Exact two-sided sign-flip test on block means: ``(keys, blocks, gain, p_value)``.

    All 2**k sign vectors of a key's k block means are visited inside one row; k beyond ``most`` is an error.
    """
    means = gains.groupBy(*keys, block).agg(F.avg(value).alias("m")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(block, "m"))).alias("ms"))
    means = means.select(*keys, F.transform("ms", lambda x: x["m"]).alias("ms"))
    k = F.size("ms")
    guard = F.when(k > most, F.raise_error(F.lit("too many blocks for an exact test"))).otherwise(F.pow(F.lit(2.0), k).cast("int") - 1)
    observed = F.abs(F.aggregate("ms", F.lit(0.0), lambda s, x: s + x)) / k
    flipped = F.transform(F.sequence(F.lit(0), guard), lambda v: F.abs(F.aggregate(F.transform("ms", lambda x, i: F.when(F.getbit(v, i) == 1, x).otherwise(-x)), F.lit(0.0), lambda s, x: s + x)) / F.size("ms"))
    extreme = F.size(F.filter(flipped, lambda z: z >= observed - 1e-15))
    return means.select(*keys, k.alias("blocks"), (F.aggregate("ms", F.lit(0.0), lambda s, x: s + x) / k).alias("gain"), (extreme / F.pow(F.lit(2.0), k)).alias("p_value"))


def mcnemar(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """2x2 contingency of correctness and the exact two-sided binomial p-value of its discordant cells."""
    b, c = F.col("base_correct"), F.col("cand_correct")
    t = pairs.groupBy(*keys).agg(F.count_if(b & c).alias("both"), F.count_if(b & ~c).alias("base_only"), F.count_if(~b & c).alias("cand_only"), F.count_if(~b & ~c).alias("neither"))
    n, k = F.col("base_only") + F.col("cand_only"), F.least("base_only", "cand_only")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    step = lambda s, i: F.struct((s["term"] * (n - i + 1) / i).alias("term"), (s["sum"] + s["term"] * (n - i + 1) / i).alias("sum"))
    tail = F.when(k == 0, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1))), start, step, lambda s: s["sum"]))
    return t.withColumn("p_value", F.least(F.lit(1.0), 2.0 * tail / F.pow(F.lit(2.0), n)))


def class_counts(df: DataFrame, keys: Sequence[str], label: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """Counts and shares in the labels' order, zero-filled."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(label) == y).alias(f"c_{y}") for y in labels])
    return per.select(*keys, "_n", F.explode(F.array(*[F.struct(F.lit(y).alias("label"), F.col(f"c_{y}").alias("n")) for y in labels])).alias("x")).select(*keys, "x.label", "x.n", (F.col("x.n") / F.col("_n")).alias("share"))


def prior_predictions(train: DataFrame, test: DataFrame, label: str = "result", labels: Sequence[str] = LABELS) -> DataFrame:
    """Every test row with the training classes' shares and their majority (first in the labels' order)."""
    shares = train.agg(*[F.avg((F.col(label) == y).cast("double")).alias(p) for y, p in zip(labels, PROBS)])
    return test.crossJoin(F.broadcast(shares)).withColumn("predicted", S.argmax_label(list(labels), [F.col(p) for p in PROBS]))


def standardize(df: DataFrame, is_train: Column, columns: Sequence[str]) -> DataFrame:
    """Columns less the training rows' mean over their population deviation (1 where that is 0)."""
    stats = df.filter(is_train).agg(*[f for c in columns for f in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    out = df.crossJoin(F.broadcast(stats))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return out.withColumns(scaled).select(df.columns)


def fold_summary(fold_metrics: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, population and sample deviation, and the standard error of the mean over folds."""
    n = F.count(value)
    return fold_metrics.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd_pop"), F.stddev_samp(value).alias("sd_samp"), (F.stddev_samp(value) / F.sqrt(n)).alias("se"))


def one_standard_error(candidates: DataFrame) -> DataFrame:
    """Ranks candidates ``(model_id, feature_count, c, loss, se)``: strict by loss; eligible within one standard
    error of the best, simplest first; the others after them. Candidates equal in all of these go by their id, so
    ranks are the same in every run. One row a candidate, so the unpartitioned windows stay small."""
    everything = Window.partitionBy(F.lit(1))
    strict = F.row_number().over(everything.orderBy("loss", "feature_count", "c", "model_id"))
    c = candidates.withColumn("strict_rank", strict)
    limit = F.min(F.when(F.col("strict_rank") == 1, F.col("loss") + F.col("se"))).over(everything)
    c = c.withColumn("eligible", F.col("loss") <= limit)
    pick = lambda col: F.when(F.col("eligible"), F.col(col))
    order = [F.desc("eligible"), pick("feature_count"), pick("c"), pick("loss"), "strict_rank"]
    return c.withColumn("selection_rank", F.row_number().over(everything.orderBy(*order)))


def logistic(train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "result", c: float = 1.0, labels: Sequence[str] = LABELS, max_iter: int = 1000, tol: float = 1e-9):
    """(model, test rows with probabilities): L2 multinomial regression on standardized features.

    ``c`` weighs the summed loss as in ``sum(loss) * c + |w|^2 / 2``; intercepts are free. Not converging is an error.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    both = standardize(train.withColumn("_train", F.lit(True)).unionByName(test.withColumn("_train", F.lit(False))), F.col("_train"), features)
    both = VectorAssembler(inputCols=list(features), outputCol="_x").transform(both.withColumn("_y", F.coalesce(*[F.when(F.col(label) == y, float(i)) for i, y in enumerate(labels)])))
    fit = both.filter("_train").cache()
    n = fit.count()
    model = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol).fit(fit)
    fit.unpersist()
    if model.summary.totalIterations >= max_iter:
        raise RuntimeError("the regression did not converge")
    p = vector_to_array("probability")
    out = model.transform(both.filter(~F.col("_train"))).withColumns({q: p[i] for i, q in enumerate(PROBS[: len(labels)])})
    return model, out.withColumn("predicted", S.argmax_label(list(labels), [F.col(q) for q in PROBS[: len(labels)]])).drop("_x", "_y", "_train", "rawPrediction", "probability", "prediction")
