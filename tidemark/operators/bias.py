"""How ratings lean: by indicator, by team, and against ratings of people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import checks as C

LOWEST, HIGHEST = -2, 2


def long_ratings(notes: DataFrame, keys: Sequence[str], indicators: Sequence[str]) -> DataFrame:
    """``(keys, indicator, rating)``: one row for each rating, null where the indicator is not mentioned."""
    each = F.array(*[F.struct(F.lit(i).alias("indicator"), F.col(i).cast("int").alias("rating")) for i in indicators])
    return notes.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")


def keyed_rows(rows: DataFrame, key: str) -> DataFrame:
    """The rows that begin a record: those without a key only go on with a text of the row before."""
    return rows.filter(F.col(key).isNotNull())


def continuation_violations(rows: DataFrame, key: str, place: str, ratings: Sequence[str]) -> DataFrame:
    """Rows that go on with a record and yet carry ratings."""
    empty = F.lit(True)
    for c in ratings:
        empty = empty & F.col(c).isNull()
    return C.holds(rows.filter(F.col(key).isNull()), "continuation", empty, [place])


def mention_summary(ratings: DataFrame, keys: Sequence[str] = ("indicator",)) -> DataFrame:
    """Per key: ratings in all, how many mention the indicator, their share, sum and mean."""
    n = F.count("rating")
    return ratings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), n.alias("mentions"), (n / F.count(F.lit(1))).alias("share"), F.sum("rating").alias("sum"), F.avg("rating").alias("mean"))


def rating_shares(ratings: DataFrame) -> DataFrame:
    """``(indicator, rating, n, percent)`` of every rating from the lowest to the highest, zero-filled."""
    scale = range(LOWEST, HIGHEST + 1)
    per = ratings.groupBy("indicator").agg(F.count("rating").alias("_n"), *[F.count_if(F.col("rating") == v).alias(f"r{v}") for v in scale])
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("rating"), F.col(f"r{v}").alias("n")) for v in scale]))
    return per.select("indicator", "_n", rows.alias("x")).select("indicator", "x.rating", "x.n", F.coalesce(F.try_divide(100.0 * F.col("x.n"), F.col("_n")), F.lit(0.0)).alias("percent"))


def human_difference(model: DataFrame, human: DataFrame, key: str, indicators: Sequence[str]) -> DataFrame:
    """Per indicator, over the tasks that both mention: how many, the share of equal ratings, the mean of model less human."""
    a, b = (long_ratings(x, [key], indicators).filter(F.col("rating").isNotNull()) for x in (model, human))
    both = a.withColumnRenamed("rating", "a").join(b.withColumnRenamed("rating", "b"), [key, "indicator"])
    return both.groupBy("indicator").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("equal"), F.avg(F.col("a") - F.col("b")).alias("difference"))


def bias_report(model: DataFrame, human: DataFrame, key: str, team: str, indicators: Sequence[str]) -> DataFrame:
    """``(section, indicator, name, n, value)``: means by indicator, shares of ratings, means by team, difference to people."""
    ratings = long_ratings(model, [key, team], indicators)
    part = lambda df, section, name, n, value: df.select(F.lit(section).alias("section"), "indicator", name.cast("string").alias("name"), F.col(n).cast("long").alias("n"), F.col(value).alias("value"))
    out = part(mention_summary(ratings), "indicator", F.lit("mean"), "mentions", "mean")
    out = out.unionByName(part(rating_shares(ratings), "rating", F.col("rating"), "n", "percent"))
    out = out.unionByName(part(mention_summary(ratings, [team, "indicator"]), "team", F.col(team), "mentions", "mean"))
    people = human_difference(model, human, key, indicators)
    return out.unionByName(part(people, "human", F.lit("equal"), "n", "equal")).unionByName(part(people, "human", F.lit("difference"), "n", "difference"))
