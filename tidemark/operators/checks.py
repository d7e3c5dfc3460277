"""Constraint operators: every check is a table of violations ``(check, key, detail)``; empty means it holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A check has violations; the message names the first few."""


def _rows(df: DataFrame, check: str, key: Sequence[str], detail: Column) -> DataFrame:
    keyed = F.concat_ws("|", *[F.col(k).cast("string") for k in key]) if key else F.lit("")
    return df.select(F.lit(check).alias("check"), keyed.alias("key"), detail.cast("string").alias("detail"))


def dealt(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows dealt by a key to as many tasks as the session's shuffles have. Adaptive execution sizes tasks by compressed
    bytes, of which ids in order have next to none: it may put all of them into one. For keys that few rows share."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def holds(df: DataFrame, check: str, rule: Column, key: Sequence[str], detail: Column | None = None) -> DataFrame:
    """Rows for which ``rule`` is not true (null counts as a violation)."""
    return _rows(df.filter(~F.coalesce(rule, F.lit(False))), check, key, F.lit("rule broken") if detail is None else detail)


def not_empty(df: DataFrame, check: str = "not_empty") -> DataFrame:
    """One violation for an empty table."""
    return df.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(check).alias("check"), F.lit("").alias("key"), F.lit("no rows").alias("detail"))


def exact_columns(df: DataFrame, columns: Sequence[str], check: str = "columns") -> DataFrame:
    """One violation if names or their order differ."""
    bad = [] if list(df.columns) == list(columns) else [(check, "", f"expected {list(columns)}, found {list(df.columns)}")]
    return df.sparkSession.createDataFrame(bad, "check string, key string, detail string")


def required(df: DataFrame, columns: Mapping[str, str], key: Sequence[str], check: str = "required") -> DataFrame:
    """Values by column: ``text`` (not blank), ``count`` (not negative), ``positive``, ``finite`` or ``present``."""
    rules = {"text": lambda c: F.trim(c) != "", "count": lambda c: c >= 0, "positive": lambda c: c > 0, "finite": lambda c: ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), "present": lambda c: c.isNotNull()}
    found = F.filter(F.array(*[F.when(~F.coalesce(rules[kind](F.col(c)), F.lit(False)), F.lit(f"{c}:{kind}")) for c, kind in columns.items()]), lambda x: x.isNotNull())
    bad = df.withColumn("_bad", F.explode(found))
    return _rows(bad, check, key, F.col("_bad"))


def unique(df: DataFrame, key: Sequence[str], check: str = "unique") -> DataFrame:
    """Keys that occur more than once, with their count."""
    return _rows(df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), check, key, F.col("_n"))


def covers(left: DataFrame, right: DataFrame, key: Sequence[str], check: str = "coverage", both: bool = True) -> DataFrame:
    """Keys of one side that the other lacks."""
    lacks = lambda a, b, what: _rows(a.select(*key).distinct().join(b.select(*key).distinct(), list(key), "left_anti"), check, key, F.lit(what))
    out = lacks(left, right, "only left")
    return out.unionByName(lacks(right, left, "only right")) if both else out


def single_valued(df: DataFrame, key: Sequence[str], values: Sequence[str], check: str = "conflict") -> DataFrame:
    """Keys under which the values are not all equal (nulls are values)."""
    kinds = F.count_distinct(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}))
    return _rows(df.groupBy(*key).agg(kinds.alias("_n")).filter("_n > 1"), check, key, F.col("_n"))


def constant(df: DataFrame, columns: Sequence[str], check: str = "constant") -> DataFrame:
    """One violation for each column with several values."""
    n = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return n.select(F.explode(F.array(*[F.struct(F.lit(check).alias("check"), F.lit(c).alias("key"), F.col(c).alias("detail")) for c in columns])).alias("x")).select("x.check", "x.key", F.col("x.detail").cast("string").alias("detail")).filter(F.col("detail").cast("int") > 1)


def rederived(df: DataFrame, column: str, value: Column, key: Sequence[str], check: str = "identity") -> DataFrame:
    """Rows whose stored id is not the one derived from their fields."""
    return holds(df, check, F.col(column).eqNullSafe(value), key, F.col(column))


def equal_fields(left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str], check: str = "fields") -> DataFrame:
    """Keys of both sides with the first field that differs, null-safely."""
    j = left.select(*key, *[F.col(f).alias(f"_l_{f}") for f in fields]).join(right.select(*key, *[F.col(f).alias(f"_r_{f}") for f in fields]), list(key))
    bad = F.coalesce(*[F.when(~F.col(f"_l_{f}").eqNullSafe(F.col(f"_r_{f}")), F.lit(f)) for f in fields])
    return _rows(j.withColumn("_f", bad).filter(F.col("_f").isNotNull()), check, key, F.col("_f"))


def chronological(df: DataFrame, earlier: Column, later: Column, ts: str, check: str = "chronology") -> DataFrame:
    """One violation if a row of the earlier part is not before all of the later part."""
    m = df.agg(F.max(F.when(earlier, F.col(ts))).alias("a"), F.min(F.when(later, F.col(ts))).alias("b"))
    return m.filter(~(F.col("a") < F.col("b"))).select(F.lit(check).alias("check"), F.lit("").alias("key"), F.concat_ws(" >= ", F.col("a").cast("string"), F.col("b").cast("string")).alias("detail"))


def probabilities(df: DataFrame, columns: Sequence[str], key: Sequence[str], check: str = "probabilities", tolerance: float = 1e-12) -> DataFrame:
    """Rows whose probabilities leave [0, 1] or do not add up to 1."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    inside = reduce(lambda a, b: a & b, [F.col(c).between(0.0, 1.0) for c in columns])
    return holds(df, check, inside & (F.abs(total - 1.0) <= tolerance), key, total)


def identities(report: DataFrame, rules: Mapping[str, Column], check: str = "accounting") -> DataFrame:
    """Accounting identities of a one-row report: a violation for each that fails."""
    rows = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return report.select(F.lit(check).alias("check"), F.explode(rows).alias("key"), F.lit("does not add up").alias("detail"))


def report(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)


def enforce(*violations: DataFrame, show: int = 5) -> None:
    """Raise ``CheckFailed`` if any check has violations."""
    first = report(*violations).limit(show).collect()
    if first:
        raise CheckFailed("; ".join(f"{r['check']}[{r['key']}]: {r['detail']}" for r in first))
