"""Where results come from: canonical JSON and its digests, artifacts in a hash chain, results of one configuration."""

from __future__ import annotations

import json
import random
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch
from . import checks as C

#: What an annotation result repeats of its task.
CONTEXT = ("request_id", "article_id", "content_id", "match_id", "season", "league", "side", "target_team", "opponent_team")


@F.pandas_udf(T.StringType())
def _canonical(s: pd.Series) -> pd.Series:
    def one(x):
        try:
            return None if x is None else json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return s.map(one)


def canonical(c: Column) -> Column:
    """JSON text with the keys of every object sorted, without white space; null for what is no JSON.

    Variants keep their keys sorted, so plain texts (ASCII without escapes, numbers without fraction or exponent) are
    rewritten in the JVM; the others, whose order of keys or form of numbers could differ, go through Arrow. Of a
    repeated key the last value counts.
    """
    plain = (F.length(c) == F.octet_length(c)) & ~c.rlike(r"\\|[0-9][.eE]|[0-9]{18}|-0|NaN|Infinity|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
    fast = F.when(plain, F.to_json(F.try_parse_json(F.when(plain, c))))
    return F.coalesce(fast, _canonical(F.when(fast.isNull(), c)))


def digest(c: Column) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical(c), 256)


def artifact_digests(spark: SparkSession, artifacts: Mapping[str, str]) -> DataFrame:
    """``(position, artifact, files, sha256)`` of files or folders: of a folder, the digest over the names and digests of its
    files. Large files are hashed where they are read; the driver sees none of them."""
    parts = []
    for i, (name, path) in enumerate(artifacts.items()):
        f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        one = f.select(F.struct(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha")).alias("x"))
        parts.append(one.agg(F.sort_array(F.collect_list("x")).alias("l")).select(F.lit(i).alias("position"), F.lit(name).alias("artifact"), F.size("l").alias("files"), F.sha2(F.to_json("l"), 256).alias("sha256")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chain(digests: DataFrame) -> DataFrame:
    """``digests`` with ``link``: each artifact's name and digest hashed with the link before. One row an artifact, a few in all."""
    step = lambda done, x: F.concat(done, F.array(F.struct(x["position"].alias("position"), x["artifact"].alias("artifact"), x["sha256"].alias("sha256"), F.sha2(F.concat_ws("\n", F.coalesce(F.try_element_at(done, F.lit(-1))["link"], F.lit("")), x["artifact"], x["sha256"]), 256).alias("link"))))
    rows = digests.agg(F.sort_array(F.collect_list(F.struct("position", "artifact", "sha256"))).alias("l"))
    start = F.array().cast("array<struct<position:int,artifact:string,sha256:string,link:string>>")
    return rows.select(F.inline(F.aggregate("l", start, step)))


def chain_violations(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """Artifacts that changed, are gone or are new since the chain was recorded, and a record whose links do not follow."""
    a, b = recorded.alias("a"), now.alias("b")
    both = a.join(b, F.col("a.artifact") == F.col("b.artifact"), "full")
    what = F.when(F.col("b.artifact").isNull(), "gone").when(F.col("a.artifact").isNull(), "new").when(F.col("a.sha256") != F.col("b.sha256"), "changed")
    found = both.select(F.coalesce("a.artifact", "b.artifact").alias("artifact"), what.alias("what")).filter(F.col("what").isNotNull())
    listed = found.select(F.lit("artifact").alias("check"), F.col("artifact").alias("key"), F.col("what").alias("detail"))
    again = chain(recorded.select("position", "artifact", "sha256")).select("position", F.col("link").alias("_link"))
    broken = recorded.join(again, "position").filter(~F.col("link").eqNullSafe(F.col("_link")))
    return listed.unionByName(broken.select(F.lit("chain").alias("check"), F.col("artifact").alias("key"), F.lit("link does not follow").alias("detail")))


def selected(results: DataFrame, config_sha: str) -> DataFrame:
    """The results of one configuration."""
    return results.filter(F.col("annotation_config_sha256") == config_sha)


def result_violations(results: DataFrame, tasks: DataFrame, fields: Sequence[str] = CONTEXT) -> DataFrame:
    """What keeps one configuration's results from being used: ids or tasks given twice, unknown tasks, a context that is not
    the task's, several models or digests."""
    key = ["task_id"]
    by_task, known = C.dealt(results, key), C.dealt(tasks, key)
    return C.report(
        C.unique(C.dealt(results, ["annotation_id"]), ["annotation_id"], "annotation id"), C.unique(by_task, key, "task"), C.covers(by_task, known, key, "unknown task", both=False),
        C.equal_fields(by_task, known, key, fields, "context"), C.constant(results, ["model", "model_digest"], "provenance"),
    )


def report_violations(report: DataFrame, expected: Mapping[str, str | int], key: Sequence[str] = ()) -> DataFrame:
    """Fields of a report that do not name the configuration, model or input that they should."""
    bad = F.array_compact(F.array(*[F.when(~F.col(c).cast("string").eqNullSafe(F.lit(str(v))), F.lit(c)) for c, v in expected.items()]))
    rows = report.withColumn("_bad", F.explode(bad))
    return rows.select(F.lit("report").alias("check"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key"), F.col("_bad").alias("detail"))


def annotation_rows(tasks: DataFrame, answers: DataFrame, config: Mapping[str, str], indicators: Sequence[str], kept: Sequence[str] = CONTEXT) -> tuple[DataFrame, DataFrame]:
    """(annotations, failures) of tasks and their answers ``(task_id, answer, error)``: an answer's ratings and evidence as
    columns with the task's context and the configuration, or the error with the number of the failure so far."""
    ident = F.sha2(F.concat(F.lit('[1,"'), F.concat_ws('","', "task_id", F.lit(config["annotation_config_sha256"]), F.lit(config["model_digest"])), F.lit('"]')), 256)
    both = tasks.join(answers, "task_id").withColumn("annotation_id", ident)
    fixed = [F.lit(v).alias(c) for c, v in config.items()]
    kind = "struct<" + ",".join(f"{i}:struct<rating:string,evidence:array<string>>" for i in indicators) + ">"
    good = both.filter(F.col("error").isNull()).withColumn("_a", F.from_json("answer", kind))
    rated = [x for i in indicators for x in (F.col(f"_a.{i}.rating").alias(f"{i}_rating"), F.col(f"_a.{i}.evidence").alias(f"{i}_evidence"))]
    context = [c for c in kept if c in tasks.columns]
    number = F.row_number().over(Window.partitionBy("annotation_id").orderBy("attempt"))
    failed = both.filter(F.col("error").isNotNull())
    failed = failed if "attempt" in failed.columns else failed.withColumn("attempt", F.lit(1))
    return good.select("annotation_id", "task_id", *context, *fixed, *rated), failed.select("annotation_id", "task_id", *context, *fixed, "error", number.alias("failure_sequence"))


# schemas of variants -----------------------------------------------------------------------------------------


def _walk(v: Column, spec: Mapping, path: Column) -> Column:
    """Violations at and below one value, each as ``path: what``."""
    none = F.array().cast("array<string>")
    said = lambda what: F.array(F.concat(path, F.lit(f": {what}")))
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    if "enum" in spec:
        texts = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in spec["enum"]]
        return F.when(F.coalesce(F.to_json(v), F.lit("null")).isin(*texts), none).otherwise(said("not one of the values"))
    want = spec.get("type")
    if want == "object":
        keys = F.coalesce(F.json_object_keys(F.to_json(v)), none)
        known = spec.get("properties", {})
        found = [F.transform(F.array_except(F.array(*map(F.lit, spec["required"])), keys), lambda k: F.concat(path, F.lit("."), k, F.lit(": missing")))] if spec.get("required") else []
        if spec.get("additionalProperties") is False:
            found.append(F.transform(F.array_except(keys, F.array(*map(F.lit, known)).cast("array<string>")), lambda k: F.concat(path, F.lit("."), k, F.lit(": unknown"))))
        for k, below in known.items():
            found.append(F.when(F.array_contains(keys, k), _walk(F.try_variant_get(v, f"$['{k}']", "variant"), below, F.concat(path, F.lit(f".{k}")))).otherwise(none))
        return F.when(kind.startswith("OBJECT"), F.concat(*found) if found else none).otherwise(said("not an object"))
    if want == "array":
        items = F.try_variant_get(v, "$", "array<variant>")
        found = [F.when(F.size(items) > spec["maxItems"], said(f"more than {spec['maxItems']} items")).otherwise(none)] if "maxItems" in spec else []
        if "items" in spec:
            found.append(F.flatten(F.transform(items, lambda x, i: _walk(x, spec["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
        return F.when(kind.startswith("ARRAY"), F.concat(*found) if found else none).otherwise(said("not an array"))
    if want == "string":
        short = F.when(F.length(F.try_variant_get(v, "$", "string")) < spec.get("minLength", 0), said("too short")).otherwise(none)
        return F.when(kind == "STRING", short).otherwise(said("not a string"))
    names = {"integer": ("BIGINT",), "boolean": ("BOOLEAN",), "null": ("VOID",), "number": ("BIGINT", "DOUBLE", "FLOAT")}.get(want)
    if names is None:
        return none
    ok = kind.isin(*names) | (kind.startswith("DECIMAL") if want == "number" else F.lit(False))
    return F.when(ok, none).otherwise(said(f"not of type {want}"))


def schema_violations(rows: DataFrame, key: Sequence[str], body: str, spec: Mapping) -> DataFrame:
    """Where documents depart from a schema: one row for each path. Known words: type, properties, required,
    additionalProperties, items, maxItems, minLength, enum. What is no JSON departs at the root."""
    v = F.try_parse_json(body)
    found = F.when(v.isNull(), F.array(F.lit("$: no JSON"))).otherwise(_walk(v, spec, F.lit("$")))
    out = rows.select(*key, F.explode(found).alias("_w"))
    return out.select(F.lit("schema").alias("check"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key"), F.col("_w").alias("detail"))


def alias_violations(aliases: DataFrame) -> DataFrame:
    """Aliases ``(team, alias)`` that cannot tell teams apart whatever their case: given twice for a team, or shared by teams."""
    folded = aliases.withColumn("_f", F.lower(F.upper("alias")))
    per = folded.groupBy("_f").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("team")).alias("teams")).filter("n > 1")
    return per.select(F.lit("alias").alias("check"), F.col("_f").alias("key"), F.array_join("teams", ",").alias("detail"))


# samples -----------------------------------------------------------------------------------------------------


def positions(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``position``, the place (from 0) in the order of ``by``, nulls first.

    Written range-partitioned, each file sorted; a row's position is its place in its file and the rows of the files before,
    of which only the counts, one for each file, come together.
    """
    spark = rows.sparkSession
    path = scratch(spark, "positions")
    rows.orderBy(by).write.parquet(path)
    kept = spark.read.parquet(path).select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = kept.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", before).drop("n")
    return kept.join(F.broadcast(files), "_file").withColumn("position", F.col("_before") + F.col("_at")).drop("_file", "_at", "_before")


def seeded_sample(rows: DataFrame, by: str, seed: int, size: int) -> DataFrame:
    """``rows`` at the places that Python's seeded generator draws from the sorted ``by``, with ``ordinal``, in its order.

    ``by`` is unique; a size below 1 or beyond the rows is an error. The generator draws places, so only the number of
    rows and ``size`` places are on the driver.
    """
    n = rows.count()
    if not 1 <= size <= n:
        raise ValueError(f"the sample size must lie between 1 and {n}")
    drawn = [(i, p) for i, p in enumerate(random.Random(seed).sample(range(n), size), 1)]
    places = rows.sparkSession.createDataFrame(drawn, "ordinal int, position long")
    return positions(rows, by).join(places, "position").drop("position")
