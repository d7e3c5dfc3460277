"""Readers and writers: JSON documents, JSON lines, CSV, directories of responses, single documents, layouts."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON array (or object) a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One JSON object a line; blank lines are skipped and a leading byte order mark is allowed.

    ``strict`` fails on a line that is no object of the schema; otherwise such lines stay in ``_corrupt_record``.
    """
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    fields = (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fields
    return spark.read.schema(T.StructType([*fields, T.StructField("_corrupt_record", T.StringType())])).json(path)


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = (), encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header, all text: names stripped, blank rows dropped, blank values null.

    Empty or repeated names and missing required columns are errors.
    """
    raw = spark.read.option("header", False).option("encoding", encoding).option("multiLine", True).csv(path)
    head = raw.first()
    names = [(x or "").lstrip("﻿").strip() for x in (head or ())]
    if not names or "" in names or len(set(names)) < len(names):
        raise ValueError(f"bad header: {names}")
    if lacking := [c for c in required if c not in names]:
        raise ValueError(f"missing columns: {lacking}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    df = spark.read.schema(schema).option("header", True).option("encoding", encoding).option("multiLine", True).option("enforceSchema", True).csv(path)
    return df.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in names]).na.drop("all")


# What the bytes 0x80 to 0x9f stand for in the single-byte code page; five of them for nothing.
HIGH = "\u20ac\x81\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\x8d\u017d\x8f\x90\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\x9d\u017e\u0178"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``(path, encoding, text)`` of whole files: UTF-8, a byte order mark dropped, or else the single-byte code page.

    Each file is judged by its own bytes. A file that is neither (a byte that stands for nothing) is an error; an empty file
    gives no row, as Spark does not read it.
    """
    f = spark.read.format("binaryFile").load(path).select("path", "content")
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    single = F.decode("content", "ISO-8859-1")
    nothing = single.rlike("[\x81\x8d\x8f\x90\x9d]")
    low = "".join(map(chr, range(0x80, 0xA0)))
    decoded = F.when(nothing, F.raise_error(F.concat(F.lit("neither encoding fits "), "path"))).otherwise(F.translate(single, low, HIGH))
    text = F.when(utf8, F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")).otherwise(decoded)
    return f.select("path", F.when(utf8, "utf-8").otherwise("cp1252").alias("encoding"), text.alias("text"))


def read_mixed_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """CSV files of either encoding with one header: as ``read_csv``, with ``path``; a record is a line."""
    lines = read_text(spark, path).select("path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("at", "line")).filter(F.trim("line") != "")
    heads = lines.groupBy("path").agg(F.min_by("line", "at").alias("head"), F.min("at").alias("first"))
    found = [r.head for r in heads.select("head").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError("no header" if not found else "files with different headers")
    names = [(x or "").strip() for x in spark.createDataFrame([(found[0],)], "h string").select(F.from_csv("h", ", ".join(f"c{i} string" for i in range(found[0].count(",") + 1))).alias("h")).first().h]
    if "" in names or len(set(names)) < len(names):
        raise ValueError(f"bad header: {names}")
    if lacking := [c for c in required if c not in names]:
        raise ValueError(f"missing columns: {lacking}")
    body = lines.join(F.broadcast(heads.select(F.col("path").alias("_p"), "first")), (F.col("path") == F.col("_p")) & (F.col("at") > F.col("first")))
    rows = body.select("path", F.from_csv("line", ", ".join(f"c{i} string" for i in range(len(names)))).alias("r"))
    out = rows.select("path", *[F.nullif(F.trim(F.col(f"r.c{i}")), F.lit("")).alias(n) for i, n in enumerate(names)])
    return out.na.drop("all", subset=[f"`{n}`" for n in names])


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether all bytes of a file are UTF-8, to choose between two encodings."""
    return bool(spark.read.format("binaryFile").load(path).select(F.is_valid_utf8(F.col("content").cast("string")).alias("ok")).agg(F.min("ok")).first()[0])


def read_responses(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """A folder of ``key.json`` documents, each with its key."""
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("request_id"), "*")


def numbered(df: DataFrame, column: str, ordinal: str = "ordinal", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row an element of an array of structs, numbered from 1 before anything is filtered."""
    return df.select(*keep, F.posexplode(column).alias("_p", "_e")).select(*keep, (F.col("_p") + 1).alias(ordinal), "_e.*")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append to a log of JSON lines; each call adds files and rewrites none."""
    write_jsonl(df, path, "append")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in a fixed order; columns beyond them are an error; lines end in CR LF, nulls are empty."""
    if extra := [c for c in df.columns if c not in columns]:
        raise ValueError(f"columns not in the layout: {extra}")
    df.select(*columns).write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def document(df: DataFrame) -> str:
    """The single row of a report as indented JSON, non-ASCII kept and nulls written."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a document needs one row")
    return json.dumps(json.loads(rows[0]["j"]), indent=2, ensure_ascii=False) + "\n"


@dataclass(frozen=True)
class Layout:
    """Where a season's tables lie."""

    root: str
    season: int

    def path(self, stage: str, name: str) -> str:
        if stage not in ("raw", "interim", "processed", "reports"):
            raise ValueError(f"unknown stage {stage!r}")
        return str(PurePosixPath(self.root) / stage / f"season={self.season}" / name)
