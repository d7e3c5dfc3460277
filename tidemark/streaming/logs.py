"""Append-only logs and their streaming twins: resume, dead letters, rolling state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import append_jsonl


def remaining(tasks: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Tasks whose id is not in the log."""
    return tasks.join(log.select(key).distinct(), key, "left_anti")


def annotate(tasks: DataFrame, annotator: Callable[[pd.DataFrame], pd.DataFrame], schema: str, workers: int | None = None) -> DataFrame:
    """Rows of ``annotator`` over batches of tasks; ``workers`` bounds how many run at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield annotator(b)

    return (tasks.repartition(workers) if workers else tasks).mapInPandas(run, schema)


def run_pending(tasks: DataFrame, log_path: str, key: str, annotator: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> int:
    """Annotate what the log lacks and append it; returns how many rows the log then has. Reruns add nothing."""
    spark = tasks.sparkSession
    log = _read_log(spark, log_path, schema)
    todo = tasks if log is None else remaining(tasks, log, key)
    append_jsonl(annotate(todo, annotator, schema), log_path)
    return spark.read.schema(schema).json(log_path).count()


def _read_log(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).json(path) if there else None


def stream_log(source: DataFrame, log_path: str, checkpoint: str, key: str):
    """A streaming query that appends new keys of a stream to a log, once each, batch by batch."""

    def each(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        log = _read_log(batch.sparkSession, log_path, batch.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
        append_jsonl(fresh if log is None else remaining(fresh, log, key), log_path)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_points(stream: DataFrame, form: int = 5):
    """The streaming twin of form points: ``(match_id, team_id, form_points)`` from the last ``form`` matches that
    the team played before, in arrival order within a batch by (kickoff, match_id)."""

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["kickoff", "match_id"])
        out = []
        for m, p in zip(rows["match_id"].tolist(), rows["points"].tolist()):
            out.append((m, key[0], int(sum(last))))
            last = [*last, int(p)][-form:]
        state.update((last,))
        yield pd.DataFrame(out, columns=["match_id", "team_id", "form_points"])

    return stream.groupBy("team_id").applyInPandasWithState(update, "match_id long, team_id long, form_points long", "last array<long>", "append", "NoTimeout")
