"""Stateful streams: batch equals stream for rows out of order, over restarts, and the work of a batch is its own."""

import datetime
import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.streaming import stateful

SCHEMA = "season int, team long, at timestamp, id long, value long"
START = datetime.datetime(2025, 8, 1)


def rows_of(n=160, seed=3):
    r = random.Random(seed)
    return [(2025 + i // 100, r.randrange(4), START + datetime.timedelta(minutes=10 * i, microseconds=r.randrange(9)), i, r.randrange(4)) for i in range(n)]


def by_force(rows, form=5):
    out, past = [], {}
    for season, team, _, i, value in sorted(rows, key=lambda r: (r[2], r[3])):
        seen = past.setdefault((season, team), [])
        out.append((season, team, i, len(seen), sum(seen), sum(seen[-form:])))
        seen.append(value)
    return Counter(out)


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    """Rows come an hour out of order, in parts that two runs of the stream read; ties go by id."""
    rows = rows_of() + [(2025, 1, START + datetime.timedelta(minutes=55), 1000 + i, 1) for i in range(3)]
    source, out = str(tmp_path / "in"), str(tmp_path)
    order = sorted(rows, key=lambda r: r[2] + datetime.timedelta(minutes=random.Random(r[3]).randrange(60)))
    third = len(order) // 3
    for part in (order[:third], order[third : 2 * third]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: stateful.rolling_features(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), "61 minutes")
    early = stateful.drained(stream(), out).count()
    spark.createDataFrame(order[2 * third :], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stateful.closing({"season": 0, "team": -1}, START + datetime.timedelta(days=30), spark, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    got = stateful.drained(stream(), out)
    assert 0 < early < len(rows)
    assert Counter(map(tuple, got.collect())) == by_force(rows)


def test_processor_holds_little(monkeypatch):
    """State by state: what waits goes when the watermark passes it, and totals do not grow with history."""

    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return iter(self.v) if isinstance(self.v, list) else self.v

        def update(self, v):
            self.v = v

        put = update

        def clear(self):
            self.v = None

    class Handle:
        timers = ()

        def getValueState(self, *_):
            return Value()

        getListState = getValueState

        def registerTimer(self, at):
            self.timers = (*self.timers, at)

    import pandas as pd

    handle, rolling = Handle(), stateful.Rolling(3)
    rolling.init(handle)
    watermark = type("W", (), {"at": 0, "getCurrentWatermarkInMs": lambda self: self.at})()
    told = []
    for batch in range(50):
        at = pd.to_datetime([batch * 10 + 9, batch * 10 + 1], unit="ms")
        assert list(rolling.handleInputRows((2025, 1), iter([pd.DataFrame({"at": at, "id": [2 * batch + 1, 2 * batch], "value": [1, 2]})]), watermark)) == []
        watermark.at = batch * 10 + 5
        told += [r for b in rolling.handleExpiredTimer((2025, 1), watermark, None) for r in b.itertuples(index=False)]
        assert len(rolling._pending()) <= 2 and len(rolling.last.v) <= 3
    assert [r.id for r in told] == list(range(99)) and [r.played for r in told] == list(range(99))
    assert handle.timers[0] == 1 and max(handle.timers) <= 50 * 10


def test_task_log_stops_at_success(spark, tmp_path):
    rows = [(t, START + datetime.timedelta(minutes=i), 10 * t + i, int(i == t)) for t in range(4) for i in range(4)]
    schema = "task long, at timestamp, id long, value long"
    source = str(tmp_path / "in")
    df = spark.createDataFrame(rows, schema).withColumn("value", F.when(F.col("task") == 3, 0).otherwise(F.col("value")).cast("long"))
    df.repartition(2).write.parquet(source)
    stateful.closing({"task": -1}, START + datetime.timedelta(days=9), spark, schema).coalesce(1).write.mode("append").parquet(source)
    got = stateful.drained(stateful.task_log(spark.readStream.schema(schema).parquet(source), "1 hour"), str(tmp_path)).collect()
    want = {(t, 10 * t + i, "annotation" if i == t and t < 3 else "failure", 0 if i == t and t < 3 else i + 1) for t in range(4) for i in range(4) if i <= t}
    assert {tuple(r) for r in got} == want
