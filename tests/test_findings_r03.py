"""Faults found at size: joins without a key, too many candidates, open ties."""

import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY
from tidemark.functions import scalars as S
from tidemark.operators import articles as A
from tidemark.operators import evaluation as E
from tidemark.operators import news as N
from tidemark.operators import provenance as P
from tidemark.plans import registry, registry_more  # noqa: F401
from tidemark.streaming import stateful


@pytest.mark.parametrize("name", ["join_08_09_ownership"])
def test_events_meet_contexts_by_their_key(spark, name):
    plan = registry.QUERIES[name](spark, TINY)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join (Inner|Cross), isnotnull\(", plan)


def test_results_are_checked_in_many_tasks(spark):
    tasks = spark.range(20000).select(F.col("id").alias("task_id"), F.lit("home").alias("side"))
    results = tasks.withColumns({"annotation_id": F.concat(F.lit("a"), "task_id"), "model": F.lit("m"), "model_digest": F.lit("d"), "side": F.when(F.col("task_id") == 7, "away").otherwise(F.col("side"))})
    found = P.result_violations(results, tasks, ["side"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not re.search(r"hashpartitioning\((task_id|annotation_id)\S*, \d+\), ENSURE_REQUIREMENTS", plan)
    assert [tuple(r) for r in found.collect()] == [("context", "7", "side")]


def test_the_chain_reads_a_field_once(spark):
    asked = "request_id string, match_id long, season int, league string, side string, team_id long, team string, request_type string, query_strategy string, date_start string, date_end string, lang string"
    empty = lambda schema: spark.createDataFrame([], schema)
    judged = A.judge(A.occurrences(empty("request_id string, raw_response_path string, body string")), empty(asked), A.policy_decisions(empty("body string")), "Europe/Berlin")
    for df in (judged.select("request_id", "article_id", "source_host", "decision", "reason"), A.links(judged), A.articles(judged)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("variant_get") < 80  # before: over a thousand, which did not compile


def test_every_white_space_is_stripped(spark):
    rows = spark.createDataFrame([(i, chr(i)) for i in range(0x3100)], "i int, c string")
    got = {r.i for r in rows.filter(S.optional_text(F.concat("c", F.lit("x"), "c")) == "x").collect()}
    assert got == {i for i in range(0x3100) if chr(i).isspace()}


def test_long_texts_come_in_small_batches(spark):
    S.normalized_body(F.col("text"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    size = F.pandas_udf(lambda x: x.map(lambda _: len(x)), "int")
    text = F.concat(F.lit("\u00e9"), F.repeat(F.lit("x"), 100000))
    assert spark.range(0, 400, 1, 1).select(size(text).alias("n")).agg(F.max("n")).first()[0] < 100


def test_sample_of_many_distinct_candidates(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, i % 3, rng.randrange(900), rng.randrange(1200), rng.randrange(2), rng.choice(["home", "away"]), rng.choice("ab")) for i in range(9000)]
    tasks = spark.createDataFrame(rows, "task_id long, matchday int, team_id int, content_id int, bin int, side string, source_host string").repartition(4)
    picks = lambda: sorted((r.position, r.task_id) for r in N.stratified_sample(tasks, 8).collect())
    monkeypatch.setattr(N, "MOST_CANDIDATES", 2000)
    got = picks()
    monkeypatch.setattr(N, "MOST_CANDIDATES", 10**6)
    monkeypatch.setattr(N, "_contenders", lambda rows, *_: rows)
    assert got == picks()


def test_equal_candidates_rank_by_id(spark):
    rows = spark.range(40).select((39 - F.col("id")).alias("model_id"), F.lit(16).alias("feature_count"), F.lit(0.1).alias("c"), F.lit(1.0).alias("loss"), F.lit(0.5).alias("se"))
    got = E.one_standard_error(rows.repartition(8)).collect()
    assert all(r.strict_rank == r.selection_rank == r.model_id + 1 for r in got)


def test_neighbouring_keys_share_state(spark, tmp_path):
    """96 keys, some below zero or far apart, ids null or beyond a double: every row, in 5 groups and not 96."""
    rng, start = random.Random(8), datetime(2025, 1, 1)
    teams = [*range(-40, 52), -(2**63), 2**63 - 1, 10**12, 10**12 + 1]
    rows = [(2025, rng.choice(teams), start + timedelta(minutes=i // 3), (1 << 60) + i if i % 3 else None, rng.randrange(4)) for i in range(900)] + [(2025, t, start, -i, 1) for i, t in enumerate(teams)]
    schema, source = "season int, team long, at timestamp, id long, value long", str(tmp_path / "in")
    rng.shuffle(rows)
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stateful.closing({"season": 2025, "team": 0}, start + timedelta(days=30), spark, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stateful.rolling_features(stream, "1 day").writeStream.format("memory").queryName("shared_state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    want, past = Counter(), {}
    for season, team, _, i, value in sorted(rows, key=lambda r: (r[2], r[3] is None, r[3] or 0)):
        seen = past.setdefault(team, [])
        want[(season, team, i, len(seen), sum(seen), sum(seen[-5:]))] += 1
        seen.append(value)
    assert Counter(map(tuple, spark.table("shared_state").collect())) == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 96  # each of a group's states counts


def test_task_logs_share_state(spark, tmp_path):
    rng, start = random.Random(9), datetime(2025, 1, 1)
    rows = [(rng.randrange(-20, 60), start + timedelta(minutes=i), i, rng.choice([0, 0, 0, 0, 0, 1, None])) for i in range(1200)]
    schema, source = "task long, at timestamp, id long, value long", str(tmp_path / "in")
    for part in (rows[:300], rows[300:900], rows[900:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stateful.closing({"task": 0}, start + timedelta(days=30), spark, schema).coalesce(1).write.mode("append").parquet(source)
    got = stateful.drained(stateful.task_log(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "1 minute"), str(tmp_path))
    want, failed, done = [], Counter(), set()
    for task, _, i, good in rows:
        if task not in done:
            failed[task] += not good
            want.append((task, i, "annotation" if good else "failure", 0 if good else failed[task]))
            if good:
                done.add(task)
    assert Counter(map(tuple, got.collect())) == Counter(want)
