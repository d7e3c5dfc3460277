"""Registered queries of the data sources, the bounded window and the stateful streams."""

from __future__ import annotations

import json
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import connectors as K
from ..sources import store
from ..sources.scratch import scratch
from ..sources.services import Reply
from ..streaming import stateful
from .fixtures import view
from .registry import query

JITTER, DELAY, SLICES = 2 * 86400, "3 days", 4  # seconds by which rows are out of order, and what the watermark allows


def _results(payload: str) -> Reply:
    """The service of the query: as many results as the payload's length leaves over four."""
    return Reply(200, json.dumps({"articles": {"results": [{"n": i} for i in range(len(payload) % 4)]}}))


@query("SELECT 'page ' || page_id AS request_id, 200 AS status, CAST(length(coalesce(url, '')) % 4 AS BIGINT) AS article_count FROM pages")
def src_10_snk_04_05_posted_requests(spark, d):
    requests = view(spark, d, "pages").select(F.concat(F.lit("page "), "page_id").alias("request_id"), F.coalesce("url", F.lit("")).alias("payload"))
    path = scratch(spark, "responses")
    with store.Lease.acquire(spark, path, "query") as lease:
        K.post_all(requests, path, K.response_sink(_results), lease)
    return K.committed_log(spark, path).drop("raw_path")


@query("SELECT 'l' || league AS league, CAST(season AS INTEGER) AS season, match_id, matchday, home_goals, away_goals FROM fx_match")
def src_08_match_service(spark, d):
    """Seasons stored as a service's texts, one a league and season, and read back through the match service."""
    m = view(spark, d, "fx_match").select(F.concat(F.lit("l"), "league").alias("league"), F.col("season").cast("int").alias("season"), F.struct("match_id", "matchday", "home_goals", "away_goals").alias("m"))
    served = m.groupBy("league", "season").agg(F.to_json(F.sort_array(F.collect_list("m"))).alias("payload"))
    path = scratch(spark, "service")
    name = lambda league, season: f"{league}-{season}"
    K.post_all(served.select(F.concat_ws("-", "league", "season").alias("request_id"), "payload"), path, K.response_sink(lambda body: Reply(200, body), lambda body: len(json.loads(body))))
    seasons = sorted(map(tuple, m.select("league", "season").distinct().collect()))
    get = lambda league, season: store.read_bytes(f"{path}/raw/{store.file_name(name(league, season))}.json").decode()
    return K.read_matches(spark, K.match_service(get, seasons, "match_id long, matchday long, home_goals long, away_goals long"))


def _rated(text: str) -> str:
    if len(text) % 5 == 0:
        raise ValueError("five")
    return str(len(text))


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) % 5 <> 0 THEN CAST(length(text) AS VARCHAR) END AS answer, CASE WHEN length(coalesce(text, '')) % 5 = 0 THEN 'ValueError: five' END AS error FROM documents")
def str_03_calls_in_flight(spark, d):
    return K.call_in_flight(view(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text", _rated)


def shuffled_stream(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """``rows`` as a stream of SLICES micro-batches in which they come up to JITTER seconds out of order, and a row that
    closes it."""
    ends = rows.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    if ends.low is not None:
        late = F.unix_timestamp("at") + F.pmod(F.xxhash64("id"), F.lit(JITTER))
        low, high = (int(t.timestamp()) for t in ends)
        cut = F.floor((late - low) * SLICES / (high + JITTER - low + 1))
        for k in range(SLICES):
            rows.filter(cut == k).write.mode("append").parquet(f"{path}/in")
        keys = {c: 0 for c in rows.columns if c not in ("at", "id", "value")}
        stateful.closing(keys, ends.high + timedelta(days=365), spark, rows.schema).select(*rows.columns).coalesce(1).write.mode("append").parquet(f"{path}/in")
    else:
        rows.write.mode("append").parquet(f"{path}/in")
    files = len({f for f in spark.read.parquet(f"{path}/in").inputFiles()})
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // (SLICES + 1)))).parquet(f"{path}/in")


POINTS = "CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 1 ELSE 0 END"
ROLLING_SQL = f"""SELECT CAST(year(ts) AS INTEGER) AS season, user_id AS team, event_id AS id, count(*) OVER p AS played, CAST(coalesce(sum({POINTS}) OVER p, 0) AS BIGINT) AS points, CAST(coalesce(sum({POINTS}) OVER l, 0) AS BIGINT) AS form_points
FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW p AS (PARTITION BY year(ts), user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l AS (PARTITION BY year(ts), user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""


@query(ROLLING_SQL)
def str_06_rolling_state(spark, d):
    """Points of users by a stream with state, equal to windows over the whole table."""
    rows = view(spark, d, "events").filter("user_id IS NOT NULL AND ts IS NOT NULL").selectExpr("year(ts) AS season", "user_id AS team", "CAST(ts AS timestamp) AS at", "event_id AS id", f"CAST({POINTS} AS BIGINT) AS value")
    path = scratch(spark, "rolling")
    return stateful.drained(stateful.rolling_features(shuffled_stream(spark, rows, path), DELAY), path)


LOG_SQL = """WITH o AS (SELECT user_id AS task, event_id AS id, event_type = 'signup' AS ok, row_number() OVER w AS n, coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT task, id, CASE WHEN ok THEN 'annotation' ELSE 'failure' END AS kind, CASE WHEN ok THEN 0 ELSE n END AS sequence FROM o WHERE before = 0"""


@query(LOG_SQL)
def str_01_02_task_log_state(spark, d):
    """Outcomes of tasks (a sign-up is a success): numbered failures up to the first success, then nothing."""
    rows = view(spark, d, "events").filter("user_id IS NOT NULL AND ts IS NOT NULL").selectExpr("user_id AS task", "CAST(ts AS timestamp) AS at", "event_id AS id", "CAST(event_type = 'signup' AS BIGINT) AS value")
    path = scratch(spark, "task-log")
    return stateful.drained(stateful.task_log(shuffled_stream(spark, rows, path), DELAY), path)
