"""Registered queries of provenance and bias: canonical digests, results of one configuration, schema walks, seeded samples,
how ratings lean."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bias as B
from ..operators import news as N
from ..operators import provenance as P
from .fixtures import view
from .registry import query


@query("SELECT event_id, sha256('{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\",\"z\":[{\"k\":' || json_extract_string(props, '$.k') || ',\"user\":' || user_id || '}]}') AS digest FROM events")
def fn_08_canonical_digests(spark, d):
    """Digests of nested objects whose keys come in any order and with white space."""
    inner = F.concat(F.lit('[ {"user" : '), F.col("user_id").cast("string"), F.lit(","), F.expr("substring(props, 2)"), F.lit("]"))
    body = F.concat(F.lit('{"z":'), inner, F.lit(',\n "kind":"'), "event_type", F.lit('", "id":'), F.col("event_id").cast("string"), F.lit("}"))
    return view(spark, d, "events").select("event_id", P.digest(body).alias("digest"))


CONTEXT = ("match_id", "matchday", "league", "side", "team_id", "content_id", "source_host")
RESULTS = """res AS (SELECT task_id + CASE WHEN task_id % 83 = 5 THEN 100000000 ELSE 0 END AS task_id, 'a' || CASE WHEN task_id % 71 = 3 THEN task_id - 1 ELSE task_id END AS annotation_id, CASE WHEN task_id % 5 = 0 THEN 'old' ELSE 'new' END AS annotation_config_sha256,
 CASE WHEN task_id % 97 = 8 THEN 'other' ELSE 'm' END AS model, 'd' AS model_digest, match_id, matchday, league, CASE WHEN task_id % 67 = 4 THEN 'none' ELSE side END AS side, team_id, CASE WHEN task_id % 61 = 7 THEN -1 ELSE content_id END AS content_id, source_host FROM fx_task),
s AS (SELECT * FROM res WHERE annotation_config_sha256 = 'new')"""


@query(f"""WITH {RESULTS} SELECT 'annotation id' AS "check", annotation_id AS key, CAST(count(*) AS VARCHAR) AS detail FROM s GROUP BY annotation_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'unknown task', CAST(task_id AS VARCHAR), 'only left' FROM s WHERE task_id NOT IN (SELECT task_id FROM fx_task)
UNION ALL SELECT 'context', CAST(s.task_id AS VARCHAR), CASE WHEN s.side <> t.side THEN 'side' ELSE 'content_id' END FROM s JOIN fx_task t ON t.task_id = s.task_id WHERE s.side <> t.side OR s.content_id <> t.content_id
UNION ALL SELECT 'provenance', 'model', CAST(count(DISTINCT model) AS VARCHAR) FROM s HAVING count(DISTINCT model) > 1""")
def flt_05_join_11_result_violations(spark, d):
    t = view(spark, d, "fx_task")
    n = F.col("task_id")
    planted = {
        "annotation_id": F.concat(F.lit("a"), F.when(n % 71 == 3, n - 1).otherwise(n)), "annotation_config_sha256": F.when(n % 5 == 0, "old").otherwise("new"), "model": F.when(n % 97 == 8, "other").otherwise("m"),
        "model_digest": F.lit("d"), "side": F.when(n % 67 == 4, "none").otherwise(F.col("side")), "content_id": F.when(n % 61 == 7, -1).otherwise(F.col("content_id")), "task_id": n + F.when(n % 83 == 5, 100000000).otherwise(0),
    }
    return P.result_violations(P.selected(t.withColumns(planted), "new"), t, CONTEXT)


@query("SELECT 'report' AS \"check\", CAST(league AS VARCHAR) AS key, unnest(list_filter([CASE WHEN league % 3 = 1 THEN 'config' END, CASE WHEN league % 4 = 2 THEN 'model' END], lambda x: x IS NOT NULL)) AS detail FROM (SELECT DISTINCT league FROM fx_match)")
def chk_22_report_provenance(spark, d):
    n = F.col("league")
    reports = view(spark, d, "fx_match").groupBy("league").agg(F.count(F.lit(1)).alias("matches")).withColumns({"config": F.when(n % 3 == 1, "old").otherwise("new"), "model": F.when(n % 4 == 2, None).otherwise("m")})
    return P.report_violations(reports, {"config": "new", "model": "m"}, ["league"])


KINDS = ("error", "view")  # of these events the answer fails


@query("SELECT sha256('[1,\"' || task_id || '\",\"c\",\"d\"]') AS annotation_id, task_id, match_id, side, 'c' AS annotation_config_sha256, 'd' AS model_digest, CASE WHEN source_host = 'click' THEN 'positive' ELSE 'not_mentioned' END AS tone_rating, CASE WHEN source_host = 'click' THEN 1 ELSE 0 END AS evidence FROM fx_task WHERE source_host NOT IN ('error', 'view')")
def prj_20_annotation_rows(spark, d):
    return _annotations(spark, d)[0].select("annotation_id", "task_id", "match_id", "side", "annotation_config_sha256", "model_digest", "tone_rating", F.size("tone_evidence").alias("evidence"))


@query("SELECT sha256('[1,\"' || task_id || '\",\"c\",\"d\"]') AS annotation_id, task_id, 'c' AS annotation_config_sha256, 'refused ' || a AS error, a AS failure_sequence FROM fx_task, (VALUES (1), (2)) v(a) WHERE source_host IN ('error', 'view') AND (a = 1 OR source_host = 'error')")
def prj_20_failure_rows(spark, d):
    return _annotations(spark, d)[1].select("annotation_id", "task_id", "annotation_config_sha256", "error", "failure_sequence")


def _annotations(spark, d):
    t = view(spark, d, "fx_task")
    kind = F.col("source_host")
    good = t.filter(~kind.isin(*KINDS)).select("task_id", F.when(kind == "click", '{"tone":{"rating":"positive","evidence":["x"]}}').otherwise('{"tone":{"rating":"not_mentioned","evidence":[]}}').alias("answer"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempt"))
    tries = t.filter(kind.isin(*KINDS)).select("task_id", F.explode(F.when(kind == "error", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("attempt"))
    bad = tries.select("task_id", F.lit(None).cast("string").alias("answer"), F.concat(F.lit("refused "), "attempt").alias("error"), "attempt")
    return P.annotation_rows(t.withColumn("task_id", F.col("task_id")), good.unionByName(bad), {"annotation_config_sha256": "c", "model_digest": "d"}, ["tone"])


SPEC = {"type": "object", "additionalProperties": False, "required": ["k", "l"], "properties": {"k": {"type": "integer"}, "l": {"type": "array", "maxItems": 2, "items": {"type": "string", "minLength": 1}}}}


@query("""SELECT 'schema' AS "check", CAST(event_id AS VARCHAR) AS key, unnest(CASE event_type WHEN 'signup' THEN ['$.l: missing'] WHEN 'click' THEN ['$.l: more than 2 items', '$.l[1]: too short', '$.l[2]: not a string'] WHEN 'view' THEN ['$.k: not of type integer', '$.x: unknown'] WHEN 'error' THEN ['$: not an object'] ELSE [] END) AS detail FROM events""")
def chk_23_schema_violations(spark, d):
    t, k = F.col("event_type"), F.get_json_object("props", "$.k")
    whole = lambda more: F.concat(F.lit('{"k":'), k, F.lit(more))
    body = F.when(t == "signup", F.col("props")).when(t == "click", whole(',"l":["a","",1]}')).when(t == "view", F.concat(F.lit('{"k":"'), k, F.lit('","l":[],"x":0}'))).when(t == "error", "[]").otherwise(whole(',"l":["a"]}'))
    return P.schema_violations(view(spark, d, "events").withColumn("body", body), ["event_id"], "body", SPEC)


@query()
def ord_10_seeded_sample(spark, d):
    """The hundred events that Python's seeded generator draws from all ids sorted as texts."""
    e = view(spark, d, "events").select(F.col("event_id").cast("string").alias("task_id"), "user_id")
    return P.seeded_sample(e, "task_id", 20260101, 100)


@query("SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars NULLS FIRST, doc_id) - 1 AS position FROM documents")
def ord_06_stable_order(spark, d):
    """Every document's exact place by its metric, ties by id, without one task that holds all."""
    docs = view(spark, d, "documents").select("doc_id", "n_chars", F.struct("n_chars", "doc_id").alias("place"))
    return P.positions(docs, "place").drop("place")


LONG = "l AS (" + " UNION ALL ".join(f"SELECT task_id, team_id, '{i}' AS indicator, {i} AS rating FROM fx_note" for i in N.INDICATORS) + "), h AS (" + " UNION ALL ".join(f"SELECT a.task_id, '{i}' AS indicator, a.{i} AS a, b.{i} AS b FROM fx_note a JOIN fx_note2 b ON b.task_id = a.task_id WHERE a.{i} IS NOT NULL AND b.{i} IS NOT NULL" for i in N.INDICATORS) + ")"


@query(f"""WITH {LONG} SELECT 'indicator' AS section, indicator, 'mean' AS name, count(rating) AS n, round(avg(rating), 9) AS value FROM l GROUP BY indicator
UNION ALL SELECT 'rating', i.indicator, CAST(v AS VARCHAR), count(l.rating) FILTER (l.rating = v), round(100.0 * count(l.rating) FILTER (l.rating = v) / count(l.rating), 9) FROM (SELECT DISTINCT indicator FROM l) i JOIN l ON l.indicator = i.indicator CROSS JOIN range(-2, 3) s(v) GROUP BY i.indicator, v
UNION ALL SELECT 'team', indicator, CAST(team_id AS VARCHAR), count(rating), round(avg(rating), 9) FROM l GROUP BY indicator, team_id
UNION ALL SELECT 'human', indicator, 'equal', count(*), round(avg((a = b)::DOUBLE), 9) FROM h GROUP BY indicator
UNION ALL SELECT 'human', indicator, 'difference', count(*), round(avg(a - b), 9) FROM h GROUP BY indicator""")
def stat_05_bias_report(spark, d):
    out = B.bias_report(view(spark, d, "fx_note"), view(spark, d, "fx_note2"), "task_id", "team_id", N.INDICATORS)
    return out.withColumn("value", F.round("value", 9))


@query("SELECT 'continuation' AS \"check\", CAST(event_id AS VARCHAR) AS key, 'rule broken' AS detail FROM events WHERE event_type = 'error' AND user_id % 3 = 0")
def flt_12_continuation_rows(spark, d):
    """Events without a key (errors) that carry a rating nevertheless."""
    e = view(spark, d, "events")
    key, rating = F.when(F.col("event_type") != "error", F.col("user_id")), F.when((F.col("event_type") != "error") | (F.col("user_id") % 3 == 0), 1)
    return B.continuation_violations(e.select("event_id", key.alias("task_id"), rating.alias("rating")), "task_id", "event_id", ["rating"])
