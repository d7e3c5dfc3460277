"""Registered queries from raw responses to articles and links, over JSON made of documents and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import articles as A
from ..operators import checks as C
from ..operators import matches as M
from ..sources.scratch import scratch
from .fixtures import view
from .registry import query

ZONE = "Europe/Berlin"


def _json(c: Column) -> Column:
    """A value as JSON text, null as ``null``."""
    whole = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _object(**fields: Column) -> Column:
    return F.concat(F.lit("{"), *[x for i, (k, v) in enumerate(fields.items()) for x in (F.lit(f'{"," if i else ""}"{k}":'), v)], F.lit("}"))


def responses(spark, d):
    """``(request_id, raw_response_path, body)``: responses of up to 25 articles each, in the order of their ids."""
    r = view(spark, d, "fx_raw")
    author = _object(uri=_json(F.concat(F.lit("a"), F.col("doc_id") % 7)), name=_json(F.col("source")), type=F.lit('"author"'), isAgency=_json(F.col("doc_id") % 2 == 0))
    listed = F.when(F.col("authors_kind") == "text", F.lit('"x"')).when(F.col("authors_kind") == "number", F.lit("[1]")).otherwise(F.concat(F.lit("["), author, F.lit("]")))
    source = F.when(F.col("has_source"), _object(uri=_json(F.col("host")), title=_json(F.col("source")))).otherwise(F.lit('"x"'))
    one = _object(uri=_json(F.when(F.col("has_uri"), F.col("uri"))), lang=_json(F.col("lang")), date=_json(F.col("date_text")), dateTimePub=_json(F.col("pub_text")), url=_json(F.col("url_text")),
                  title=F.coalesce(_json(F.col("title")), F.lit("null")), body=_json(F.col("text")), source=source, authors=listed)
    one = F.when(F.col("title").isNull(), F.replace(one, F.lit('"title":null,'), F.lit('"title":3,'))).otherwise(one)
    bodies = r.select("rq", "idx", one.alias("one")).groupBy("rq").agg(F.sort_array(F.collect_list(F.struct("idx", "one"))).alias("l"))
    body = F.concat(F.lit('{"articles":{"results":['), F.array_join("l.one", ","), F.lit("]}}"))
    return bodies.select("rq", F.concat(F.lit("q"), "rq").alias("request_id"), F.concat(F.lit("raw/q"), "rq", F.lit(".json")).alias("raw_response_path"), body.alias("body"))


def policy(spark, d):
    rules = view(spark, d, "fx_rule").select(F.struct("host", F.lit("exact_host").alias("match"), "decision").alias("r"))
    return rules.agg(F.sort_array(F.collect_list("r")).alias("rules")).select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("exclude").alias("unknown_hosts"), "rules")).alias("body"))


def judged(spark, d):
    """Responses, requests and policy stored as a run finds them, then the chain."""
    path = scratch(spark, "raw")
    stored = {"responses": responses(spark, d).drop("rq"), "requests": view(spark, d, "fx_ask").drop("rq"), "policy": policy(spark, d)}
    for name, df in stored.items():
        df.write.parquet(f"{path}/{name}")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return A.judge(A.occurrences(read("responses")), read("requests"), A.policy_decisions(read("policy")), ZONE)


STRIP = r"regexp_replace({}, '^[\s\x0B\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x0B\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')"
CANONICAL = r"(lower(regexp_extract(url_text, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url_text, '://([^/?#:]+)', 1)) || CASE WHEN regexp_extract(url_text, '://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url_text, '://[^/?#]+([^?#]*)', 1) END || regexp_extract(url_text, '(\?[^#]*)', 1))"
JUDGED = f"""WITH n AS (SELECT r.* EXCLUDE (request_id), 'q' || rq AS request_id, CASE WHEN url_text IS NOT NULL OR has_source THEN nhost END AS source_host, {CANONICAL} AS canonical, nullif({STRIP.format('text')}, '') AS body, nullif({STRIP.format('source')}, '') AS source_name, nullif({STRIP.format('lang')}, '') AS language,
 day + CASE WHEN doc_id % 31 <> 0 AND doc_id % 37 = 0 THEN 1 ELSE 0 END AS local_day FROM fx_raw r),
j AS (SELECT n.*, coalesce(p.decision, 'unknown') AS decision, CASE WHEN has_uri THEN 'event_registry:' || uri ELSE 'url_sha256:' || sha256(canonical) END AS article_id,
 CASE WHEN coalesce(source_host, '') = '' THEN 'missing_source_host' WHEN p.decision = 'exclude' THEN 'policy_exclude' WHEN p.decision IS NULL THEN 'policy_unknown_host' WHEN language IS NULL THEN 'missing_language' WHEN language <> 'en' THEN 'language_mismatch'
 WHEN doc_id % 29 = 0 THEN 'invalid_event_registry_date' WHEN NOT day BETWEEN DATE '2025-01-11' AND DATE '2025-03-22' THEN 'event_registry_date_outside_request_window' WHEN doc_id % 31 = 0 THEN 'invalid_publication_datetime' WHEN NOT local_day BETWEEN DATE '2025-01-11' AND DATE '2025-03-22' THEN 'publication_datetime_outside_request_window'
 WHEN url_text IS NULL THEN 'invalid_article_url' WHEN n.body IS NULL THEN 'missing_article_body' WHEN title IS NULL THEN 'invalid_article_title' WHEN NOT has_source THEN 'invalid_article_source' WHEN authors_kind <> 'list' THEN 'invalid_article_authors' END AS reason
 FROM n LEFT JOIN fx_rule p ON p.host = source_host)"""


@query("SELECT 'q' || rq AS request_id, idx AS request_article_index, CASE WHEN has_uri THEN uri END AS uri FROM fx_raw")
def src_06_response_occurrences(spark, d):
    o = A.occurrences(responses(spark, d).drop("rq"))
    return o.select("request_id", F.col("request_article_index").cast("bigint").alias("request_article_index"), F.try_variant_get("raw", "$.uri", "string").alias("uri"))


@query(f"{JUDGED} SELECT request_id, idx AS request_article_index, article_id, source_host, decision, reason FROM j")
def flt_02_03_fn_10_whole_rejection_chain(spark, d):
    return judged(spark, d).select("request_id", F.col("request_article_index").cast("bigint").alias("request_article_index"), "article_id", "source_host", "decision", "reason")


@query(f"{JUDGED}, k AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY request_id, idx) AS n FROM j WHERE reason IS NULL) SELECT article_id, CASE WHEN has_uri THEN uri END AS event_registry_uri, canonical AS url, source_host, host AS source_uri, source_name AS source_title, language, day AS event_registry_date, CAST(epoch(CAST(replace(pub_text, 'Z', '') AS TIMESTAMP)) AS BIGINT) AS published, title, body, 1 AS n_authors, 'a' || (doc_id % 7) AS author_uri, source_name AS author, doc_id % 2 = 0 AS agency FROM k WHERE n = 1")
def prj_16_17_articles(spark, d):
    a = A.articles(judged(spark, d))
    first = F.col("authors")[0]
    return a.select("article_id", "event_registry_uri", "url", "source_host", "source_uri", "source_title", "language", "event_registry_date", F.unix_timestamp("publication_datetime").alias("published"), "title", "body",
                    F.size("authors").alias("n_authors"), first["uri"].alias("author_uri"), first["name"].alias("author"), first["is_agency"].alias("agency"))


@query(f"{JUDGED}, k AS (SELECT *, row_number() OVER (PARTITION BY request_id, article_id ORDER BY idx) AS n FROM j WHERE reason IS NULL) SELECT k.request_id, article_id, match_id, season, league, side, team_id, team, request_type, query_strategy, date_start, date_end, idx AS request_article_index, 'raw/' || k.request_id || '.json' AS raw_response_path FROM k JOIN fx_ask a ON a.request_id = k.request_id WHERE n = 1")
def prj_18_links(spark, d):
    return A.links(judged(spark, d)).withColumn("request_article_index", F.col("request_article_index").cast("bigint"))


@query("SELECT 'response' AS \"check\", request_id AS key, 'rule broken' AS detail FROM fx_ask WHERE rq % 11 = 0 OR rq % 13 = 0 OR rq % 17 = 0 OR rq % 19 = 0")
def src_11_response_violations(spark, d):
    n = F.col("rq")
    broken = F.when(n % 11 == 0, "[]").when(n % 13 == 0, '{"articles":{}}').when(n % 17 == 0, '{"articles":{"results":[1]}}').when(n % 19 == 0, "no json")
    return A.response_violations(responses(spark, d).withColumn("body", F.coalesce(broken, "body")), ["request_id"])


ASKED = "a AS (SELECT * REPLACE (CASE WHEN rq % 23 = 0 THEN 'left' ELSE side END AS side, CASE WHEN rq % 29 = 0 THEN '2025-12-31' ELSE date_start END AS date_start) FROM fx_ask UNION ALL SELECT * FROM fx_ask WHERE rq % 31 = 5)"


@query(f"WITH {ASKED} SELECT 'request' AS \"check\", request_id AS key, 'rule broken' AS detail FROM a WHERE side = 'left' OR date_start > date_end UNION ALL SELECT 'request sides', CAST(match_id AS VARCHAR), 'rule broken' FROM a GROUP BY match_id HAVING list_sort(list(side)) <> ['away', 'home'] UNION ALL SELECT 'request id', request_id, CAST(count(*) AS VARCHAR) FROM a GROUP BY request_id HAVING count(*) > 1")
def chk_10_26_request_violations(spark, d):
    asked = view(spark, d, "fx_ask")
    odd = asked.withColumns({"side": F.when(F.col("rq") % 23 == 0, "left").otherwise(F.col("side")), "date_start": F.when(F.col("rq") % 29 == 0, "2025-12-31").otherwise(F.col("date_start"))})
    return A.request_violations(odd.unionByName(asked.filter("rq % 31 = 5")))


RULES = "r AS (SELECT CASE WHEN length(host) % 5 = 0 THEN 'WWW.' || host ELSE host END AS host, CASE WHEN length(host) % 11 = 0 THEN 'suffix' ELSE 'exact_host' END AS \"match\", CASE WHEN length(host) % 4 = 0 THEN 'maybe' ELSE decision END AS decision FROM fx_rule UNION ALL SELECT host, 'exact_host', decision FROM fx_rule WHERE length(host) % 6 = 1)"


@query(f"WITH {RULES} SELECT 'policy' AS \"check\", '' AS key, 'rule broken' AS detail UNION ALL SELECT 'policy rule', host, 'rule broken' FROM r WHERE \"match\" <> 'exact_host' OR decision = 'maybe' OR host LIKE 'WWW.%' UNION ALL SELECT 'policy host', host, CAST(count(*) AS VARCHAR) FROM r GROUP BY host HAVING count(*) > 1")
def src_17_policy_violations(spark, d):
    rules, n = view(spark, d, "fx_rule"), F.length("host")
    odd = rules.select(F.when(n % 5 == 0, F.concat(F.lit("WWW."), "host")).otherwise(F.col("host")).alias("host"), F.when(n % 11 == 0, "suffix").otherwise("exact_host").alias("match"), F.when(n % 4 == 0, "maybe").otherwise(F.col("decision")).alias("decision"))
    both = odd.unionByName(rules.filter(n % 6 == 1).select("host", F.lit("exact_host").alias("match"), "decision"))
    document = both.agg(F.collect_list(F.struct("host", "match", "decision")).alias("rules")).select(F.to_json(F.struct(F.lit(2).alias("schema_version"), F.lit("exclude").alias("unknown_hosts"), "rules")).alias("body"))
    return A.policy_violations(document)


@query("SELECT request_id, match_id, side FROM fx_ask WHERE request_id = 'q1'")
def flt_04_chosen_request(spark, d):
    return A.chosen(view(spark, d, "fx_ask"), "request_id", "q1").select("request_id", "match_id", "side")


@query()
def fn_03_normalized_titles(spark, d):
    """First lines of all documents as titles are normalized; Unicode rules have no SQL."""
    return view(spark, d, "documents").select("doc_id", A.normalized_title(F.substring_index("text", "\n", 1)).alias("title"))


@query("SELECT event_id, event_type IN ('signup', 'click') AS done FROM events")
def fn_28_completions(spark, d):
    t = F.col("event_type")
    reply = F.when(t == "signup", '{"done":true}').when(t == "click", '{"done":true,"done_reason":"stop"}').when(t == "view", '{"done":true,"done_reason":"length"}').when(t == "purchase", '{"done":false}').otherwise("[]")
    return view(spark, d, "events").select("event_id", A.completion_ok(reply).alias("done"))


INDICATORS = ("i1", "i2", "i3", "i4")


@query("SELECT 'range' AS \"check\", CAST(task_id AS VARCHAR) AS key, concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL OR {c} NOT BETWEEN -1 AND 2 THEN '{c}' END" for c in INDICATORS) + ") AS detail FROM fx_note WHERE " + " OR ".join(f"{c} IS NULL OR {c} NOT BETWEEN -1 AND 2" for c in INDICATORS))
def chk_14_range_violations(spark, d):
    return A.range_violations(view(spark, d, "fx_note"), ["task_id"], {c: (-1, 2) for c in INDICATORS})


TARGET = "CASE WHEN match_id % 37 = 0 THEN NULL WHEN league = 0 THEN 'X' WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' ELSE 'A' END"


@query(f"WITH t AS (SELECT {TARGET} AS target FROM fx_match) SELECT 'classes' AS \"check\", target AS key, 'only left' AS detail FROM (SELECT DISTINCT target FROM t WHERE target NOT IN ('H', 'D', 'A')) UNION ALL SELECT 'classes', c, 'only right' FROM (VALUES ('H'), ('D'), ('A')) v(c) WHERE c NOT IN (SELECT target FROM t WHERE target IS NOT NULL) UNION ALL SELECT 'classes', '', 'rule broken' FROM t WHERE target IS NULL")
def chk_17_class_violations(spark, d):
    return A.class_violations(view(spark, d, "fx_match").selectExpr(f"{TARGET} AS target"))


MOVED = "m AS (SELECT *, CAST(kickoff + CASE WHEN match_id % 50 = 3 THEN INTERVAL 7 DAY ELSE INTERVAL 0 DAY END AS DATE) AS match_date FROM fx_match), o AS (SELECT season, home_team_id AS team_id, match_date FROM m UNION ALL SELECT season, away_team_id, match_date FROM m)"


@query(f"WITH {MOVED} SELECT 'team dates' AS \"check\", season || '|' || team_id || '|' || match_date AS key, CAST(count(*) AS VARCHAR) AS detail FROM o GROUP BY season, team_id, match_date HAVING count(*) > 1")
def chk_25_team_dates(spark, d):
    moved = view(spark, d, "fx_match").withColumn("kickoff", F.expr("kickoff + CASE WHEN match_id % 50 = 3 THEN INTERVAL '7' DAY ELSE INTERVAL '0' DAY END"))
    return A.order_violations(M.observations(moved).withColumn("match_date", F.to_date("kickoff")))


@query("SELECT match_id, strftime(kickoff, '%Y-%m-%d') AS date, h.team AS home_team, a.team AS away_team FROM fx_match m JOIN fx_team h ON h.team_id = home_team_id JOIN fx_team a ON a.team_id = away_team_id")
def fn_34_match_keys(spark, d):
    m, t = view(spark, d, "fx_match"), view(spark, d, "fx_team")
    named = m.join(t.select(F.col("team_id").alias("home_team_id"), F.col("team").alias("home")), "home_team_id").join(t.select(F.col("team_id").alias("away_team_id"), F.col("team").alias("away")), "away_team_id")
    return named.select("match_id", A.match_key(F.col("kickoff"), F.col("home"), F.col("away")).alias("k")).select("match_id", "k.*")
