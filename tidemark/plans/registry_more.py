"""More registered queries: scalar functions, planned requests, star joins, sets, orders, checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import checks as C
from ..operators import matches as M
from ..operators import news as N
from ..operators import raw as R
from ..sources import files
from .fixtures import view
from .registry import OBS_SQL, query

# scalar functions -----------------------------------------------------------------------------------------


@query("SELECT doc_id, 'content_sha256:' || sha256(text) AS content_id, CASE WHEN doc_id % 3 = 0 THEN 'event_registry:' || doc_id ELSE 'url_sha256:' || sha256(url) END AS article_id FROM fx_art")
def fn_04_05_content_and_article_ids(spark, d):
    uri = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string"))
    return view(spark, d, "fx_art").select("doc_id", S.prefixed_sha("content_sha256", F.col("text")).alias("content_id"), S.article_id(uri, F.col("url")).alias("article_id"))


@query("SELECT doc_id, sha256('[1,' || substr(to_json([host, source, url])::VARCHAR, 2)) AS task_id FROM fx_art")
def fn_06_07_json_array_ids(spark, d):
    return view(spark, d, "fx_art").select("doc_id", S.json_array_id(1, F.col("host"), F.col("source"), F.col("url")).alias("task_id"))


@query("SELECT page_id, 'https://' || regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\\.', '') AS homepage, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host FROM pages")
def fn_09_10_11_homepage_and_host(spark, d):
    p = view(spark, d, "pages")
    return p.select("page_id", F.coalesce(S.homepage(F.col("url")), F.lit(None)).alias("homepage"), S.host_of(F.col("url")).alias("host"))


@query("SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#:]+)', 1)) || CASE WHEN regexp_extract(url, '://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]+([^?#]*)', 1) END || regexp_extract(url, '(\\?[^#]*)', 1) AS canonical FROM pages")
def fn_12_canonical_url(spark, d):
    return view(spark, d, "pages").select("page_id", S.canonical_url(F.col("url")).alias("canonical"))


@query("WITH u AS (SELECT page_id, list_transform(regexp_extract_all(html, 'https?://[^ \\t\\n\\r\\f\\x0b<>]+'), lambda x: rtrim(x, '.,);\"''')) AS us FROM pages) SELECT page_id, list_filter(us, lambda x, i: list_position(us, x) = i) AS urls FROM u")
def fn_14_set_07_evidence_urls(spark, d):
    return view(spark, d, "pages").select("page_id", S.evidence_urls(F.col("html")).alias("urls"))


@query("SELECT o_orderkey, o_orderdate::DATE AS iso, o_orderdate::DATE AS day_first, CASE WHEN o_orderkey % 4 <> 0 OR (month(o_orderdate) >= 10 AND day(o_orderdate) >= 10) THEN o_orderdate::DATE END AS loose, o_orderdate::DATE AS serial FROM orders")
def fn_15_19_20_dates(spark, d):
    o = view(spark, d, "orders")
    serial = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")).cast("string")
    return o.select("o_orderkey", S.iso_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("iso"), S.day_first_date(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("day_first"), S.iso_date(F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-M-d")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("loose"), S.review_date(serial).alias("serial"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(date_trunc('second', ts) - CASE WHEN event_type = 'view' THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS DATE) END AS utc_date, CASE WHEN event_type <> 'error' THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) - CASE WHEN event_type = 'view' THEN 7200 ELSE 0 END END AS second FROM events")
def fn_16_17_timestamps(spark, d):
    e = view(spark, d, "events")
    zone = F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "view", "+02:00").otherwise("Z")  # none: refused
    z = S.iso_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone))
    return e.select("event_id", S.local_date(z, "UTC").alias("utc_date"), F.unix_timestamp(z).alias("second"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS n, CASE WHEN l_quantity > 0 THEN CAST(l_quantity AS BIGINT) END AS positive, coalesce(round(l_linenumber / nullif(l_quantity - 1, 0), 6), 0.0) AS ratio FROM lineitem")
def fn_21_22_numbers(spark, d):
    x = view(spark, d, "lineitem")
    text = F.concat(F.lit(" "), F.col("l_quantity").cast("string"))
    return x.select("l_orderkey", "l_linenumber", S.whole_number(text).alias("n"), S.whole_number(text, True).alias("positive"), M.safe_ratio(F.col("l_linenumber"), F.col("l_quantity") - 1).alias("ratio"))


@query("SELECT DISTINCT year(o_orderdate) AS season, lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') || lpad(((year(o_orderdate) + 1) % 100)::VARCHAR, 2, '0') AS code FROM orders")
def fn_30_src_09_season_code(spark, d):
    return view(spark, d, "orders").select(F.year("o_orderdate").cast("bigint").alias("season")).distinct().select("season", S.season_code(F.col("season")).alias("code"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 WHEN 'error' THEN -2 END AS rating FROM events")
def fn_23_rating_numbers(spark, d):
    label = F.element_at(F.create_map(*map(F.lit, ("click", "positive", "view", "neutral", "error", "strongly_negative", "purchase", "not_mentioned"))), F.col("event_type"))
    return view(spark, d, "events").select("event_id", S.rating_number(F.when(F.col("event_type").isin("click", "view", "error"), label).otherwise("not_mentioned")).alias("rating"))


@query()
def fn_33_percent_format(spark, d):
    o = view(spark, d, "orders")
    return o.select("o_orderkey", F.format_string("%.1f %%", 100.0 * (F.col("o_orderkey") % 1000) / 1000).alias("shown"))


# planned requests and rules -----------------------------------------------------------------------------------

REQ = """t AS (SELECT team_id, CASE team_id % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'keyword' ELSE 'concept_or_keyword' END AS strategy, 'c/' || team_id AS concept, team AS keyword FROM fx_team),
s AS (SELECT m.match_id, m.season, m.league, CAST(m.kickoff AS DATE) - 5 AS date_start, CAST(m.kickoff AS DATE) - 1 AS date_end, x.side, CASE x.side WHEN 'home' THEN m.home_team_id ELSE m.away_team_id END AS team_id FROM fx_match m CROSS JOIN (VALUES ('home'), ('away')) x(side)),
r AS (SELECT concat_ws('_', league, season, match_id, side, 'team_context') AS request_id, match_id, season, league, side, s.team_id, strategy, date_start, date_end, '{"query":{"$query":{"$and":[{"conceptUri":"league/' || league || '"},' || CASE strategy WHEN 'concept' THEN '{"conceptUri":"' || concept || '"}' WHEN 'keyword' THEN '{"keyword":"' || keyword || '"}' ELSE '{"$or":[{"conceptUri":"' || concept || '"},{"keyword":"' || keyword || '"}]}' END || ',{"dateStart":"' || date_start || '","dateEnd":"' || date_end || '","lang":"deu"}]}}}' AS payload FROM s JOIN t ON t.team_id = s.team_id)"""


def _requests(spark, d):
    m = view(spark, d, "fx_match").withColumns({"date_start": F.date_sub(F.to_date("kickoff"), 5), "date_end": F.date_sub(F.to_date("kickoff"), 1)})
    t = view(spark, d, "fx_team").selectExpr("team_id", "CASE team_id % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'keyword' ELSE 'concept_or_keyword' END AS strategy", "concat('c/', team_id) AS concept", "team AS keyword")
    leagues = m.select("league").distinct().selectExpr("league", "concat('league/', league) AS concept")
    return R.requests(m, t, leagues, "deu")


@query(f"WITH {REQ} SELECT * FROM r")
def prj_12_13_14_15_join_04_requests(spark, d):
    return _requests(spark, d)


@query(f"WITH {REQ}, resp AS (SELECT request_id FROM r WHERE match_id % 13 <> 0 UNION ALL SELECT 'stray') SELECT request_id, 'missing' AS side FROM r ANTI JOIN resp USING (request_id) UNION ALL SELECT request_id, 'unplanned' FROM resp ANTI JOIN r USING (request_id)")
def join_05_set_01_response_coverage(spark, d):
    r = _requests(spark, d).select("request_id", "match_id")
    resp = r.filter("match_id % 13 <> 0").select("request_id").unionByName(spark.sql("SELECT 'stray' AS request_id"))
    return r.select("request_id").join(resp, "request_id", "left_anti").withColumn("side", F.lit("missing")).unionByName(resp.join(r, "request_id", "left_anti").withColumn("side", F.lit("unplanned")))


@query("SELECT host, decision, CASE decision WHEN 'exclude' THEN ['https://' || host || '/terms'] ELSE [] END AS evidence_urls, article_count, DATE '2025-09-01' AS review_date FROM fx_policy")
def prj_27_fn_13_policy_rules(spark, d):
    p = view(spark, d, "fx_policy")
    reviews = p.select(F.concat(F.lit("https://www."), "host").alias("website_url"), F.col("article_count").cast("string").alias("article_count"), F.when(F.col("decision") == "exclude", F.concat(F.lit("see https://"), "host", F.lit("/terms)."))).alias("legal_text"), F.when(F.col("decision") == "exclude", "text_and_data_mining_reserved").otherwise("no_reservation_found").alias("review_status"), F.lit("45901").alias("review_date"))
    return R.policy_rules(reviews).select("host", "decision", "evidence_urls", "article_count", "review_date")


@query()
def src_06_numbered_elements(spark, d):
    docs = view(spark, d, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"))).alias("lines"))
    return files.numbered(docs, "lines", keep=("doc_id",))


# projections, joins and sets ------------------------------------------------------------------------------------


@query("SELECT match_id, home_shots - away_shots AS diff_shots, home_goals - away_goals AS diff_goals, home_fouls - away_fouls AS diff_fouls FROM fx_match")
def prj_24_side_differences(spark, d):
    return view(spark, d, "fx_match").select("match_id", *[(F.col(f"home_{c}") - F.col(f"away_{c}")).alias(f"diff_{c}") for c in ("shots", "goals", "fouls")])


@query("SELECT t.task_id, t.match_id, t.side, t.team_id, CASE t.side WHEN 'home' THEN m.away_team_id ELSE m.home_team_id END AS opponent_id, w.links FROM fx_task t JOIN fx_match m ON m.match_id = t.match_id JOIN (SELECT match_id, content_id, count(*) AS links FROM fx_task GROUP BY ALL) w ON w.match_id = t.match_id AND w.content_id = t.content_id")
def join_07_prj_19_task_star(spark, d):
    t, m = view(spark, d, "fx_task"), view(spark, d, "fx_match")
    links = N.winners(t, ["match_id", "content_id"], ["task_id"], "source_host").select("match_id", "content_id", "links")
    return t.join(m.select("match_id", "home_team_id", "away_team_id"), "match_id").join(links, ["match_id", "content_id"]).select("task_id", "match_id", "side", "team_id", F.when(F.col("side") == "home", F.col("away_team_id")).otherwise(F.col("home_team_id")).alias("opponent_id"), "links")


@query("SELECT t.task_id FROM fx_task t JOIN fx_match m ON m.match_id = t.match_id WHERE t.team_id + CASE WHEN t.task_id % 41 = 0 THEN 1 ELSE 0 END <> CASE t.side WHEN 'home' THEN m.home_team_id ELSE m.away_team_id END")
def join_08_09_ownership(spark, d):
    t = view(spark, d, "fx_task").withColumn("team_id", F.expr("team_id + CASE WHEN task_id % 41 = 0 THEN 1 ELSE 0 END"))
    j = t.join(view(spark, d, "fx_match").select("match_id", "home_team_id", "away_team_id"), "match_id")
    # the coalesce keeps the optimizer from inferring that the planted id is not null, a predicate by which it would join events with contexts before it has their common key
    other = F.col("team_id") != F.when(F.col("side") == "home", F.col("home_team_id")).otherwise(F.col("away_team_id"))
    return j.filter(F.coalesce(other, F.lit(False))).select("task_id")


@query("SELECT match_id, side FROM (SELECT match_id FROM fx_match) CROSS JOIN (VALUES ('home'), ('away')) s(side) WHERE (match_id, side) NOT IN (SELECT match_id, side FROM fx_note WHERE task_id % 3 = 0)")
def join_19_chk_13_context_coverage(spark, d):
    want = view(spark, d, "fx_match").select("match_id", F.explode(F.array(F.lit("home"), F.lit("away"))).alias("side"))
    return want.join(view(spark, d, "fx_note").filter("task_id % 3 = 0"), ["match_id", "side"], "left_anti")


@query("SELECT task_id, task_id IN (SELECT task_id FROM fx_note) AS resolved FROM fx_task WHERE task_id % 7 = 0")
def join_12_set_04_resolved_failures(spark, d):
    f = view(spark, d, "fx_task").filter("task_id % 7 = 0").select("task_id")
    n = view(spark, d, "fx_note").select("task_id")
    return f.join(n, "task_id", "left_semi").withColumn("resolved", F.lit(True)).unionByName(f.join(n, "task_id", "left_anti").withColumn("resolved", F.lit(False)))


@query(f"WITH {OBS_SQL}, n AS (SELECT match_id, round(avg(i1), 6) AS mean_i1 FROM fx_note GROUP BY match_id) SELECT m.match_id, m.matchday, m.home_shots, n.mean_i1 FROM fx_match m LEFT JOIN n ON n.match_id = m.match_id")
def join_13_15_features_and_news(spark, d):
    n = view(spark, d, "fx_note").groupBy("match_id").agg(F.round(F.avg("i1"), 6).alias("mean_i1"))
    return view(spark, d, "fx_match").select("match_id", "matchday", "home_shots").join(n, "match_id", "left")


@query("SELECT t.task_id, t.side FROM fx_task t WHERE sha256('7:' || t.task_id::VARCHAR) < '1' AND t.task_id IN (SELECT task_id FROM fx_note)")
def join_18_flt_10_sample_semi_join(spark, d):
    return view(spark, d, "fx_task").filter(N.seeded_order(F.col("task_id"), 7) < "1").join(view(spark, d, "fx_note"), "task_id", "left_semi").select("task_id", "side")


@query("SELECT league, matchday, kickoff::DATE AS day, match_id, row_number() OVER (PARTITION BY league ORDER BY kickoff, match_id) AS place FROM fx_match")
def ord_01_02_03_kickoff_order(spark, d):
    m = view(spark, d, "fx_match")
    return m.select("league", "matchday", F.to_date("kickoff").alias("day"), "match_id", F.row_number().over(Window.partitionBy("league").orderBy("kickoff", "match_id")).cast("bigint").alias("place"))


@query("SELECT league, matchday FROM fx_match WHERE matchday <= 12 INTERSECT SELECT league, matchday FROM fx_match WHERE matchday >= 10")
def set_05_intersection(spark, d):
    m = view(spark, d, "fx_match")
    return m.filter("matchday <= 12").select("league", "matchday").intersect(m.filter("matchday >= 10").select("league", "matchday"))


@query("SELECT match_id, 'train' AS part FROM fx_match WHERE matchday <= 14 UNION ALL SELECT match_id, 'test' FROM fx_match WHERE matchday > 14")
def set_06_concatenation(spark, d):
    m = view(spark, d, "fx_match")
    return m.filter("matchday <= 14").select("match_id", F.lit("train").alias("part")).unionByName(m.filter("matchday > 14").select("match_id", F.lit("test").alias("part")))


# checks ---------------------------------------------------------------------------------------------------------

BAD = "b AS (SELECT *, CASE WHEN match_id % 31 = 0 THEN home_shots + 1 ELSE home_sot END AS bad_sot, CASE WHEN match_id % 29 = 0 THEN -1 ELSE home_fouls END AS bad_fouls FROM fx_match)"


def _bad(spark, d):
    return view(spark, d, "fx_match").withColumns({"bad_sot": F.expr("CASE WHEN match_id % 31 = 0 THEN home_shots + 1 ELSE home_sot END"), "bad_fouls": F.expr("CASE WHEN match_id % 29 = 0 THEN -1 ELSE home_fouls END")})


@query(f"WITH {BAD} SELECT 'required' AS \"check\", match_id::VARCHAR AS key, 'bad_fouls:count' AS detail FROM b WHERE bad_fouls < 0")
def chk_03_required_values(spark, d):
    return C.required(_bad(spark, d), {"bad_fouls": "count", "match_id": "present"}, ["match_id"])


@query(f"WITH {BAD} SELECT 'domain' AS \"check\", match_id::VARCHAR AS key, 'rule broken' AS detail FROM b WHERE bad_sot > home_shots OR home_team_id = away_team_id")
def chk_07_domain_sanity(spark, d):
    return C.holds(_bad(spark, d), "domain", (F.col("bad_sot") <= F.col("home_shots")) & (F.col("home_team_id") != F.col("away_team_id")), ["match_id"])


@query("SELECT 'unique' AS \"check\", text AS key, count(*)::VARCHAR AS detail FROM documents GROUP BY text HAVING count(*) > 1")
def chk_04_unique_keys(spark, d):
    return C.unique(view(spark, d, "documents"), ["text"])


@query("SELECT 'coverage' AS \"check\", doc_id::VARCHAR AS key, 'only left' AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'coverage', doc_id::VARCHAR, 'only right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def chk_05_set_03_coverage(spark, d):
    return C.covers(view(spark, d, "documents"), view(spark, d, "labels"), ["doc_id"])


@query("SELECT 'conflict' AS \"check\", url AS key, count(DISTINCT (lang, source))::VARCHAR AS detail FROM fx_art GROUP BY url HAVING count(DISTINCT (lang, source)) > 1")
def chk_09_10_conflicting_fields(spark, d):
    return C.single_valued(view(spark, d, "fx_art"), ["url"], ["lang", "source"])


@query("SELECT 'identity' AS \"check\", doc_id::VARCHAR AS key, 'broken' AS detail FROM documents WHERE doc_id % 59 = 0")
def chk_08_rederived_ids(spark, d):
    docs = view(spark, d, "documents").withColumn("content_id", F.when(F.col("doc_id") % 59 == 0, "broken").otherwise(S.prefixed_sha("content_sha256", F.col("text"))))
    return C.rederived(docs, "content_id", S.prefixed_sha("content_sha256", F.col("text")), ["doc_id"])


@query("SELECT 'constant' AS \"check\", 'league' AS key, count(DISTINCT league)::VARCHAR AS detail FROM fx_match HAVING count(DISTINCT league) > 1")
def chk_06_12_constants(spark, d):
    return C.constant(view(spark, d, "fx_match"), ["season", "league"])


@query("WITH m AS (SELECT matchday, kickoff + CASE WHEN match_id % 10 = 3 THEN INTERVAL 200 DAY ELSE INTERVAL 0 DAY END AS k FROM fx_match) SELECT 'chronology' AS \"check\", strftime(max(k) FILTER (matchday <= 14), '%Y-%m-%d') AS latest FROM m HAVING NOT max(k) FILTER (matchday <= 14) < min(k) FILTER (matchday > 14)")
def chk_15_16_chronology(spark, d):
    m = view(spark, d, "fx_match")
    moved = m.withColumn("kickoff", F.expr("kickoff + CASE WHEN match_id % 10 = 3 THEN INTERVAL '200' DAY ELSE INTERVAL '0' DAY END"))
    return C.chronological(moved, F.col("matchday") <= 14, F.col("matchday") > 14, "kickoff").select("check", F.substring("detail", 1, 10).alias("latest"))


@query("SELECT 'probabilities' AS \"check\", match_id || '|' || mdl AS key FROM fx_pred WHERE match_id % 43 = 0")
def chk_18_probabilities(spark, d):
    p = view(spark, d, "fx_pred").withColumn("p_a", F.expr("CASE WHEN match_id % 43 = 0 THEN p_a + 0.01D ELSE p_a END"))
    return C.probabilities(p, ["p_h", "p_d", "p_a"], ["match_id", "mdl"]).select("check", "key")


@query("SELECT 'fields' AS \"check\", doc_id::VARCHAR AS key, 'n_chars' AS detail FROM documents WHERE doc_id % 61 = 0")
def chk_21_equal_fields(spark, d):
    docs = view(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return C.equal_fields(docs, docs.withColumn("n_chars", F.expr("n_chars + CASE WHEN doc_id % 61 = 0 THEN 1 ELSE 0 END")), ["doc_id"], ["lang", "n_chars"])


@query("WITH c AS (SELECT (SELECT count(*) FROM fx_task) AS e, (SELECT count(*) FROM fx_note) AS a, (SELECT count(*) FROM fx_task t WHERE task_id % 97 = 0) AS m) SELECT 'accounting' AS \"check\", key, 'does not add up' AS detail FROM c, (VALUES ('adds up', 0), ('off by one', 1)) v(key, k) WHERE e <> a + m + k UNION ALL SELECT 'accounting', 'none missing', 'does not add up' FROM c WHERE m <> 0")
def chk_19_accounting(spark, d):
    q = N.context_quality(view(spark, d, "fx_task"), view(spark, d, "fx_note")).agg(F.sum("expected").alias("e"), F.sum("annotated").alias("a"), F.sum("missing").alias("m"))
    return C.identities(q, {"adds up": F.col("e") == F.col("a") + F.col("m"), "off by one": F.col("e") == F.col("a") + F.col("m") + 1, "none missing": F.col("m") == 0})


@query("SELECT 'window' AS \"check\", task_id::VARCHAR AS key, 'rule broken' AS detail FROM fx_task t JOIN fx_match m ON m.match_id = t.match_id WHERE NOT (published::DATE BETWEEN DATE '2024-01-02' AND DATE '2024-01-20' AND published < m.kickoff)")
def chk_11_24_publication_window(spark, d):
    t = view(spark, d, "fx_task").join(view(spark, d, "fx_match").select("match_id", "kickoff"), "match_id")
    return C.holds(t, "window", F.to_date("published").between("2024-01-02", "2024-01-20") & (F.col("published") < F.col("kickoff")), ["task_id"])
