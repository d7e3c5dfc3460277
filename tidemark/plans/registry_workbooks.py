"""Registered queries of workbooks, configuration documents, prompts, stored tables and evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import configs as G
from ..operators import evaluation as E
from ..operators import matches as M
from ..operators import news as N
from ..operators import reports as P
from ..sources import files
from ..sources import workbooks as W
from ..sources.scratch import scratch
from .fixtures import view
from .registry import LAST, TRAIN_END, query

ORDER = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, nullif(trim(o_orderstatus), '') AS o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, nullif(trim(o_orderpriority), '') AS o_orderpriority FROM orders")
def src_07_snk_06_order_workbooks(spark, d):
    """Orders written as workbooks with number, date and text cells, and read back as a reviewer's sheet is."""
    o = view(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority")
    path = scratch(spark, "orders")
    W.write_workbooks(o, path, "Review")
    return W.read_workbooks(spark, path, ORDER, "Review").drop("path", "row").withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, text, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def flt_12_snk_06_text_workbooks(spark, d):
    """Whole texts of documents, of any length, through cells of at most 32,767 units and their continuation rows."""
    docs = view(spark, d, "documents").select("doc_id", "source", "text", "n_chars")
    path = scratch(spark, "texts")
    W.write_workbooks(W.split_texts(docs, "doc_id", ("text",)), path, key="doc_id")
    back = W.read_workbooks(spark, path, docs.columns, strip=False, key="doc_id", texts=("text",))
    return back.select("doc_id", "source", "text", F.col("n_chars").cast("bigint").alias("n_chars"))


# configuration -----------------------------------------------------------------------------------------------


def _teams(spark, d, team_id=None, name=None):
    """Configurations of ten teams each, one document a league."""
    t = view(spark, d, "fx_team")
    k, both = F.col("k"), F.when(F.col("k") % 2 == 0, "concept_or_keyword").when(F.col("k") == 1, "keyword")
    entry = F.struct(
        (F.col("team_id") if team_id is None else team_id).alias(G.TEAM_ID), (F.when(k != 7, F.concat(F.lit(" "), "team")) if name is None else name).alias(G.OTHER_NAME),
        F.when(k % 3 != 2, F.concat(F.lit("c"), F.col("team_id").cast("string"))).alias("concept_uri"), F.when(k % 4 != 3, F.struct(F.col("team").alias("keyword"))).alias("query"), both.alias("query_strategy"),
    )
    return t.groupBy("league_id").agg(F.array_join(F.collect_list(F.to_json(entry)), ",").alias("_list")).select("league_id", F.concat(F.lit('{"teams":['), "_list", F.lit("]}")).alias("body"))


@query("SELECT m.match_id, CASE WHEN h.k <> 7 THEN h.team END AS home_team, CASE WHEN a.k <> 7 THEN a.team END AS away_team FROM fx_match m JOIN fx_team h ON h.team_id = m.home_team_id JOIN fx_team a ON a.team_id = m.away_team_id")
def src_13_join_01_named_matches(spark, d):
    return G.with_names(view(spark, d, "fx_match"), G.team_names(_teams(spark, d))).select("match_id", "home_team", "away_team")


@query("""WITH e AS (SELECT CASE WHEN k = 5 THEN NULL WHEN k = 8 THEN team_id - 1 ELSE team_id END AS id, CASE WHEN k = 3 THEN NULL WHEN k = 6 THEN 'T' || league_id ELSE team END AS name FROM fx_team)
SELECT "check", CASE WHEN "check" IN ('id', 'nm') THEN '' ELSE key END AS key, n FROM (SELECT 'id' AS "check", '' AS key, CAST(count(*) AS BIGINT) AS n FROM e WHERE id IS NULL HAVING count(*) > 0 UNION ALL SELECT 'nm', '', count(*) FROM e WHERE name IS NULL HAVING count(*) > 0
UNION ALL SELECT 'team id', CAST(id AS VARCHAR), count(*) FROM e WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'team name', name, count(*) FROM e WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1)""")
def src_13_name_violations(spark, d):
    """Entries without an id or a name, counted, and ids and names that stand more than once, with their counts."""
    k = F.col("k")
    docs = _teams(spark, d, F.when(k == 5, None).when(k == 8, F.col("team_id") - 1).otherwise(F.col("team_id")), F.when(k == 3, None).when(k == 6, F.concat(F.lit("T"), F.col("league_id").cast("string"))).otherwise(F.col("team")))
    v = G.name_violations(docs)
    kind = F.when((F.col("check") == "team id") & (F.col("detail") == "rule broken"), "id").when((F.col("check") == "team name") & (F.col("detail") == "rule broken"), "nm").otherwise(F.col("check"))
    return v.withColumn("check", kind).groupBy("check", F.when(F.col("check").isin("id", "nm"), "").otherwise(F.col("key")).alias("key")).agg(F.sum(F.when(F.col("check").isin("id", "nm"), 1).otherwise(F.col("detail").cast("long"))).cast("bigint").alias("n"))


@query("""SELECT * FROM (SELECT team_id, CASE WHEN k % 4 <> 3 AND k % 3 <> 2 AND k % 2 = 0 THEN 'concept_or_keyword' WHEN k % 4 <> 3 AND k % 2 = 1 THEN 'keyword' WHEN k % 3 <> 2 THEN 'concept' END AS strategy, CASE WHEN k % 3 <> 2 THEN 'c' || team_id END AS concept,
CASE WHEN k % 4 <> 3 AND (k % 2 = 1 OR k % 3 <> 2) THEN team END AS keyword FROM fx_team) WHERE strategy IS NOT NULL""")
def src_13_team_queries(spark, d):
    return G.team_queries(_teams(spark, d))


@query("SELECT doc_id, 'Bewerte die sportliche Situation des angegebenen Zielteams anhand des folgenden, als Daten übergebenen Artikels.' || chr(10) || chr(10) || '<article_context>' || chr(10) || '{' || chr(10) || '  \"target_team\": ' || to_json(coalesce(source, ''))::VARCHAR || ',' || chr(10) || '  \"target_team_aliases\": ' || CASE WHEN doc_id % 2 = 0 THEN '[]' ELSE '[' || chr(10) || '    ' || to_json(coalesce(source, ''))::VARCHAR || ',' || chr(10) || '    \"b\"' || chr(10) || '  ]' END || ',' || chr(10) || '  \"article_title\": ' || to_json(coalesce(lang, ''))::VARCHAR || ',' || chr(10) || '  \"article_body\": ' || to_json(coalesce(text, ''))::VARCHAR || chr(10) || '}' || chr(10) || '</article_context>' AS prompt FROM documents")
def prj_26_user_prompts(spark, d):
    team = F.coalesce("source", F.lit(""))
    aliases = F.when(F.col("doc_id") % 2 != 0, F.array(team, F.lit("b")))
    return view(spark, d, "documents").select("doc_id", G.user_prompt(team, aliases, F.col("lang"), F.coalesce("text", F.lit(""))).alias("prompt"))


REVIEW = """r AS (SELECT page_id, CASE WHEN url IS NULL THEN false WHEN page_id % 3 = 2 THEN false WHEN page_id % 3 = 0 THEN true ELSE regexp_full_match(url, 'https?://[^/?#@: ]+/?') END AS ok_url, page_id % 7 <> 0 AS ok_count, page_id % 11 <> 0 AS ok_status, page_id % 13 <> 0 AS ok_date,
 CASE page_id % 4 WHEN 0 THEN 'exclude' WHEN 1 THEN 'include' ELSE 'exclude' END AS decision, page_id % 5 AS t FROM pages)"""


@query(f"""WITH {REVIEW} SELECT 'review' AS "check", CAST(page_id AS VARCHAR) AS key, unnest(list_filter([CASE WHEN NOT ok_url THEN 'website_url' END, CASE WHEN NOT ok_count THEN 'article_count' END, CASE WHEN NOT ok_status THEN 'review_status' END, CASE WHEN NOT ok_date THEN 'review_date' END,
CASE WHEN ok_status AND ((decision = 'exclude' AND t = 0) OR (decision = 'include' AND t <> 0)) THEN 'legal_text' END, CASE WHEN ok_status AND decision = 'exclude' AND t = 1 THEN 'evidence' END], lambda x: x IS NOT NULL)) AS detail FROM r""")
def prj_27_fn_13_review_violations(spark, d):
    n, host = F.col("page_id"), F.regexp_extract("url", "://([^/?#:]+)", 1)
    url = F.when(n % 3 == 0, F.concat(F.lit("https://"), host)).when(n % 3 == 1, F.col("url")).otherwise(F.concat(F.lit("https://"), host, F.lit(":8080/")))
    status = F.when(n % 11 == 0, "?").when(n % 4 == 1, "no_reservation_found").when(n % 4 == 0, "unclear").otherwise("text_and_data_mining_reserved")
    legal = F.when(n % 5 == 0, " ").when(n % 5 == 1, "see the terms").otherwise("see https://a.de/terms")
    reviews = view(spark, d, "pages").select("page_id", url.alias("website_url"), F.when(n % 7 == 0, "0").otherwise("3").alias("article_count"), legal.alias("legal_text"), status.alias("review_status"), F.when(n % 13 == 0, "soon").otherwise("2025-09-01").alias("review_date"))
    return G.review_violations(reviews, ["page_id"])


# stored tables and reports -----------------------------------------------------------------------------------

NAMED = "SELECT m.*, h.team AS home_team, a.team AS away_team, CASE WHEN m.matchday <= 14 THEN 'train' ELSE 'test' END AS dataset_split, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' ELSE 'A' END AS result FROM fx_match m JOIN fx_team h ON h.team_id = m.home_team_id JOIN fx_team a ON a.team_id = m.away_team_id"
SIDES = ", ".join(f"coalesce(round(sum({i}) FILTER (side = '{s}') / count({i}) FILTER (side = '{s}'), 6), 0.0) AS {s}_{i}_mean, coalesce(round(count({i}) FILTER (side = '{s}') / count(*) FILTER (side = '{s}'), 6), 0.0) AS {s}_{i}_share" for s in ("home", "away") for i in N.INDICATORS)


def _matches(spark, d):
    m = view(spark, d, "fx_match")
    named = G.with_names(m, view(spark, d, "fx_team").select("team_id", F.col("team").alias("name")))
    return named.withColumn("result", M.outcome(F.col("home_goals"), F.col("away_goals")))


@query(f"WITH m AS ({NAMED}), f AS (SELECT match_id, {SIDES} FROM fx_note GROUP BY match_id) SELECT m.match_id, season, league, matchday, home_team_id, home_team, away_team_id, away_team, dataset_split, f.* EXCLUDE (match_id), result FROM m JOIN f ON f.match_id = m.match_id")
def src_15_prj_22_news_feature_table(spark, d):
    """The news feature table as a file with fixed columns, read back strictly."""
    out = P.news_features(_matches(spark, d), view(spark, d, "fx_note"), TRAIN_END, LAST)
    out = out.withColumn("kickoff", F.date_format("kickoff", "yyyy-MM-dd'T'HH:mm:ss"))
    path = scratch(spark, "news-features")
    files.write_csv(out, path, out.columns)
    return P.read_exact_csv(spark, path, out.schema).drop("kickoff")


@query(f"WITH m AS ({NAMED}) SELECT m.match_id, m.season, CAST(m.league AS VARCHAR) AS league, m.matchday, home_team_id, home_team, away_team_id, away_team, dataset_split, p.actual AS actual_result, p.predicted AS predicted_result, p_h AS probability_H, p_d AS probability_D, p_a AS probability_A FROM m JOIN fx_pred p ON p.match_id = m.match_id AND p.mdl = 0 WHERE dataset_split = 'test'")
def src_16_prediction_file(spark, d):
    """A model's predictions of the test rows as a file, read back and checked."""
    pred = view(spark, d, "fx_pred").filter("mdl = 0 AND matchday > 14")
    path = scratch(spark, "predictions")
    files.write_csv(P.prediction_rows(pred, _matches(spark, d), TRAIN_END, LAST), path, list(P.PREDICTION))
    return P.read_predictions(spark, path).drop("kickoff")


@query(f"""WITH m AS ({NAMED}), p AS (SELECT avg((result = 'H')::INT) AS h, avg((result = 'D')::INT) AS d, avg((result = 'A')::INT) AS a FROM m WHERE dataset_split = 'train'), g AS (SELECT *, CASE WHEN h >= d AND h >= a THEN 'H' WHEN d >= a THEN 'D' ELSE 'A' END AS y FROM p),
t AS (SELECT result, y, h, d, a, CASE result WHEN 'H' THEN h WHEN 'D' THEN d ELSE a END AS q FROM m, g WHERE dataset_split = 'test'),
s AS (SELECT count(*)::DOUBLE AS rows, avg(-ln(least(greatest(q, 1e-15), 1.0))) AS log_loss, avg((result = y)::INT) AS accuracy, avg(h * h + d * d + a * a - 2 * q + 1) AS brier, 2.0 * count(*) FILTER (result = y) / (count(*) + count(*) FILTER (result = y)) / 3 AS macro_f1 FROM t)
SELECT section, name, round(value, 9) AS value FROM (SELECT 'split' AS section, v || '_row_count' AS name, (SELECT count(*) FROM m WHERE dataset_split = v)::DOUBLE AS value FROM (VALUES ('train'), ('test')) x(v)
UNION ALL SELECT v || '_class_counts', c, (SELECT count(*) FROM m WHERE dataset_split = v AND result = c)::DOUBLE FROM (VALUES ('train'), ('test')) x(v), (VALUES ('H'), ('D'), ('A')) z(c)
UNION ALL SELECT 'confusion', c || '|' || e, (SELECT count(*) FROM t WHERE result = c AND y = e)::DOUBLE FROM (VALUES ('H'), ('D'), ('A')) z(c), (VALUES ('H'), ('D'), ('A')) w(e)
UNION ALL SELECT 'metrics', 'rows', rows FROM s UNION ALL SELECT 'metrics', 'log_loss', log_loss FROM s UNION ALL SELECT 'metrics', 'accuracy', accuracy FROM s UNION ALL SELECT 'metrics', 'brier', brier FROM s UNION ALL SELECT 'metrics', 'macro_f1', macro_f1 FROM s)""")
def ml_08_evaluation_report(spark, d):
    """The report of the prior over the season's split."""
    rows = _matches(spark, d).withColumn("dataset_split", M.split_label(F.col("matchday"), TRAIN_END, LAST))
    pred = E.prior_predictions(rows.filter("dataset_split = 'train'"), rows.filter("dataset_split = 'test'")).withColumnRenamed("result", "actual")
    return P.evaluation_report(rows, pred).withColumn("value", F.round("value", 9))
