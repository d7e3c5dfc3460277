"""Registered queries of the library's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluation as E
from ..operators import matches as M
from ..operators import news as N
from .fixtures import STATS, duck, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TRAIN_END, LAST = 14, 18  # days of the fixture season
FOLDS = ((6, 7, 8), (8, 9, 11), (11, 12, 14))


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = duck(sql)
        return f

    return add


OBS_SQL = "obs AS (" + " UNION ALL ".join(
    f"SELECT match_id, season, league, matchday, kickoff, '{v}' AS venue, {v}_team_id AS team_id, {o}_team_id AS opponent_id, CAST(CASE WHEN {v}_goals > {o}_goals THEN 3 WHEN {v}_goals = {o}_goals THEN 1 ELSE 0 END AS BIGINT) AS points, "
    + ", ".join(f"{v}_{s} AS {s}_for, {o}_{s} AS {s}_against" for s in STATS) + " FROM fx_match"
    for v, o in (("home", "away"), ("away", "home"))
) + ")"
HIST_W = "WINDOW p AS (PARTITION BY season, team_id ORDER BY kickoff, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l AS (PARTITION BY season, team_id ORDER BY kickoff, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY season, team_id, venue ORDER BY kickoff, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t AS (PARTITION BY season, team_id ORDER BY kickoff, match_id)"
RATIO = lambda c, w: f"coalesce(round(sum({c}) OVER {w} / CAST(count(*) OVER {w} AS DOUBLE), 6), 0.0)"


# matches ---------------------------------------------------------------------------------------------------


@query("SELECT match_id, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' ELSE 'A' END AS result, CASE WHEN home_goals > away_goals THEN 'HOME_WIN' WHEN home_goals = away_goals THEN 'DRAW' ELSE 'AWAY_WIN' END AS category, CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS home_points, CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1 ELSE 3 END AS away_points FROM fx_match")
def prj_03_06_outcome_and_points(spark, d):
    r = M.outcome(F.col("home_goals"), F.col("away_goals"))
    return view(spark, d, "fx_match").select("match_id", r.alias("result"), M.recode(r, {"H": "HOME_WIN", "D": "DRAW", "A": "AWAY_WIN"}).alias("category"), M.points(r, True).alias("home_points"), M.points(r, False).alias("away_points"))


@query(f"WITH {OBS_SQL} SELECT match_id, matchday, venue, team_id, opponent_id, points, goals_for, goals_against, shots_for, shots_against, red_for FROM obs")
def prj_07_team_observations(spark, d):
    return M.observations(view(spark, d, "fx_match")).select("match_id", "matchday", "venue", "team_id", "opponent_id", "points", "goals_for", "goals_against", "shots_for", "shots_against", "red_for")


@query(f"SELECT match_id, matchday, CASE WHEN matchday <= {TRAIN_END} THEN 'train' ELSE 'test' END AS split FROM fx_match")
def prj_08_split_label(spark, d):
    return view(spark, d, "fx_match").select("match_id", "matchday", M.split_label(F.col("matchday"), TRAIN_END, LAST).alias("split"))


WINDOW_SQL = f"""WITH {OBS_SQL}, pd AS (SELECT match_id, venue, lag(CAST(kickoff AS DATE)) OVER (PARTITION BY season, team_id ORDER BY kickoff, match_id) AS pdate FROM obs),
j AS (SELECT m.match_id, CAST(m.kickoff AS DATE) AS kd, h.pdate AS ph, a.pdate AS pa FROM fx_match m JOIN pd h ON h.match_id = m.match_id AND h.venue = 'home' JOIN pd a ON a.match_id = m.match_id AND a.venue = 'away'),
w AS (SELECT match_id, ph AS previous_home, pa AS previous_away, kd - 1 AS e, greatest(kd - 5, ph + 1, pa + 1) AS s FROM j)
SELECT match_id, previous_home, previous_away, CASE WHEN s <= e THEN s END AS window_start, e AS window_end, CAST(CASE WHEN s <= e THEN e - s + 1 ELSE 0 END AS INTEGER) AS window_days FROM w"""


@query(WINDOW_SQL)
def prj_09_10_win_01_pre_match_window(spark, d):
    m = view(spark, d, "fx_match")
    prev = M.previous_dates(M.observations(m))
    both = prev.groupBy("match_id").agg(F.max(F.when(F.col("venue") == "home", F.col("previous_date"))).alias("previous_home"), F.max(F.when(F.col("venue") == "away", F.col("previous_date"))).alias("previous_away"), F.max(F.to_date("kickoff")).alias("kd"))
    start, end, days = M.window_before(F.col("kd"), F.col("previous_home"), F.col("previous_away"))
    return both.select("match_id", "previous_home", "previous_away", start.alias("window_start"), end.alias("window_end"), days.alias("window_days"))


HISTORY = {
    "win_02_matches_played": ("played", "count(*) OVER p"),
    "win_03_points_per_game": ("points_per_game", RATIO("points", "p")),
    "win_04_form_points": ("form_points", "CAST(coalesce(sum(points) OVER l, 0) AS BIGINT)"),
    "win_05_goals_for": ("avg_goals_for", RATIO("goals_for", "l")),
    "win_06_goals_against": ("avg_goals_against", RATIO("goals_against", "l")),
    "win_07_shots_for": ("avg_shots_for", RATIO("shots_for", "l")),
    "win_08_shots_against": ("avg_shots_against", RATIO("shots_against", "l")),
    "win_09_on_target_for": ("avg_sot_for", RATIO("sot_for", "l")),
    "win_10_on_target_against": ("avg_sot_against", RATIO("sot_against", "l")),
    "win_11_corners_for": ("avg_corners_for", RATIO("corners_for", "l")),
    "win_12_corners_against": ("avg_corners_against", RATIO("corners_against", "l")),
    "win_13_fouls": ("avg_fouls", RATIO("fouls_for", "l")),
    "win_14_yellow_cards": ("avg_yellow", RATIO("yellow_for", "l")),
    "win_15_red_cards": ("red_per_game", RATIO("red_for", "p")),
    "win_16_venue_played": ("venue_played", "count(*) OVER v"),
    "win_17_venue_points": ("venue_points_per_game", RATIO("points", "v")),
    "win_18_days_since": ("days_since", "CAST(coalesce(CAST(kickoff AS DATE) - lag(CAST(kickoff AS DATE)) OVER t, 0) AS INTEGER)"),
}
for _name, (_col, _sql) in HISTORY.items():
    query(f"WITH {OBS_SQL} SELECT match_id, team_id, {_sql} AS {_col} FROM obs {HIST_W}", _name)(lambda spark, d, c=_col: M.history(M.observations(view(spark, d, "fx_match"))).select("match_id", "team_id", c))

ELO_SQL = """WITH RECURSIVE n AS (SELECT league, team_id, CAST(0 AS BIGINT) AS md, CAST(1000.0 AS DOUBLE) AS r FROM (SELECT DISTINCT league, home_team_id AS team_id FROM fx_match)
 UNION ALL SELECT n.league, n.team_id, n.md + 1, n.r + CASE WHEN m.match_id IS NULL THEN 0 ELSE (CASE WHEN m.home_team_id = n.team_id THEN 1 ELSE -1 END) * 4.0 * pow(1 + abs(m.home_goals - m.away_goals), 1.6) * ((CASE WHEN m.home_goals > m.away_goals THEN 1.0 WHEN m.home_goals = m.away_goals THEN 0.5 ELSE 0.0 END) - 1.0 / (1.0 + pow(10.0, -((CASE WHEN m.home_team_id = n.team_id THEN n.r ELSE o.r END) + 80.0 - (CASE WHEN m.home_team_id = n.team_id THEN o.r ELSE n.r END)) / 400.0))) END
 FROM n LEFT JOIN fx_match m ON m.league = n.league AND m.matchday = n.md + 1 AND (m.home_team_id = n.team_id OR m.away_team_id = n.team_id) LEFT JOIN n o ON o.team_id = CASE WHEN m.home_team_id = n.team_id THEN m.away_team_id ELSE m.home_team_id END AND o.md = n.md
 WHERE n.md < 18)
SELECT m.match_id, round(h.r - a.r, 4) AS rating_difference FROM fx_match m JOIN n h ON h.team_id = m.home_team_id AND h.md = m.matchday - 1 JOIN n a ON a.team_id = m.away_team_id AND a.md = m.matchday - 1"""


def _recursive(sql: str) -> str:
    out = duck("WITH " + sql.strip()[len("WITH RECURSIVE "):])
    return "WITH RECURSIVE " + out[len("WITH "):]


@query()
def win_19_fn_29_rating_difference(spark, d):
    return M.ratings(view(spark, d, "fx_match")).select("match_id", F.round("rating_difference", 4).alias("rating_difference"))


ORACLES["win_19_fn_29_rating_difference"] = _recursive(ELO_SQL)


HIST_SQL = f"hist AS (SELECT match_id, venue, {', '.join(f'{sql} AS {col}' for col, sql in HISTORY.values())} FROM obs {HIST_W})"
SIDES_SQL = "SELECT m.match_id, m.season, m.league, m.matchday, {}, e.rating_difference AS {}, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' ELSE 'A' END AS result{} FROM fx_match m JOIN hist h ON h.match_id = m.match_id AND h.venue = 'home' JOIN hist a ON a.match_id = m.match_id AND a.venue = 'away' JOIN elo e ON e.match_id = m.match_id"
ELO_WITH, ELO_SELECT = ELO_SQL.rsplit("\nSELECT", 1)


def _features_sql(names: dict[str, str], rating: str, more: str = "") -> str:
    columns = ", ".join(f"{side[0]}.{c} AS {side}_{name}" for c, name in names.items() for side in ("home", "away"))
    return _recursive(f"{ELO_WITH}, {OBS_SQL}, {HIST_SQL}, elo AS (SELECT{ELO_SELECT})\n" + SIDES_SQL.format(columns, rating, more))


@query()
def win_20_match_features(spark, d):
    return M.match_features(view(spark, d, "fx_match")).drop("kickoff").withColumn("rating_difference", F.round("rating_difference", 4))


ORACLES["win_20_match_features"] = _features_sql({c: c for c, _ in HISTORY.values()}, "rating_difference")


@query()
def prj_22_23_feature_table(spark, d):
    """The whole feature table by its contract's names and order, kickoff left out."""
    return M.numerical_features(view(spark, d, "fx_match"), TRAIN_END, LAST).drop("kickoff").withColumn("elo_difference_before", F.round("elo_difference_before", 4))


ORACLES["prj_22_23_feature_table"] = _features_sql(M.CONTRACT, "elo_difference_before", f", m.home_team_id, m.away_team_id, CASE WHEN m.matchday <= {TRAIN_END} THEN 'train' ELSE 'test' END AS dataset_split")


@query("SELECT match_id, home_team_id, away_team_id, h.team AS home_team, a.team AS away_team FROM fx_match m JOIN fx_team h ON h.team_id = m.home_team_id JOIN fx_team a ON a.team_id = m.away_team_id")
def join_01_team_names(spark, d):
    t = view(spark, d, "fx_team").select("team_id", "team")
    side = lambda s: t.withColumnsRenamed({"team_id": f"{s}_team_id", "team": f"{s}_team"})
    return view(spark, d, "fx_match").join(side("home"), "home_team_id").join(side("away"), "away_team_id").select("match_id", "home_team_id", "away_team_id", "home_team", "away_team")


SOURCE_B = "b AS (SELECT matchday, home_team_id, away_team_id, home_goals + CASE WHEN match_id % 37 = 0 THEN 1 ELSE 0 END AS b_home, away_goals AS b_away FROM fx_match WHERE match_id % 11 <> 0 UNION ALL SELECT 99, home_team_id, away_team_id, 0, 0 FROM fx_match WHERE match_id % 97 = 0)"


def _source_b(m: DataFrame) -> DataFrame:
    kept = m.filter("match_id % 11 <> 0").selectExpr("matchday", "home_team_id", "away_team_id", "home_goals + CASE WHEN match_id % 37 = 0 THEN 1 ELSE 0 END AS b_home", "away_goals AS b_away")
    return kept.unionByName(m.filter("match_id % 97 = 0").selectExpr("CAST(99 AS BIGINT) AS matchday", "home_team_id", "away_team_id", "CAST(0 AS BIGINT) AS b_home", "CAST(0 AS BIGINT) AS b_away"))


KEYS = ["matchday", "home_team_id", "away_team_id"]


@query(f"WITH {SOURCE_B} SELECT 'matched' AS part, count(*) AS n FROM fx_match m JOIN b USING (matchday, home_team_id, away_team_id) UNION ALL SELECT 'left_only', count(*) FROM fx_match m ANTI JOIN b USING (matchday, home_team_id, away_team_id) UNION ALL SELECT 'right_only', count(*) FROM b ANTI JOIN fx_match m USING (matchday, home_team_id, away_team_id) UNION ALL SELECT 'repeated', 0")
def join_02_set_01_02_agg_01_reconcile(spark, d):
    m = view(spark, d, "fx_match")
    return M.reconcile_counts(m, _source_b(m), KEYS)


@query(f"WITH {SOURCE_B} SELECT match_id, home_goals, b_home, away_goals, b_away FROM fx_match JOIN b USING (matchday, home_team_id, away_team_id) WHERE home_goals <> b_home OR away_goals <> b_away")
def join_03_result_mismatch(spark, d):
    m = view(spark, d, "fx_match")
    return M.mismatches(m.join(_source_b(m), KEYS), [("home_goals", "b_home"), ("away_goals", "b_away")]).select("match_id", "home_goals", "b_home", "away_goals", "b_away")


FOLD_SQL = "WITH f(fold, fit_end, v_start, v_end) AS (VALUES " + ", ".join(f"({i + 1}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(FOLDS)) + """), late AS (SELECT match_id, matchday, kickoff + CASE WHEN match_id % 50 = 3 THEN INTERVAL 60 DAY ELSE INTERVAL 0 DAY END AS kickoff FROM fx_match),
c AS (SELECT fold, min(kickoff) AS cutoff FROM late JOIN f ON matchday BETWEEN v_start AND v_end GROUP BY fold)
SELECT f.fold, CASE WHEN matchday BETWEEN v_start AND v_end THEN 'validation' WHEN kickoff < cutoff THEN 'fit' ELSE 'excluded' END AS role, count(*) AS n, sum(match_id)::BIGINT AS ids FROM late JOIN f ON matchday <= v_end JOIN c ON c.fold = f.fold WHERE matchday <= fit_end OR matchday >= v_start GROUP BY ALL"""


@query(FOLD_SQL)
def flt_07_08_prj_28_folds(spark, d):
    m = view(spark, d, "fx_match").withColumn("kickoff", F.expr("kickoff + CASE WHEN match_id % 50 = 3 THEN INTERVAL '60' DAY ELSE INTERVAL '0' DAY END"))
    return M.fold_rows(m, FOLDS).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("match_id").alias("ids"))


@query("SELECT league, x.matchday FROM (SELECT DISTINCT league FROM fx_match) CROSS JOIN range(1, 21) x(matchday) ANTI JOIN fx_match m USING (league, matchday)")
def agg_15_missing_matchdays(spark, d):
    m = view(spark, d, "fx_match")
    want = m.select("league").distinct().select("league", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(20).cast("bigint"))).alias("matchday"))
    return want.join(m, ["league", "matchday"], "left_anti")


# articles and contents --------------------------------------------------------------------------------------

JUDGED = """j AS (SELECT a.*, coalesce(p.decision, 'unknown') AS decision, CASE WHEN a.host IS NULL OR a.host = '' THEN 'missing_source_host' WHEN p.decision = 'exclude' THEN 'policy_exclude' WHEN p.decision IS NULL THEN 'policy_unknown_host'
 WHEN a.lang IS NULL THEN 'missing_language' WHEN a.lang <> 'en' THEN 'language_mismatch' WHEN NOT (day_no BETWEEN 10 AND 80) THEN 'date_outside_window' WHEN NOT regexp_matches(url, '^https?://') THEN 'invalid_article_url' WHEN trim(text) = '' OR text IS NULL THEN 'missing_article_body' END AS reason
 FROM fx_art a LEFT JOIN fx_policy p ON p.host = a.host)"""


def _judged(spark, d):
    return N.judged(view(spark, d, "fx_art"), view(spark, d, "fx_policy"), "en", 10, 80)


@query(f"WITH {JUDGED} SELECT doc_id, host, decision, reason FROM j")
def flt_01_02_03_join_06_rejection_chain(spark, d):
    return _judged(spark, d).select("doc_id", "host", "decision", "reason")


@query(f"WITH {JUDGED} SELECT 'decision' AS kind, decision AS name, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT 'reason', coalesce(reason, 'accepted'), count(*) FROM j GROUP BY ALL UNION ALL SELECT decision || '_host', host, count(*) FROM j WHERE decision <> 'include' GROUP BY ALL")
def agg_04_occurrence_report(spark, d):
    return N.occurrence_report(_judged(spark, d))


@query("SELECT host, count(*) AS n FROM fx_art GROUP BY host")
def agg_02_occurrences_by_host(spark, d):
    return view(spark, d, "fx_art").groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT decision, count(*) AS hosts, sum(article_count)::BIGINT AS articles, min(article_count) AS least, max(article_count) AS most FROM fx_policy GROUP BY decision")
def agg_03_policy_summary(spark, d):
    return view(spark, d, "fx_policy").groupBy("decision").agg(F.count(F.lit(1)).alias("hosts"), F.sum("article_count").alias("articles"), F.min("article_count").cast("bigint").alias("least"), F.max("article_count").cast("bigint").alias("most"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY request_id, url ORDER BY doc_id) AS k FROM fx_art) SELECT request_id, url, doc_id FROM r WHERE k = 1")
def win_21_first_of_request(spark, d):
    return N.first_of_request(view(spark, d, "fx_art"), ["request_id", "url"], ["doc_id"]).select("request_id", "url", "doc_id")


@query("SELECT count(*) AS links, count(DISTINCT url) AS articles, count(*) - count(DISTINCT url) AS across, count(DISTINCT request_id) AS requests FROM fx_art")
def agg_05_cross_request(spark, d):
    a = view(spark, d, "fx_art").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("url").alias("articles"), F.count_distinct("request_id").alias("requests"))
    return a.select("links", "articles", (F.col("links") - F.col("articles")).alias("across"), "requests")


#: Full Unicode normalisation has no SQL: tests/test_contents.py compares with Python, and with SQL on plain ASCII.
def _contents(spark, d):
    return N.contents(view(spark, d, "documents"), S.normalized_body(F.col("text")), "doc_id", "source")


@query()
def agg_06_fn_02_04_contents(spark, d):
    return _contents(spark, d)


@query()
def agg_07_flt_13_duplicate_report(spark, d):
    return N.duplicate_report(_contents(spark, d))


@query()
def agg_07_group_sizes(spark, d):
    return _contents(spark, d).groupBy("members").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT match_id, content_id, min(task_id) AS winner_task_id, count(*) AS links, count(DISTINCT source_host) AS hosts FROM fx_task GROUP BY match_id, content_id")
def agg_08_win_22_winning_link(spark, d):
    return N.winners(view(spark, d, "fx_task"), ["match_id", "content_id"], ["task_id"], "source_host")


@query("WITH w AS (SELECT match_id, content_id, count(*) AS links FROM fx_task GROUP BY ALL) SELECT links, count(*) AS n FROM w GROUP BY links")
def agg_09_link_histogram(spark, d):
    return N.winners(view(spark, d, "fx_task"), ["match_id", "content_id"], ["task_id"], "source_host").groupBy("links").agg(F.count(F.lit(1)).alias("n"))


# annotations -------------------------------------------------------------------------------------------------

RATES = ", ".join(f"count(*) FILTER (rating = {v}) AS n_{'m' if v < 0 else 'p'}{abs(v)}" for v in N.SCALE)
LONG = "l AS (" + " UNION ALL ".join(f"SELECT match_id, side, team_id, matchday, '{i}' AS indicator, {i} AS rating FROM fx_note" for i in N.INDICATORS) + ")"


@query(f"WITH {LONG} SELECT match_id, side, indicator, count(*) AS successes, count(rating) AS mentions, count(*) - count(rating) AS not_mentioned, round(count(rating) / count(*), 6) AS share, coalesce(round(sum(rating) / count(rating), 6), 0.0) AS mean, {RATES} FROM l GROUP BY match_id, side, indicator")
def agg_10_indicator_summary(spark, d):
    return N.indicator_summary(view(spark, d, "fx_note"), ["match_id", "side"])


@query("SELECT match_id, " + ", ".join(f"coalesce(round(sum({i}) FILTER (side = '{s}') / count({i}) FILTER (side = '{s}'), 6), 0.0) AS {s}_{i}_mean, coalesce(round(count({i}) FILTER (side = '{s}') / count(*) FILTER (side = '{s}'), 6), 0.0) AS {s}_{i}_share" for s in ("home", "away") for i in N.INDICATORS) + " FROM fx_note GROUP BY match_id")
def prj_21_side_features(spark, d):
    return N.side_features(view(spark, d, "fx_note"))


QUALITY = "q AS (SELECT t.match_id, t.side, count(*) AS expected, count(n.task_id) AS annotated, count(*) - count(n.task_id) AS missing, round(count(n.task_id) / count(*), 6) AS coverage, coalesce(list(t.task_id ORDER BY t.task_id) FILTER (n.task_id IS NULL), []) AS missing_ids FROM fx_task t LEFT JOIN fx_note n ON n.task_id = t.task_id GROUP BY ALL)"


def _quality(spark, d):
    return N.context_quality(view(spark, d, "fx_task"), view(spark, d, "fx_note"))


@query(f"WITH {QUALITY} SELECT * FROM q")
def agg_11_join_10_context_quality(spark, d):
    return _quality(spark, d)


@query(f"WITH {QUALITY} SELECT coalesce(side, 'all') AS side, count(*) AS contexts, sum(expected)::BIGINT AS expected, sum(annotated)::BIGINT AS annotated, round(sum(annotated) / sum(expected), 6) AS coverage FROM q GROUP BY ROLLUP (side)")
def agg_12_side_totals(spark, d):
    return N.side_totals(_quality(spark, d))


PAIRS = "k AS (" + " UNION ALL ".join(f"SELECT a.task_id, '{i}' AS indicator, a.{i} AS a, b.{i} AS b FROM fx_note a JOIN fx_note2 b ON b.task_id = a.task_id" for i in N.INDICATORS) + "), r AS (SELECT *, CASE WHEN a IS NOT DISTINCT FROM b THEN NULL WHEN a IS NULL OR b IS NULL THEN 'mention' WHEN a * b < 0 THEN 'polarity' WHEN a = 0 OR b = 0 THEN 'neutral' ELSE 'intensity' END AS kind FROM k)"


def _agreement(spark, d):
    return N.agreement(view(spark, d, "fx_note"), view(spark, d, "fx_note2"))


@query(f"WITH {PAIRS} SELECT * FROM r")
def stat_04_join_16_fn_24_test_retest(spark, d):
    return _agreement(spark, d)


@query(f"WITH {PAIRS} SELECT indicator, kind, count(*) AS n FROM r WHERE kind IS NOT NULL GROUP BY ALL")
def agg_26_difference_kinds(spark, d):
    return _agreement(spark, d).filter(F.col("kind").isNotNull()).groupBy("indicator", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PAIRS}, t AS (SELECT task_id, count(kind) AS differing FROM r GROUP BY task_id), h AS (SELECT differing, count(*) AS n FROM t GROUP BY differing) SELECT x.differing, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM h), 6) AS share FROM range(0, 5) x(differing) LEFT JOIN h ON h.differing = x.differing")
def agg_25_differing_indicators(spark, d):
    t = _agreement(spark, d).groupBy("task_id").agg(F.count("kind").alias("differing")).groupBy("differing").agg(F.count(F.lit(1)).alias("n"))
    t = spark.range(5).withColumnRenamed("id", "differing").join(t, "differing", "left").fillna(0, ["n"])
    return t.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


@query(f"WITH {PAIRS} SELECT indicator, count(a) AS mentions_a, count(b) AS mentions_b, round(count(a) / count(*), 6) AS share_a, round(count(b) / count(*), 6) AS share_b, CAST(sum(a) AS BIGINT) AS sum_a, CAST(sum(b) AS BIGINT) AS sum_b, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b FROM r GROUP BY indicator")
def agg_23_27_mentions_by_run(spark, d):
    n = F.count(F.lit(1))
    return _agreement(spark, d).groupBy("indicator").agg(F.count("a").alias("mentions_a"), F.count("b").alias("mentions_b"), F.round(F.count("a") / n, 6).alias("share_a"), F.round(F.count("b") / n, 6).alias("share_b"), *[f for c in "ab" for f in (F.sum(c).alias(f"sum_{c}"), F.round(F.avg(c), 6).alias(f"mean_{c}"))])


@query(f"WITH {PAIRS} SELECT indicator, {', '.join(f'count(*) FILTER (a = {v}) AS a_{v + 2}, count(*) FILTER (b = {v}) AS b_{v + 2}' for v in N.SCALE)} FROM r GROUP BY indicator")
def agg_24_rating_histogram(spark, d):
    return _agreement(spark, d).groupBy("indicator").agg(*[f for v in N.SCALE for f in (F.count_if(F.col("a") == v).alias(f"a_{v + 2}"), F.count_if(F.col("b") == v).alias(f"b_{v + 2}"))])


@query(f"WITH {LONG}, c AS (SELECT indicator, rating, count(*) AS n FROM l WHERE rating IS NOT NULL GROUP BY ALL) SELECT indicator, rating, n, round(100.0 * n / sum(n) OVER (PARTITION BY indicator), 6) AS percent, round(sum(n * rating) OVER (PARTITION BY indicator) / sum(n) OVER (PARTITION BY indicator), 6) AS mean FROM c")
def agg_28_rating_percent(spark, d):
    n = _long(spark, d).filter(F.col("rating").isNotNull()).groupBy("indicator", "rating").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("indicator")
    return n.withColumns({"percent": F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(own), 6), "mean": F.round(F.sum(F.col("n") * F.col("rating")).over(own) / F.sum("n").over(own), 6)})


def _long(spark, d):
    n = view(spark, d, "fx_note")
    return n.select("match_id", "side", "team_id", "task_id", F.explode(F.array(*[F.struct(F.lit(i).alias("indicator"), F.col(i).alias("rating")) for i in N.INDICATORS])).alias("x")).select("match_id", "side", "team_id", "task_id", "x.*")


@query("SELECT team_id, " + ", ".join(f"round(avg({i}), 6) AS mean_{i}, count({i}) AS n_{i}" for i in N.INDICATORS) + " FROM fx_note GROUP BY team_id")
def agg_29_prj_25_team_indicator_matrix(spark, d):
    p = _long(spark, d).groupBy("team_id").pivot("indicator", list(N.INDICATORS)).agg(F.round(F.avg("rating"), 6).alias("mean"), F.count("rating").alias("n"))
    return p.select("team_id", *[F.col(f"{i}_{k}").alias(f"{k}_{i}") for i in N.INDICATORS for k in ("mean", "n")])


@query(f"WITH {PAIRS}, h AS (SELECT indicator, b - a AS diff, count(*) AS n FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL) SELECT i.indicator, x.diff, coalesce(n, 0) AS n FROM (SELECT DISTINCT indicator FROM r) i CROSS JOIN range(-4, 5) x(diff) LEFT JOIN h ON h.indicator = i.indicator AND h.diff = x.diff")
def agg_30_flt_09_difference_distribution(spark, d):
    r = _agreement(spark, d)
    h = r.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy("indicator", (F.col("b") - F.col("a")).cast("bigint").alias("diff")).agg(F.count(F.lit(1)).alias("n"))
    grid = r.select("indicator").distinct().select("indicator", F.explode(F.sequence(F.lit(-4).cast("bigint"), F.lit(4).cast("bigint"))).alias("diff"))
    return grid.join(h, ["indicator", "diff"], "left").fillna(0, ["n"])


@query("SELECT side, count(*) AS tasks, count(DISTINCT matchday) AS matchdays, count(DISTINCT team_id) AS teams, count(DISTINCT source_host) AS hosts, count(DISTINCT content_id) AS contents FROM fx_task GROUP BY side")
def agg_31_pilot_coverage(spark, d):
    return view(spark, d, "fx_task").groupBy("side").agg(F.count(F.lit(1)).alias("tasks"), *[F.count_distinct(c).alias(a) for c, a in (("matchday", "matchdays"), ("team_id", "teams"), ("source_host", "hosts"), ("content_id", "contents"))])


PEND = "f AS (SELECT task_id FROM fx_task WHERE task_id % 97 = 0 AND task_id % 2 = 0)"


@query(f"WITH {PEND} SELECT task_id, true AS retry FROM f UNION ALL SELECT t.task_id, false FROM fx_task t WHERE t.task_id NOT IN (SELECT task_id FROM fx_note) AND t.task_id NOT IN (SELECT task_id FROM f)")
def flt_06_str_01_02_pending(spark, d):
    t, n = view(spark, d, "fx_task"), view(spark, d, "fx_note")
    failed = t.filter("task_id % 97 = 0 AND task_id % 2 = 0")
    return N.pending(t, n, failed, True).select("task_id", F.lit(True).alias("retry")).unionByName(N.pending(t, n, failed).select("task_id", F.lit(False).alias("retry")))


@query("WITH l AS (SELECT user_id AS task_id, count(*) AS last FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT e.user_id AS task_id, e.event_id AS recorded, coalesce(last, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS sequence FROM events e LEFT JOIN l ON l.task_id = e.user_id WHERE event_type <> 'error'")
def win_24_agg_13_failure_sequence(spark, d):
    e = view(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("recorded"), "event_type")
    log = e.filter("event_type = 'error'").drop("event_type").withColumn("sequence", F.row_number().over(Window.partitionBy("task_id").orderBy("recorded")))
    return N.next_sequence(e.filter("event_type <> 'error'").drop("event_type"), log).select("task_id", "recorded", "sequence")


@query("WITH n AS (SELECT doc_id, length(text) AS len, row_number() OVER (ORDER BY length(text)) - 1 AS pos, count(*) OVER () AS n FROM documents), b AS (SELECT min(len) FILTER (pos = round_even((n - 1) * 0.25, 0)) AS q1, min(len) FILTER (pos = round_even((n - 1) * 0.5, 0)) AS q2, min(len) FILTER (pos = round_even((n - 1) * 0.75, 0)) AS q3 FROM n) SELECT doc_id, (len >= q1)::INT + (len >= q2)::INT + (len >= q3)::INT AS bin FROM n, b")
def ord_08_length_bins(spark, d):
    return N.length_bins(view(spark, d, "documents").select("doc_id", "text"), F.length("text")).select("doc_id", "bin")


@query("SELECT doc_id, sha256('42:' || doc_id::VARCHAR) AS h FROM documents ORDER BY h LIMIT 20")
def ord_04_05_09_10_seeded_top(spark, d):
    return view(spark, d, "documents").select("doc_id", N.seeded_order(F.col("doc_id"), 42).alias("h")).orderBy("h").limit(20)


@query()
def ord_07_stratified_sample(spark, d):
    t = N.length_bins(view(spark, d, "fx_task"), F.length(F.col("task_id").cast("string")))
    return N.stratified_sample(t, 60).select("task_id", "matchday", "side", "position")


# evaluation --------------------------------------------------------------------------------------------------

ROWS = "m AS (SELECT *, -ln(least(greatest(CASE actual WHEN 'H' THEN p_h WHEN 'D' THEN p_d ELSE p_a END, 1e-15), 1.0)) AS log_loss, pow((CASE WHEN actual = 'H' THEN 1.0 ELSE 0.0 END) - p_h, 2) + pow((CASE WHEN actual = 'D' THEN 1.0 ELSE 0.0 END) - p_d, 2) + pow((CASE WHEN actual = 'A' THEN 1.0 ELSE 0.0 END) - p_a, 2) AS brier, actual = predicted AS correct FROM fx_pred)"
CLASSES = "k AS (SELECT mdl, y AS label, count(*) FILTER (actual = y) AS support, count(*) FILTER (predicted = y) AS predicted_n, count(*) FILTER (actual = y AND predicted = y) AS hits FROM fx_pred CROSS JOIN (VALUES ('H'), ('D'), ('A')) v(y) GROUP BY ALL), t AS (SELECT *, coalesce(hits / nullif(predicted_n, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(2 * hits / nullif(predicted_n + support, 0), 0) AS f1 FROM k)"
R9 = lambda df, cols: df.withColumns({c: F.round(c, 9) for c in cols})


def _pred(spark, d):
    return view(spark, d, "fx_pred")


@query(f"WITH {ROWS} SELECT match_id, mdl, round(log_loss, 9) AS log_loss, round(brier, 9) AS brier, correct FROM m")
def fn_25_26_row_metrics(spark, d):
    return R9(E.with_row_metrics(_pred(spark, d)).select("match_id", "mdl", "log_loss", "brier", "correct"), ["log_loss", "brier"])


@query(f"WITH {ROWS}, {CLASSES}, f AS (SELECT mdl, avg(f1) AS macro_f1 FROM t GROUP BY mdl) SELECT mdl, count(*) AS rows, round(avg(log_loss), 9) AS log_loss, round(avg(correct::DOUBLE), 9) AS accuracy, round(avg(brier), 9) AS brier, round(any_value(macro_f1), 9) AS macro_f1 FROM m JOIN f USING (mdl) GROUP BY mdl")
def ml_06_metrics(spark, d):
    return R9(E.metrics(_pred(spark, d), ["mdl"]), ["log_loss", "accuracy", "brier", "macro_f1"])


@query(f"WITH {CLASSES} SELECT mdl, label, support, predicted_n, hits, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM t")
def agg_19_class_table(spark, d):
    return R9(E.class_table(_pred(spark, d), ["mdl"]), ["precision", "recall", "f1"])


@query("SELECT mdl, y AS actual, " + ", ".join(f"count(*) FILTER (actual = y AND predicted = '{z}') AS n_{z}" for z in "HDA") + " FROM fx_pred CROSS JOIN (VALUES ('H'), ('D'), ('A')) v(y) GROUP BY ALL")
def agg_16_confusion(spark, d):
    return E.confusion(_pred(spark, d), ["mdl"])


@query("SELECT mdl, y AS label, round(avg((actual = y)::DOUBLE), 9) AS observed, round(avg(CASE y WHEN 'H' THEN p_h WHEN 'D' THEN p_d ELSE p_a END), 9) AS expected FROM fx_pred CROSS JOIN (VALUES ('H'), ('D'), ('A')) v(y) GROUP BY ALL")
def agg_20_calibration(spark, d):
    return R9(E.calibration(_pred(spark, d), ["mdl"]), ["observed", "expected"])


PAIRED = f"{ROWS}, g AS (SELECT b.match_id, b.league, b.matchday, b.log_loss - c.log_loss AS gain, b.correct AS bc, c.correct AS cc FROM m b JOIN m c ON c.match_id = b.match_id AND c.mdl = 1 WHERE b.mdl = 0)"


def _paired(spark, d):
    return E.paired(_pred(spark, d), 0, 1)


@query(f"WITH {PAIRED} SELECT league, matchday, round(avg(gain), 9) AS gain FROM g GROUP BY ALL")
def agg_21_join_14_gain_by_matchday(spark, d):
    return _paired(spark, d).groupBy("league", "matchday").agg(F.round(F.avg("gain"), 9).alias("gain"))


@query(f"WITH {PAIRED}, b AS (SELECT league, floor((matchday + 1) / 2) AS pair, avg(gain) AS m FROM g GROUP BY ALL), a AS (SELECT league, list(m ORDER BY pair) AS ms FROM b GROUP BY league), v AS (SELECT league, ms, len(ms) AS k, unnest(range(0, 1 << len(ms))) AS v FROM a), s AS (SELECT league, k, list_sum(ms) / k AS gain, abs(list_sum(list_transform(range(0, k), lambda i: CASE WHEN (v >> i) & 1 = 1 THEN ms[i + 1] ELSE -ms[i + 1] END))) / k AS f FROM v) SELECT league, k::INT AS blocks, round(any_value(gain), 9) AS gain, round(count(*) FILTER (f >= abs(gain) - 1e-13) / count(*), 9) AS p_value FROM s GROUP BY league, k")
def stat_01_sign_flip_test(spark, d):
    return R9(E.sign_flip_test(_paired(spark, d).withColumn("pair", F.floor((F.col("matchday") + 1) / 2)), ["league"], block="pair"), ["gain", "p_value"])


@query(f"WITH {PAIRED}, t AS (SELECT league, count(*) FILTER (bc AND cc) AS \"both\", count(*) FILTER (bc AND NOT cc) AS base_only, count(*) FILTER (NOT bc AND cc) AS cand_only, count(*) FILTER (NOT bc AND NOT cc) AS neither FROM g GROUP BY league) SELECT *, round(least(1.0, 2.0 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1))) FROM (SELECT base_only + cand_only AS n, unnest(range(0, least(base_only, cand_only) + 1)) AS i)) / pow(2.0, base_only + cand_only)), 9) AS p_value FROM t")
def stat_02_agg_22_mcnemar(spark, d):
    return R9(E.mcnemar(_paired(spark, d), ["league"]), ["p_value"])


@query(f"WITH {PAIRED}, r AS (SELECT match_id, round(gain, 9) AS gain, row_number() OVER (ORDER BY gain DESC, match_id) AS best, row_number() OVER (ORDER BY gain, match_id) AS worst FROM g) SELECT match_id, gain FROM r WHERE best <= 5 OR worst <= 5")
def stat_03_ord_05_best_and_worst(spark, d):
    g = _paired(spark, d).select("match_id", "gain")
    ends = g.orderBy(F.desc("gain"), "match_id").limit(5).unionByName(g.orderBy("gain", "match_id").limit(5))
    return R9(ends.distinct(), ["gain"])


@query("SELECT league, y AS label, count(*) FILTER (actual = y) AS n, round(count(*) FILTER (actual = y) / count(*), 9) AS share FROM fx_score CROSS JOIN (VALUES ('H'), ('D'), ('A')) v(y) GROUP BY ALL")
def agg_14_class_counts(spark, d):
    return R9(E.class_counts(view(spark, d, "fx_score"), ["league"], "actual"), ["share"])


@query(f"WITH r AS (SELECT match_id, matchday, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS result FROM fx_match), p AS (SELECT avg((result = 'H')::DOUBLE) AS p_h, avg((result = 'D')::DOUBLE) AS p_d, avg((result = 'A')::DOUBLE) AS p_a FROM r WHERE matchday <= {TRAIN_END}) SELECT match_id, result, round(p_h, 9) AS p_h, round(p_d, 9) AS p_d, round(p_a, 9) AS p_a, CASE WHEN p_h >= p_d AND p_h >= p_a THEN 'H' WHEN p_d >= p_a THEN 'D' ELSE 'A' END AS predicted FROM r, p WHERE matchday > {TRAIN_END}")
def ml_01_07_prior_predictions(spark, d):
    s = view(spark, d, "fx_match").select("match_id", "matchday", M.outcome(F.col("home_goals"), F.col("away_goals")).alias("result"))
    out = E.prior_predictions(s.filter(F.col("matchday") <= TRAIN_END), s.filter(F.col("matchday") > TRAIN_END).drop("matchday"))
    return R9(out, ["p_h", "p_d", "p_a"])


@query(f"WITH s AS (SELECT avg(home_shots) AS m1, stddev_pop(home_shots) AS s1, avg(away_fouls) AS m2, stddev_pop(away_fouls) AS s2 FROM fx_match WHERE matchday <= {TRAIN_END}) SELECT match_id, round((home_shots - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) AS home_shots, round((away_fouls - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 6) AS away_fouls FROM fx_match, s")
def ml_02_standardize(spark, d):
    m = view(spark, d, "fx_match").select("match_id", "matchday", "home_shots", "away_fouls")
    out = E.standardize(m, F.col("matchday") <= TRAIN_END, ["home_shots", "away_fouls"]).drop("matchday")
    return out.withColumns({c: F.round(c, 6) for c in ("home_shots", "away_fouls")})


@query(f"WITH {ROWS}, f AS (SELECT mdl, matchday % 3 AS fold, avg(log_loss) AS loss FROM m GROUP BY ALL) SELECT mdl, round(avg(loss), 9) AS mean, round(stddev_pop(loss), 9) AS sd_pop, round(stddev_samp(loss), 9) AS sd_samp, round(stddev_samp(loss) / sqrt(count(*)), 9) AS se FROM f GROUP BY mdl")
def agg_17_18_fold_summary(spark, d):
    f = E.with_row_metrics(_pred(spark, d)).groupBy("mdl", (F.col("matchday") % 3).alias("fold")).agg(F.avg("log_loss").alias("loss"))
    return R9(E.fold_summary(f, ["mdl"], "loss"), ["mean", "sd_pop", "sd_samp", "se"])


CAND = "SELECT league AS model_id, CAST(16 + league % 3 AS INT) AS feature_count, pow(10.0, -(league % 4)) AS c, round(avg(home_shots), 4) AS loss, 0.5 AS se FROM fx_match GROUP BY league"


@query(f"WITH c AS ({CAND}), r AS (SELECT *, row_number() OVER (ORDER BY loss, feature_count, c) AS strict_rank FROM c), e AS (SELECT *, loss <= (SELECT loss + se FROM r WHERE strict_rank = 1) AS eligible FROM r) SELECT model_id, strict_rank, eligible, row_number() OVER (ORDER BY eligible DESC, CASE WHEN eligible THEN feature_count END, CASE WHEN eligible THEN c END, CASE WHEN eligible THEN loss END, strict_rank) AS selection_rank FROM e")
def ml_12_win_23_one_standard_error(spark, d):
    m = view(spark, d, "fx_match").groupBy(F.col("league").alias("model_id")).agg(F.round(F.avg("home_shots"), 4).alias("loss"))
    c = m.selectExpr("model_id", "CAST(16 + model_id % 3 AS INT) AS feature_count", "pow(10.0D, -(model_id % 4)) AS c", "loss", "0.5D AS se")
    return E.one_standard_error(c).select("model_id", F.col("strict_rank").cast("bigint").alias("strict_rank"), "eligible", F.col("selection_rank").cast("bigint").alias("selection_rank"))


@query()
def ml_03_09_logistic_predictions(spark, d):
    f = M.match_features(view(spark, d, "fx_match"))
    cols = ["rating_difference", "home_form_points", "away_form_points", "home_avg_goals_for", "away_avg_goals_for"]
    _, out = E.logistic(f.filter(F.col("matchday") <= TRAIN_END), f.filter(F.col("matchday") > TRAIN_END), cols)
    return out.select("match_id", "result", "predicted", "p_h", "p_d", "p_a")
