"""Match operators: team perspective, rolling features, ratings, splits and reconciliation of two sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the rating: start, base factor, exponent of the goal difference, home advantage, scale.
RATING_START, RATING_K, RATING_EXPONENT, RATING_HOME, RATING_SCALE = 1000.0, 4.0, 1.6, 80.0, 400.0
FORM = 5
STATS = ("goals", "shots", "sot", "fouls", "corners", "yellow", "red")


def outcome(home: Column, away: Column, labels: Sequence[str] = ("H", "D", "A")) -> Column:
    """Home win, draw or away win; null where a side's goals are null."""
    h, d, a = labels
    return F.when(home > away, h).when(home == away, d).when(home < away, a)


def recode(result: Column, mapping: Mapping[str, str]) -> Column:
    """A result in another source's labels; null for labels that are not mapped."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), result)


def points(result: Column, home_side: bool) -> Column:
    """3, 1 or 0 points of a side."""
    return F.when(result == "D", 1).when(result == ("H" if home_side else "A"), 3).when(result.isNotNull(), 0)


def split_label(matchday: Column, train_end: int, last: int) -> Column:
    """``train`` up to a matchday, ``test`` up to the last, an error beyond."""
    return F.when(matchday.between(1, train_end), "train").when(matchday.between(train_end + 1, last), "test").otherwise(F.raise_error(F.concat(F.lit("no split for matchday "), matchday.cast("string"))))


def safe_ratio(total: Column, count: Column, digits: int = 6) -> Column:
    """A rounded ratio, 0.0 where nothing was counted."""
    return F.coalesce(F.round(F.try_divide(total.cast("double"), count.cast("double")), digits), F.lit(0.0))


def window_before(kickoff_date: Column, previous_home: Column, previous_away: Column, days: int = 5) -> tuple[Column, Column, Column]:
    """(start, end, days) of the dates before a match that follow both sides' last matches; start null if none."""
    end = F.date_sub(kickoff_date, 1)
    start = F.greatest(F.date_sub(kickoff_date, days), F.date_add(previous_home, 1), F.date_add(previous_away, 1))
    start = F.when(start <= end, start)
    return start, end, F.coalesce(F.datediff(end, start) + 1, F.lit(0))


def observations(matches: DataFrame, stats: Sequence[str] = STATS) -> DataFrame:
    """Two rows a match, one from each side's view: statistics for and against, points, venue."""
    result = outcome(F.col("home_goals"), F.col("away_goals"))
    sides = []
    for venue, other in (("home", "away"), ("away", "home")):
        cols = [F.lit(venue).alias("venue"), F.col(f"{venue}_team_id").alias("team_id"), F.col(f"{other}_team_id").alias("opponent_id"), points(result, venue == "home").cast("long").alias("points")]
        cols += [F.col(f"{side}_{s}").alias(f"{s}_{name}") for s in stats for side, name in ((venue, "for"), (other, "against"))]
        sides.append(F.struct(*cols))
    return matches.select("match_id", "season", "league", "matchday", "kickoff", F.explode(F.array(*sides)).alias("o")).select("match_id", "season", "league", "matchday", "kickoff", "o.*")


def previous_dates(obs: DataFrame) -> DataFrame:
    """Each team's date of the match before, over both venues; null for its first."""
    w = Window.partitionBy("season", "team_id").orderBy("kickoff", "match_id")
    return obs.withColumn("previous_date", F.lag(F.to_date("kickoff")).over(w))


def history(obs: DataFrame, form: int = FORM) -> DataFrame:
    """Features of each team before each of its matches, from earlier matches only.

    All frames share one partitioning and order, so the table is shuffled and sorted once (the venue's once more).
    """
    team = Window.partitionBy("season", "team_id").orderBy("kickoff", "match_id")
    past, last = team.rowsBetween(Window.unboundedPreceding, -1), team.rowsBetween(-form, -1)
    venue = Window.partitionBy("season", "team_id", "venue").orderBy("kickoff", "match_id").rowsBetween(Window.unboundedPreceding, -1)
    one = F.lit(1)
    ratio = lambda c, w: safe_ratio(F.sum(c).over(w), F.count(one).over(w))
    recent = {"avg_goals_for": "goals_for", "avg_goals_against": "goals_against", "avg_shots_for": "shots_for", "avg_shots_against": "shots_against", "avg_sot_for": "sot_for", "avg_sot_against": "sot_against", "avg_corners_for": "corners_for", "avg_corners_against": "corners_against", "avg_fouls": "fouls_for", "avg_yellow": "yellow_for"}
    return obs.select(
        "match_id", "season", "league", "matchday", "kickoff", "team_id", "venue",
        F.count(one).over(past).alias("played"),
        ratio("points", past).alias("points_per_game"),
        F.coalesce(F.sum("points").over(last), F.lit(0)).alias("form_points"),
        *[ratio(c, last).alias(name) for name, c in recent.items()],
        ratio("red_for", past).alias("red_per_game"),
        F.count(one).over(venue).alias("venue_played"),
        ratio("points", venue).alias("venue_points_per_game"),
        F.coalesce(F.datediff(F.to_date("kickoff"), F.lag(F.to_date("kickoff")).over(team)), F.lit(0)).alias("days_since"),
    )


def rating_change(home: Column, away: Column, home_goals: Column, away_goals: Column) -> Column:
    """What the home side gains and the away side loses."""
    expected = 1.0 / (1.0 + F.pow(F.lit(10.0), -(home + RATING_HOME - away) / RATING_SCALE))
    actual = F.when(home_goals > away_goals, 1.0).when(home_goals == away_goals, 0.5).otherwise(0.0)
    return RATING_K * F.pow(F.lit(1.0) + F.abs(home_goals - away_goals), F.lit(RATING_EXPONENT)) * (actual - expected)


def ratings(matches: DataFrame) -> DataFrame:
    """``(match_id, rating_difference)`` home less away before each match, by an ordered fold.

    A fold needs one league's season in order, and only that: groups are bounded by a season's matches.
    """
    row = F.struct("kickoff", "match_id", F.col("home_team_id").alias("h"), F.col("away_team_id").alias("a"), F.col("home_goals").alias("hg"), F.col("away_goals").alias("ag"))
    seasons = matches.groupBy("season", "league").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.array_distinct(F.flatten(F.collect_list(F.array("home_team_id", "away_team_id")))).alias("teams"))
    start = F.struct(F.map_from_arrays("teams", F.transform("teams", lambda _: F.lit(RATING_START))).alias("now"), F.array().cast("array<struct<match_id:bigint,rating_difference:double>>").alias("out"))

    def step(state: Column, m: Column) -> Column:
        h, a = F.element_at(state["now"], m["h"]), F.element_at(state["now"], m["a"])
        change = rating_change(h, a, m["hg"], m["ag"])
        now = F.transform_values(state["now"], lambda k, v: F.when(k == m["h"], v + change).when(k == m["a"], v - change).otherwise(v))
        return F.struct(now.alias("now"), F.concat(state["out"], F.array(F.struct(m["match_id"].alias("match_id"), (h - a).alias("rating_difference")))).alias("out"))

    return seasons.select(F.inline(F.aggregate("rows", start, step, lambda s: s["out"])))


def match_features(matches: DataFrame) -> DataFrame:
    """One row a match: both sides' history and the rating difference, with the outcome.

    The history is made once; a match's two sides meet in one aggregate over the match.
    """
    h = history(observations(matches))
    names = [c for c in h.columns if c not in ("match_id", "season", "league", "matchday", "kickoff", "team_id", "venue")]
    sides = h.groupBy("match_id").agg(*[F.max(F.when(F.col("venue") == v, F.col(c))).alias(f"{v}_{c}") for v in ("home", "away") for c in names])
    base = matches.select("match_id", "season", "league", "matchday", "kickoff", outcome(F.col("home_goals"), F.col("away_goals")).alias("result"))
    return base.join(sides, "match_id").join(ratings(matches), "match_id")


# The columns of the feature table, by their names here.
CONTRACT = {
    "played": "matches_played", "points_per_game": "points_per_game", "form_points": "form_points_last_5", "avg_goals_for": "goals_for_last_5_avg", "avg_goals_against": "goals_against_last_5_avg",
    "avg_shots_for": "shots_for_last_5_avg", "avg_shots_against": "shots_against_last_5_avg", "avg_sot_for": "shots_on_target_for_last_5_avg", "avg_sot_against": "shots_on_target_against_last_5_avg",
    "avg_corners_for": "corners_for_last_5_avg", "avg_corners_against": "corners_against_last_5_avg", "avg_fouls": "fouls_committed_last_5_avg", "avg_yellow": "yellow_cards_last_5_avg",
    "red_per_game": "red_cards_per_game", "venue_played": "venue_matches_played", "venue_points_per_game": "venue_points_per_game", "days_since": "days_since_last_match",
}
METADATA = ("match_id", "season", "league", "matchday", "kickoff", "home_team_id", "home_team", "away_team_id", "away_team", "dataset_split")
FEATURES = (*[f"{side}_{name}" for name in CONTRACT.values() for side in ("home", "away")], "elo_difference_before")
COUNTS = ("home_matches_played", "away_matches_played", "home_venue_matches_played", "away_venue_matches_played")
SETS = {"full": FEATURES, "without_match_counts": tuple(c for c in FEATURES if c not in COUNTS)}


def numerical_features(matches: DataFrame, train_end: int, last: int) -> DataFrame:
    """The feature table: metadata (teams' names where there are any), the 35 features in their order, the result."""
    named = {f"{side}_{c}": f"{side}_{name}" for c, name in CONTRACT.items() for side in ("home", "away")} | {"rating_difference": "elo_difference_before"}
    f = match_features(matches).select("match_id", "result", *[F.col(c).alias(name) for c, name in named.items()])
    meta = matches.withColumn("dataset_split", split_label(F.col("matchday"), train_end, last))
    return meta.select(*[c for c in METADATA if c in meta.columns]).join(f, "match_id").select(*[c for c in METADATA if c in meta.columns], *FEATURES, "result")


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """One-to-one join of two sources on ``keys`` with its audit: matched, left_only, right_only, repeated."""
    repeated = left.groupBy(*keys).count().filter("count > 1").select(*keys, F.lit("left").alias("side")).unionByName(right.groupBy(*keys).count().filter("count > 1").select(*keys, F.lit("right").alias("side")))
    return {"matched": left.join(right, list(keys)), "left_only": left.join(right, list(keys), "left_anti"), "right_only": right.join(left, list(keys), "left_anti"), "repeated": repeated}


def reconcile_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(part, n)`` of ``reconcile``'s parts, from one aggregate over the keys of both sides. Null keys match nothing."""
    side = lambda df, a, b: df.select(*keys, F.lit(a).alias("_l"), F.lit(b).alias("_r"))
    per = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(*keys).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    both = known & (F.col("l") > 0) & (F.col("r") > 0)
    n = {"matched": F.when(both, F.col("l") * F.col("r")), "left_only": F.when(~both, F.col("l")), "right_only": F.when(~both, F.col("r")), "repeated": (F.col("l") > 1).cast("long") + (F.col("r") > 1).cast("long")}
    total = per.agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in n.items()])
    return total.select(F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col(k).alias("n")) for k in n])).alias("x")).select("x.*")


def mismatches(joined: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of which any pair of columns differs, null-safely."""
    same = F.lit(True)
    for a, b in pairs:
        same = same & F.col(a).eqNullSafe(F.col(b))
    return joined.filter(~same)


def fold_rows(matches: DataFrame, folds: Sequence[tuple[int, int, int]]) -> DataFrame:
    """``(fold, role, ...)`` of expanding-window folds (last fit day, first and last validation day).

    Rows of the fit window that kick off on or after the first validation match are ``excluded``.
    """
    f = matches.sparkSession.createDataFrame([(i + 1, *x) for i, x in enumerate(folds)], "fold int, fit_end int, v_start int, v_end int")
    start = matches.join(F.broadcast(f), F.col("matchday").between(F.col("v_start"), F.col("v_end"))).groupBy("fold").agg(F.min("kickoff").alias("cutoff"))
    both = matches.join(F.broadcast(f), F.col("matchday") <= F.col("v_end")).join(F.broadcast(start), "fold")
    role = F.when(F.col("matchday").between(F.col("v_start"), F.col("v_end")), "validation").when((F.col("matchday") <= F.col("fit_end")) & (F.col("kickoff") < F.col("cutoff")), "fit").when(F.col("matchday") <= F.col("fit_end"), "excluded")
    return both.withColumn("role", role).filter(F.col("role").isNotNull()).drop("fit_end", "v_start", "v_end")
