"""Raw match documents, planned requests and policy rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import matches as M

RAW_MATCH = ("matchID long, matchDateTimeUTC string, matchDateTime string, matchIsFinished boolean, group struct<groupOrderID:int>, team1 struct<teamId:long,teamName:string>, team2 struct<teamId:long,teamName:string>, matchResults array<struct<resultTypeID:int,resultName:string,pointsTeam1:int,pointsTeam2:int>>")
FINAL_TYPE, FINAL_NAME = 2, "Endergebnis"
DECISIONS = {"text_and_data_mining_reserved": "exclude", "no_reservation_found": "include", "unclear": "exclude"}


def final_goals(results: str = "matchResults", finished: str = "matchIsFinished") -> tuple[Column, Column]:
    """Goals of the final result: by type first, else by name; both or neither; null while not finished."""
    r = F.col(results)
    by_type = F.get(F.filter(r, lambda x: x["resultTypeID"] == FINAL_TYPE), F.lit(0))
    by_name = F.get(F.filter(r, lambda x: x["resultName"] == FINAL_NAME), F.lit(0))
    final = F.when(F.col(finished), F.coalesce(by_type, by_name))
    both = final["pointsTeam1"].isNotNull() & final["pointsTeam2"].isNotNull()
    return F.when(both, final["pointsTeam1"]), F.when(both, final["pointsTeam2"])


def kickoff_instant(zone: str, utc: str = "matchDateTimeUTC", local: str = "matchDateTime") -> Column:
    """The UTC field if there is one, else the local field read in the zone."""
    return F.coalesce(F.try_to_timestamp(F.nullif(F.col(utc), F.lit(""))), F.to_utc_timestamp(F.try_to_timestamp(F.nullif(F.col(local), F.lit(""))), zone))


def iso_in_zone(instant: Column, zone: str) -> Column:
    """ISO text of an instant in a zone, with its offset, to the second."""
    local = F.from_utc_timestamp(instant, zone)
    minutes = ((F.unix_timestamp(local) - F.unix_timestamp(instant)) / 60).cast("int")
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), (F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def normalize_matches(raw: DataFrame, league: str, season: int, zone: str = "Europe/Berlin", days: int = 5) -> DataFrame:
    """One flat row a raw match, with result and pre-match window; missing nested fields are null."""
    hg, ag = final_goals()
    m = raw.select(
        F.col("matchID").alias("match_id"), F.lit(season).alias("season"), F.lit(league).alias("league"), F.col("group.groupOrderID").alias("matchday"), kickoff_instant(zone).alias("instant"),
        F.col("team1.teamName").alias("home_team"), F.col("team2.teamName").alias("away_team"), F.col("team1.teamId").alias("home_team_id"), F.col("team2.teamId").alias("away_team_id"), hg.alias("home_goals"), ag.alias("away_goals"),
    )
    day = F.to_date(F.from_utc_timestamp("instant", zone))
    long = m.select("match_id", day.alias("date"), "instant", F.explode(F.array(F.struct(F.lit("home").alias("venue"), F.col("home_team_id").alias("team_id")), F.struct(F.lit("away").alias("venue"), F.col("away_team_id").alias("team_id")))).alias("s")).select("match_id", "date", "instant", "s.*").filter("team_id IS NOT NULL")
    from pyspark.sql import Window

    prev = long.withColumn("prev", F.lag("date").over(Window.partitionBy("team_id").orderBy("instant", "match_id"))).groupBy("match_id").agg(F.max(F.when(F.col("venue") == "home", F.col("prev"))).alias("previous_home_match_date"), F.max(F.when(F.col("venue") == "away", F.col("prev"))).alias("previous_away_match_date"))
    j = m.join(prev, "match_id", "left").withColumn("_day", day)
    start, end, n = M.window_before(F.col("_day"), F.col("previous_home_match_date"), F.col("previous_away_match_date"), days)
    result = M.outcome(F.col("home_goals"), F.col("away_goals"), ("HOME_WIN", "DRAW", "AWAY_WIN"))
    return j.select("match_id", "season", "league", "matchday", iso_in_zone(F.col("instant"), zone).alias("kickoff"), "home_team", "away_team", "home_team_id", "away_team_id", "home_goals", "away_goals", result.alias("result"), "previous_home_match_date", "previous_away_match_date", start.alias("window_start"), end.alias("window_end"), n.alias("window_days"))


def requests(matches: DataFrame, teams: DataFrame, leagues: DataFrame, lang: str, kind: str = "team_context") -> DataFrame:
    """Two planned requests a match. ``teams``: (team_id, strategy, concept, keyword); ``leagues``: (league, concept)."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_team_id").alias("team_id")) for s in ("home", "away")]))
    m = matches.select("match_id", "season", "league", "date_start", "date_end", sides.alias("s")).select("match_id", "season", "league", "date_start", "date_end", "s.*")
    m = m.join(F.broadcast(teams), "team_id").join(F.broadcast(leagues.withColumnRenamed("concept", "league_concept")), "league")
    concept, keyword = F.to_json(F.struct(F.col("concept").alias("conceptUri"))), F.to_json(F.struct("keyword"))
    condition = F.when(F.col("strategy") == "concept", concept).when(F.col("strategy") == "keyword", keyword).otherwise(F.concat(F.lit('{"$or":['), concept, F.lit(","), keyword, F.lit("]}")))
    dates = F.to_json(F.struct(F.col("date_start").cast("string").alias("dateStart"), F.col("date_end").cast("string").alias("dateEnd"), F.lit(lang).alias("lang")))
    payload = F.concat(F.lit('{"query":{"$query":{"$and":['), F.to_json(F.struct(F.col("league_concept").alias("conceptUri"))), F.lit(","), condition, F.lit(","), dates, F.lit("]}}}"))
    return m.select(F.concat_ws("_", "league", "season", "match_id", "side", F.lit(kind)).alias("request_id"), "match_id", "season", "league", "side", "team_id", "strategy", "date_start", "date_end", payload.alias("payload"))


def policy_rules(reviews: DataFrame) -> DataFrame:
    """Rules from reviewed rows (website_url, article_count, legal_text, review_status, review_date), all text."""
    decision = F.element_at(F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv]), F.col("review_status"))
    return reviews.select(F.regexp_replace(S.homepage(F.col("website_url")), "^https://", "").alias("host"), "website_url", F.lit("exact_host").alias("match_type"), decision.alias("decision"), "review_status", S.review_date(F.col("review_date")).alias("review_date"), S.whole_number(F.col("article_count"), True).alias("article_count"), F.coalesce(S.evidence_urls(F.col("legal_text")), F.array().cast("array<string>")).alias("evidence_urls"))
