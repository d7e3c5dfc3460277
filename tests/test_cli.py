"""The command line over a small season made from the smallest tables."""

import json

from pyspark.sql import functions as F

from tests.conftest import TINY
from tidemark import cli
from tidemark.plans import registry_articles
from tidemark.plans.fixtures import view
from tidemark.sources import workbooks as W


def test_models_from_features_to_reports(spark, tmp_path):
    s = cli.Season(spark, str(tmp_path), 2025)
    m = view(spark, TINY, "fx_match").withColumn("league", F.lit(0).cast("bigint")).filter("home_goals IS NOT NULL")
    s.write(m, "interim", "numerical_matches")
    base = ["--root", str(tmp_path), "--season", "2025", "--train-end", "14", "--last", "18"]
    for command in ("build-numerical-features", "evaluate-numerical-model-dummy", "select-numerical-model-configuration", "evaluate-numerical-model-final"):
        assert cli.main([command, *base], spark) == 0, command
    ids = s.read("processed", "numerical_features").select("match_id")
    s.write(ids.select("match_id", *[(F.col("match_id") % k / k).alias(f"home_i{k}_mean") for k in (3, 5)]), "processed", "news_features")
    assert cli.main(["evaluate-combined-model", *base], spark) == 0
    report = json.loads((tmp_path / "reports" / "season=2025" / "evaluation_final.json").read_text())
    assert report["split"]["test_row_count"] == report["metrics"]["rows"] == s.read("processed", "predictions_final").count() and report["model"]["C"] in cli.CS
    assert s.read("processed", "predictions_final").count() == s.read("processed", "predictions_combined").count() > 0
    s.write(ids.limit(1).select("match_id", F.lit(0.5).alias("home_i3_mean")), "processed", "news_features")
    assert cli.main(["evaluate-combined-model", *base], spark) == 1


def judged_without_host(spark):
    return view(spark, TINY, "fx_raw").filter("rq < 8 AND url_text IS NULL AND NOT has_source").count()


def test_news_steps(spark, tmp_path):
    s = cli.Season(spark, str(tmp_path), 2025)
    folder = tmp_path / "raw" / "season=2025" / "responses"
    folder.mkdir(parents=True)
    asked = view(spark, TINY, "fx_ask").filter("rq < 8").drop("rq", "lang")
    s.write(asked, "interim", "requests")
    s.write(view(spark, TINY, "fx_rule"), "processed", "source_policy")
    for r in registry_articles.responses(spark, TINY).filter("rq < 7").collect():
        (folder / f"{r.request_id}.json").write_text(r.body)
    base = ["--root", str(tmp_path), "--season", "2025", "--lang", "en"]
    assert cli.main(["build-news-articles", *base], spark) == 1  # a response is missing
    (folder / "q7.json").write_text(registry_articles.responses(spark, TINY).filter("rq = 7").first().body)
    for command in ("export-news-source-review", "build-news-articles", "build-news-contents", "build-news-annotation-tasks"):
        assert cli.main([command, *base], spark) == 0, command
    judged = registry_articles.judged(spark, TINY).join(asked.select("request_id"), "request_id").filter("reason IS NULL")
    assert {r.article_id for r in s.read("interim", "articles").collect()} == {r.article_id for r in judged.collect()}
    assert s.read("interim", "source_review").agg(F.sum("article_count")).first()[0] == 200 - judged_without_host(spark)
    assert s.read("interim", "tasks").select("task_id").distinct().count() == s.read("interim", "tasks").count() > 0
    sheet = s.layout.path("interim", "source_review_workbook")
    listed = W.read_workbooks(spark, sheet, list(cli.REVIEW), cli.SHEET)
    assert [(r.website_url, int(r.article_count), r.review_status) for r in listed.orderBy("row").collect()] == [(r.website_url, r.article_count, None) for r in s.read("interim", "source_review").orderBy(F.desc("article_count"), "website_url").collect()]
    assert cli.main(["export-news-source-review", *base], spark) == 1  # the sheet may hold a reviewer's work
    assert cli.main(["export-news-source-review", "--overwrite", *base], spark) == 0
    listed = W.read_workbooks(spark, sheet, list(cli.REVIEW), cli.SHEET)
    reviewed = listed.select("website_url", "article_count", F.lit(None).cast("string").alias("legal_text"), F.lit("no_reservation_found").alias("review_status"), F.lit("2025-09-01").cast("date").alias("review_date"))
    W.write_workbooks(reviewed.coalesce(1), str(tmp_path / "books"), cli.SHEET)
    book = tmp_path / "raw" / "season=2025" / "review.xlsx"
    book.write_bytes(open(W.committed(str(tmp_path / "books"))[0], "rb").read())
    assert cli.main(["build-news-source-policy", *base], spark) == 0
    assert s.read("processed", "source_policy").filter("decision = 'include' AND review_date = DATE'2025-09-01'").count() == listed.count()
    book.rename(tmp_path / "kept.xlsx")
    bad = tmp_path / "raw" / "season=2025"
    bad.mkdir(parents=True, exist_ok=True)
    (bad / "review.csv").write_text("website_url,article_count,legal_text,review_status,review_date\nhttps://a.de,x,,no_reservation_found,2025-09-01\n")
    assert cli.main(["build-news-source-policy", *base], spark) == 1


def test_matches_take_the_names_of_the_statistics(spark, tmp_path):
    s = cli.Season(spark, str(tmp_path), 2025)
    m = view(spark, TINY, "fx_match").filter("league = 0")
    days = m.withColumn("day", F.to_date("kickoff"))
    s.write(days.select("match_id", "season", F.lit("bl1").alias("league"), "matchday", F.date_format("kickoff", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("kickoff"), F.lit("x").alias("home_team"), F.lit("y").alias("away_team"), "home_team_id", "away_team_id", "home_goals", "away_goals", F.date_sub("day", 3).alias("window_start"), F.date_sub("day", 1).alias("window_end")), "interim", "matches")
    folder = tmp_path / "raw" / "season=2025"
    folder.mkdir(parents=True)
    stats = {"goals": ("FTHG", "FTAG"), "shots": ("HS", "AS"), "sot": ("HST", "AST"), "fouls": ("HF", "AF"), "corners": ("HC", "AC"), "yellow": ("HY", "AY"), "red": ("HR", "AR")}
    rows = days.select(F.date_format("day", "dd/MM/yyyy").alias("Date"), F.concat(F.lit("N"), "home_team_id").alias("HomeTeam"), F.concat(F.lit("N"), "away_team_id").alias("AwayTeam"), *[F.when(F.lit(c == "sot"), F.least(f"{v}_sot", f"{v}_shots")).otherwise(F.col(f"{v}_{c}")).alias(n) for c, ns in stats.items() for v, n in zip(("home", "away"), ns)]).toPandas()
    rows.to_csv(folder / "stats.csv", index=False)
    ids = sorted({r[0] for r in m.select("home_team_id").collect()})
    teams = [{"openligadb_team_id": i, "football_data_name": f"N{i}", "concept_uri": f"c{i}"} for i in ids]
    base = ["--root", str(tmp_path), "--season", "2025"]
    assert cli.main(["build-numerical-matches", *base], spark) == 1  # the sources' names differ
    for broken in (teams[1:], [*teams[1:], {**teams[0], "football_data_name": teams[1]["football_data_name"]}]):
        (folder / "teams.json").write_text(json.dumps({"teams": broken, "leagues": {}}))
        assert cli.main(["build-numerical-matches", *base], spark) == 1
    assert cli.main(["build-news-requests", *base], spark) == 1  # no concept of the league
    (folder / "teams.json").write_text(json.dumps({"teams": teams, "leagues": {"bl1": {"concept_uri": "u"}}}))
    assert cli.main(["build-numerical-matches", *base], spark) == 0
    assert s.read("interim", "numerical_matches").filter("home_team = concat('N', home_team_id)").count() == m.count()
    assert cli.main(["build-news-requests", *base], spark) == 0
    assert s.read("interim", "requests").count() == 2 * m.count()
