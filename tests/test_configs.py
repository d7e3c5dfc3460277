import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks as C
from tidemark.operators import configs as G
from tidemark.operators import reports as P


def doc(spark, body):
    return spark.createDataFrame([(body if isinstance(body, str) else json.dumps(body),)], "body string")


def test_texts_are_quoted_as_json_is(spark):
    texts = ["", "ä\\n\"q\"", "a\nb\r\tc\b\f", "".join(map(chr, range(32))), "\x7f  𝄞 </article_context>", "\\u001f"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(G.quoted(F.col("t"))).collect()
    assert [r[0] for r in got] == [json.dumps(t, ensure_ascii=False) for t in texts]


@pytest.mark.parametrize("aliases", [None, [], ["a"], ["a", 'b "c"']])
def test_prompt_equals_indented_json(spark, aliases):
    row = spark.createDataFrame([("SC Ä", aliases, None, "x\ny")], "team string, aliases array<string>, title string, body string").select(G.user_prompt(*map(F.col, ("team", "aliases", "title", "body")))).first()[0]
    want = json.dumps({"target_team": "SC Ä", "target_team_aliases": aliases or [], "article_title": "", "article_body": "x\ny"}, ensure_ascii=False, indent=2)
    assert row == G.PROMPT[0] + want + G.PROMPT[1]


def test_team_names_and_their_violations(spark):
    teams = [{G.TEAM_ID: 1, G.OTHER_NAME: " A "}, {G.TEAM_ID: "2", G.OTHER_NAME: "B"}, {G.TEAM_ID: True, G.OTHER_NAME: "C"}, {G.TEAM_ID: 1, G.OTHER_NAME: "A"}, {G.TEAM_ID: 5, G.OTHER_NAME: " "}, 7]
    d = doc(spark, {"teams": teams})
    assert [tuple(r) for r in G.team_names(d).collect()][:2] == [(1, "A"), (None, "B")]
    got = {(r["check"], r["key"]) for r in G.name_violations(d).collect()}
    assert got == {("team id", "2"), ("team id", "3"), ("team id", "6"), ("team id", "1"), ("team name", "5"), ("team name", "6"), ("team name", "A")}
    for bad in ({"teams": []}, {"teams": {}}, {}, "no json", "[]"):
        assert [r["check"] for r in G.name_violations(doc(spark, bad)).collect()] == ["teams"], bad
    assert G.name_violations(doc(spark, {"teams": teams[:1]})).isEmpty()


def test_team_queries(spark):
    entry = lambda i, concept=None, keyword=None, strategy=None: {G.TEAM_ID: i, "concept_uri": concept, "query": {"keyword": keyword}, "query_strategy": strategy}
    teams = [entry(1, "c", "k", "concept_or_keyword"), entry(2, "c", "k"), entry(3, "c", "k", "concept"), entry(4, "c", " "), entry(5, None, "k", "concept_or_keyword"), entry(6, None, "k", "keyword"), entry(7, 5), entry("8", "c"), entry(9, "c", "old"), entry(9, "new")]
    got = {r.team_id: (r.strategy, r.concept, r.keyword) for r in G.team_queries(doc(spark, {"teams": teams})).collect()}
    assert got == {1: ("concept_or_keyword", "c", "k"), 2: ("keyword", "c", "k"), 3: ("concept", "c", None), 4: ("concept", "c", None), 6: ("keyword", None, "k"), 9: ("concept", "new", None)}
    leagues = doc(spark, {"leagues": {"a": {"concept_uri": "u"}, "b": {"concept_uri": 5}, "c": "x", "d": {}}})
    assert [tuple(r) for r in G.league_concepts(leagues).collect()] == [("a", "u")]


def test_names_are_joined_by_either_way(spark):
    m = spark.createDataFrame([(1, 10, 11, "raw")], "match_id long, home_team_id long, away_team_id long, home_team string")
    names = spark.createDataFrame([(10, "A")], "team_id long, name string")
    for most in (0, 10):
        assert [(r.home_team, r.away_team) for r in G.with_names(m, names, most).collect()] == [("A", None)]


def review(spark, **kw):
    base = {"website_url": "https://www.a.de/", "article_count": "3.0", "legal_text": "", "review_status": "no_reservation_found", "review_date": "45901"} | kw
    df = spark.createDataFrame([("r", *base.values())], "k string, " + ", ".join(f"{c} string" for c in base))
    return {r.detail for r in G.review_violations(df, ["k"]).collect()}


@pytest.mark.parametrize("change,broken", [
    ({}, set()), ({"website_url": "HTTPS://A.de"}, set()),
    *[({"website_url": u}, {"website_url"}) for u in (None, "", "a.de", "ftp://a.de", "https://u@a.de", "https://a.de:80", "https://a.de/x", "https://a.de/?q", "https://a.de#f", "https://.", "https:///")],
    *[({"article_count": n}, {"article_count"}) for n in (None, "", "0", "-1", "1.5", "x")],
    ({"review_status": None}, {"review_status"}), ({"review_status": "x", "legal_text": "y"}, {"review_status"}), ({"review_date": "soon"}, {"review_date"}),
    ({"legal_text": "no"}, {"legal_text"}), ({"review_status": "unclear"}, {"legal_text"}), ({"review_status": "unclear", "legal_text": "no link"}, {"evidence"}),
    ({"review_status": "unclear", "legal_text": "see https://a.de/x."}, set()),
])
def test_reviews(spark, change, broken):
    assert review(spark, **change) == broken


def predictions(spark, *changes):
    rows = []
    for i, kw in enumerate(changes):
        base = {"match_id": i, "season": 2025, "league": "l", "matchday": 30, "kickoff": "2026-04-01T13:30:00Z", "home_team_id": 1, "home_team": "A", "away_team_id": 2, "away_team": "B", "dataset_split": "test", "actual_result": "H", "predicted_result": "D", "probability_H": 0.25, "probability_D": 0.5, "probability_A": 0.25}
        rows.append(tuple((base | kw).values()))
    return spark.createDataFrame(rows, "match_id long, season long, league string, matchday long, kickoff string, home_team_id long, home_team string, away_team_id long, away_team string, dataset_split string, actual_result string, predicted_result string, probability_H double, probability_D double, probability_A double")


def test_prediction_files_are_read_strictly(spark, tmp_path):
    good = predictions(spark, {}, {"probability_H": 0.4, "probability_D": 0.4, "probability_A": 0.2, "predicted_result": "H"})
    good.withColumn("more", F.lit(1)).write.option("header", True).csv(f"{tmp_path}/good")
    assert sorted(r.match_id for r in P.read_predictions(spark, f"{tmp_path}/good").collect()) == [0, 1]
    good.drop("league").write.option("header", True).csv(f"{tmp_path}/short")
    with pytest.raises(ValueError, match="league"):
        P.read_predictions(spark, f"{tmp_path}/short")
    for i, (bad, check) in enumerate([({"dataset_split": "train"}, "split"), ({"actual_result": "X"}, "class"), ({"probability_H": 0.3}, "probabilities"), ({"probability_H": None}, "probabilities"), ({"predicted_result": "H"}, "likeliest"), ({"match_id": 0}, "unique")]):
        predictions(spark, {}, bad).write.option("header", True).csv(f"{tmp_path}/bad{i}")
        with pytest.raises(C.CheckFailed, match=check):
            P.read_predictions(spark, f"{tmp_path}/bad{i}")


def test_exact_header_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,2.5\n")
    assert [tuple(r) for r in P.read_exact_csv(spark, f"{tmp_path}/a.csv", "id long, x double").collect()] == [(1, 2.5)]
    for schema in ("x double, id long", "id long", "id long, x double, y long"):
        with pytest.raises(ValueError, match="expected the columns"):
            P.read_exact_csv(spark, f"{tmp_path}/a.csv", schema)
    (tmp_path / "b.csv").write_text("id,x\none,2.5\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        P.read_exact_csv(spark, f"{tmp_path}/b.csv", "id long, x double").collect()


def test_report_document(spark):
    rows = spark.createDataFrame([("train", "H"), ("train", "A"), ("test", "D")], "dataset_split string, result string")
    pred = spark.createDataFrame([("D", "H", 0.5, 0.25, 0.25)], "actual string, predicted string, p_h double, p_d double, p_a double")
    d = P.report_document(P.evaluation_report(rows, pred), "dummy", 2025, ["x"], {"features": "f"}, {"type": "prior"})
    assert d["split"] == {"train_row_count": 2, "test_row_count": 1} and d["train_class_counts"] == {"H": 1, "D": 0, "A": 1} and d["test_class_counts"]["D"] == 1
    assert d["confusion_matrix"]["values"] == [[0, 0, 0], [1, 0, 0], [0, 0, 0]] and d["metrics"]["rows"] == 1 and d["metrics"]["accuracy"] == 0.0
