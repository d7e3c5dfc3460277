"""Edge cases of functions, sources, logs and checks on hand-made rows."""

import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import checks as C
from tidemark.operators import evaluation as E
from tidemark.operators import matches as M
from tidemark.operators import news as N
from tidemark.operators import raw as R
from tidemark.operators import selection
from tidemark.sources import files, services
from tidemark.streaming import logs


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_urls(spark):
    urls = ["HTTPS://WWW.Example.com:443/a?b=1#c", "http://example.com:8080", "http://user@x.de/", "ftp://x.de/", " https://x.de./p ", "example.com/x", None, "", "https://"]
    assert values(spark, urls, S.canonical_url) == ["https://www.example.com/a?b=1", "http://example.com:8080/", None, None, "https://x.de/p", None, None, None, None]
    assert values(spark, urls, S.homepage) == ["https://example.com", "https://example.com", "https://x.de", None, "https://x.de", "https://example.com", None, None, None]
    assert values(spark, ["see https://a.de/x). and https://a.de/x, http://b.de"], S.evidence_urls) == [["https://a.de/x", "http://b.de"]]


def test_text_and_dates(spark):
    assert values(spark, ["  a ", "\u001c", None, "x y"], S.optional_text) == ["a", None, None, "x y"]
    assert values(spark, ["Straße  ﬁn", "A\tB ", None], S.normalized_body) == ["strasse fin", "a b", None]
    assert [str(v) if v else None for v in values(spark, ["2025-08-02", "2025-8-2", "x", "2025-02-30"], S.iso_date)] == ["2025-08-02", None, None, None]
    assert [v is not None for v in values(spark, ["2025-08-01T10:00:00Z", "2025-08-01T10:00:00", "2025-08-01T10:00:00+02:00"], S.iso_timestamp)] == [True, False, True]
    assert [str(v) for v in values(spark, ["45901", "2025-09-01", "0x"], S.review_date)] == ["2025-09-01", "2025-09-01", "None"]
    assert values(spark, ["3", " 4.0", "-1", "x", "0"], lambda c: S.whole_number(c, True)) == [3, 4, None, None, None]
    assert [len(x) for x in values(spark, ["a" * 10, "🎉" * 6], lambda c: S.utf16_chunks(c, 5))] == [2, 3]


def test_raw_matches(spark, tmp_path):
    rows = [
        {"matchID": 1, "matchDateTimeUTC": "2025-08-22T18:30:00Z", "matchIsFinished": True, "group": {"groupOrderID": 1}, "team1": {"teamId": 1, "teamName": "A"}, "team2": {"teamId": 2, "teamName": "B"}, "matchResults": [{"resultTypeID": 1, "pointsTeam1": 0, "pointsTeam2": 0}, {"resultTypeID": 2, "pointsTeam1": 2, "pointsTeam2": 1}]},
        {"matchID": 2, "matchDateTime": "2025-12-22T18:30:00", "matchIsFinished": True, "team1": {"teamId": 2, "teamName": "B"}, "team2": {"teamId": 1, "teamName": "A"}, "matchResults": [{"resultName": "Endergebnis", "pointsTeam1": 1, "pointsTeam2": 1}]},
        {"matchID": 3, "matchDateTimeUTC": "2025-08-23T18:30:00Z", "matchIsFinished": False, "team1": {"teamId": 1}, "team2": {"teamId": 3}, "matchResults": [{"resultTypeID": 2, "pointsTeam1": 9, "pointsTeam2": 9}]},
    ]
    (tmp_path / "m.json").write_text(json.dumps(rows))
    got = {r.match_id: r for r in R.normalize_matches(files.read_json_array(spark, str(tmp_path / "m.json"), R.RAW_MATCH), "bl1", 2025).collect()}
    assert (got[1].kickoff, got[2].kickoff) == ("2025-08-22T20:30:00+02:00", "2025-12-22T18:30:00+01:00")
    assert (got[1].result, got[2].result, got[3].result) == ("HOME_WIN", "DRAW", None)
    assert got[1].window_days == 5 and got[3].window_start is None and got[3].window_days == 0


def test_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿ Date ,Home\r\n01/08/2025,X\r\n,\r\n".encode())
    assert [tuple(r) for r in files.read_csv(spark, str(p), ("Date",)).collect()] == [("01/08/2025", "X")]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(p), ("Away",))
    assert files.is_utf8(spark, str(p))
    (tmp_path / "l.jsonl").write_text('﻿{"a":1}\n\n{"a":2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int").count() == 2
    (tmp_path / "bad.jsonl").write_text("[1]\n{\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    df = spark.createDataFrame([(1, None)], "a int, b string")
    files.write_jsonl(df, str(tmp_path / "o"))
    assert '"b":null' in "".join(x.read_text() for x in (tmp_path / "o").glob("part*"))
    assert json.loads(files.document(df)) == {"a": 1, "b": None}
    with pytest.raises(ValueError):
        files.write_csv(df, str(tmp_path / "c"), ["a"])
    assert files.Layout("/r", 2025).path("raw", "x") == "/r/raw/season=2025/x"


def test_log_resumes_and_streams(spark, tmp_path):
    tasks = spark.createDataFrame([(i, f"b{i}") for i in range(6)], "task_id long, body string")
    log, schema = str(tmp_path / "log"), "task_id long, n long"
    f = lambda b: pd.DataFrame({"task_id": b["task_id"], "n": b["body"].str.len()})
    assert logs.run_pending(tasks.filter("task_id < 3"), log, "task_id", f, schema) == 3
    assert logs.run_pending(tasks, log, "task_id", f, schema) == 6
    assert logs.run_pending(tasks, log, "task_id", f, schema) == 6
    src = str(tmp_path / "in")
    tasks.write.parquet(src)
    q = logs.stream_log(spark.readStream.schema(tasks.schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "ck"), "task_id")
    q.awaitTermination()
    tasks.write.mode("append").parquet(src)
    q = logs.stream_log(spark.readStream.schema(tasks.schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "ck"), "task_id")
    q.awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 6


def test_rolling_stream_equals_windows(spark, tmp_path):
    rows = [(t * 100 + i, t, f"2025-08-{i + 1:02d} 12:00:00", (i * t) % 4) for t in (1, 2) for i in range(9)]
    df = spark.createDataFrame(rows, "match_id long, team_id long, kickoff string, points long").withColumn("kickoff", F.to_timestamp("kickoff"))
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    q = logs.rolling_points(spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))).writeStream.format("memory").queryName("rolling").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.match_id: r.form_points for r in spark.table("rolling").collect()}
    assert got == {m: sum(p for mm, tt, _, p in rows if tt == t and m - 5 <= mm < m) for m, t, _, _ in rows}


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, " ", float("nan")), (2, None, -1.0)], "k int, s string, v double")
    assert C.unique(df, ["k"]).count() == 1 and C.not_empty(df).count() == 0 and C.not_empty(df.limit(0)).count() == 1
    assert C.required(df, {"s": "text", "v": "finite"}, ["k"]).count() == 3
    assert C.exact_columns(df, ["k", "v", "s"]).count() == 1
    with pytest.raises(C.CheckFailed):
        C.enforce(C.unique(df, ["k"]))
    C.enforce(C.unique(df, ["k", "s"]))


def test_published_figures(spark):
    """Metrics that the reference publishes: the prior's loss and the exact tests' p-values."""
    train = spark.createDataFrame([(y,) for y, n in (("H", 110), ("D", 59), ("A", 74)) for _ in range(n)], "result string")
    test = spark.createDataFrame([(i, y) for i, y in enumerate("H" * 24 + "D" * 16 + "A" * 23)], "match_id long, result string")
    p = E.prior_predictions(train, test).withColumn("actual", F.col("result")).withColumn("mdl", F.lit(0))
    m = E.metrics(p, ["mdl"]).first()
    assert [round(x, 6) for x in (m.log_loss, m.accuracy, m.macro_f1, m.brier)] == [1.095512, 0.380952, 0.183908, 0.666028]
    pairs = spark.createDataFrame([(1, True, False)] * 3 + [(1, False, True)] * 10 + [(2, True, False)] * 3 + [(2, False, True)] * 2, "g int, base_correct boolean, cand_correct boolean")
    assert [round(r.p_value, 6) for r in E.mcnemar(pairs, ["g"]).orderBy("g").collect()] == [0.092285, 1.0]


def test_logistic_is_stationary(spark):
    import random

    r = random.Random(3)
    rows = [(i, ("H", "D", "A")[i % 3], r.gauss(i % 3, 1), r.gauss(0, 1)) for i in range(150)]
    df = spark.createDataFrame(rows, "match_id long, result string, u double, v double")
    model, out = E.logistic(df, df, ["u", "v"], c=0.5)
    p = out.orderBy("match_id").collect()
    x = E.standardize(df, F.lit(True), ["u", "v"]).orderBy("match_id").collect()
    for k, y in enumerate(E.LABELS):
        for j, c in enumerate(("u", "v")):
            g = 0.5 * sum((a[E.PROBS[k]] - (a.result == y)) * b[c] for a, b in zip(p, x)) + model.coefficientMatrix.toArray()[k, j]
            assert math.isclose(g, 0.0, abs_tol=1e-4)
    with pytest.raises(ValueError):
        selection.select_features(["a"], ["a", "a"])


def test_selection_ranks_simple_models_first(spark):
    import random

    r = random.Random(4)
    rows = [(d * 10 + i, d, ("H", "D", "A")[i % 3], r.gauss(i % 3, 1), r.gauss(0, 1)) for d in range(1, 10) for i in range(9)]
    df = spark.createDataFrame(rows, "match_id long, matchday int, result string, u double, v double").withColumn("kickoff", F.timestamp_seconds(F.col("matchday") * 604800))
    ranked, pred = selection.select(df, [(3, 4, 5), (5, 6, 7)], {"one": ["u"], "two": ["u", "v"]}, [0.1])
    got = ranked.orderBy("selection_rank").collect()
    assert len(got) == 2 and got[0].feature_count == 1 and pred.count() == 3 * 36
    with pytest.raises(selection.FrozenConfigurationChanged):
        selection.final_model(df, df, ranked, ["u", "v"], 0.1, "two")


def test_services(spark):
    assert services.season_code(2099) == "9900" and services.stats_url("b", 2025).endswith("/2526/D1.csv")
    assert services.api_key({}, "export K='v'\n", "K") == "v"
    calls = {"n": 0}

    bodies = ['{"articles":{"results":[]}}', '{"articles":{"results":[{"a":1}]}}', "[]", '{"articles":{}}', "x", None]
    assert values(spark, bodies, services.valid_response) == [True, True, False, False, False, False]
    req = spark.createDataFrame([("r1", "p1"), ("r2", "p2")], "request_id string, payload string")
    done = spark.createDataFrame([("r1", bodies[0])], "request_id string, body string")

    def post(payload):
        calls["n"] += 1
        return services.Reply(429 if calls["n"] < 3 else 200, "{}")

    got = services.fetch(req, done, post, sleep=lambda s: None).collect()
    assert [(r.request_id, r.status, r.attempts) for r in got] == [("r2", 200, 3)]
    answers = iter(["{", '{"a":{"rating":"pos","evidence":["x"]}}'])
    out = services.annotator(lambda prompt: next(answers), ("a",), ("pos", "not_mentioned"))(pd.DataFrame({"task_id": [1], "body": ["t"]}))
    assert out["attempts"].tolist() == [2] and out["error"].tolist() == [None]
    ok = values(spark, ['{"a":{"rating":"pos","evidence":["x"]}}', '{"a":{"rating":"pos","evidence":[]}}', '{"b":1}', None], lambda c: services.response_ok(c, ("a",), ("pos", "not_mentioned")))
    assert ok == [True, False, False, False]


def test_canonical_url_refuses_user_info_only(spark):
    urls = ["https://medium.com/@user/post", "https://u@medium.com/x", "https://u:p@medium.com/x", "https://a.de?x=@1", "https://a.de:443/@?q#@"]
    assert values(spark, urls, S.canonical_url) == ["https://medium.com/@user/post", None, None, "https://a.de/?x=@1", "https://a.de/@?q"]


def test_stratified_sample_never_passes_over_a_better_row(spark):
    """Replays the sample: quotas add up, and at no pick does its day hold a free row whose values were used less."""
    import hashlib
    from collections import Counter

    cols = ("task_id", "matchday", "team_id", "content_id", "side", "source_host", "bin")
    rows = [dict(zip(cols, (i, i % 7, i % 5, f"c{i % 11}", ("home", "away")[i % 2], f"h{i % 3}", i % 4))) for i in range(90)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "task_id long, matchday int, team_id int, content_id string, side string, source_host string, bin int")
    hashes = [hashlib.sha256(f"42:{i}".encode()).hexdigest() for i in range(90)]
    for size, quota in ((17, [3, 3, 3, 2, 2, 2, 2]), (3, [1, 0, 0, 1, 0, 0, 1]), (1, [1, 0, 0, 0, 0, 0, 0])):
        got = [r.task_id for r in N.stratified_sample(df, size, 42).orderBy("position").collect()]
        assert [Counter(rows[i]["matchday"] for i in got)[d] for d in range(7)] == quota
        used, free = Counter(), set(range(90))
        rank = lambda i: [used[c, rows[i][c]] for c in N.BALANCED] + [hashes[i]]  # noqa: E731, B023
        for i in got:
            assert not [j for j in free if rows[j]["matchday"] == rows[i]["matchday"] and rank(j) < rank(i)]
            free.remove(i)
            used.update((c, rows[i][c]) for c in N.BALANCED)
        assert sorted(rows[i]["matchday"] for i in got[: sum(map(bool, quota))]) == [rows[i]["matchday"] for i in got[: sum(map(bool, quota))]]
    everything = N.stratified_sample(df, 200).orderBy("position").collect()
    assert [(r.task_id, r.position) for r in everything] == [(i, i) for i in range(90)]


def test_split_label_refuses_unknown_days(spark):
    with pytest.raises(Exception):
        spark.createDataFrame([(99,)], "d int").select(M.split_label(F.col("d"), 14, 18)).collect()
