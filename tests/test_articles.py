"""Articles from raw JSON to normalized rows, links and checks."""

import datetime as dt
import json

import pytest

from tidemark.operators import articles as A
from pyspark.sql import functions as F

GOOD = {"uri": "7", "lang": "deu", "date": "2025-03-02", "dateTimePub": "2025-03-02T10:00:00Z", "url": "https://www.Paper.de/@me/a?x=1#y", "title": " T ", "body": " text ", "source": {"uri": "paper.de", "title": "Paper"}, "authors": [{"uri": "u", "name": "N", "type": "author", "isAgency": False}]}


def bad(**changes):
    return {k: v for k, v in (GOOD | changes).items() if v != "-"}


CASES = [
    (GOOD, None), (bad(url="-", source="-"), "missing_source_host"), (bad(url="https://spam.de/x"), "policy_exclude"), (bad(url="https://new.de/x"), "policy_unknown_host"), (bad(lang=" "), "missing_language"),
    (bad(lang="eng"), "language_mismatch"), (bad(date="2.3.2025"), "invalid_event_registry_date"), (bad(date="2025-03-09"), "event_registry_date_outside_request_window"), (bad(dateTimePub="2025-03-02T10:00:00"), "invalid_publication_datetime"),
    (bad(dateTimePub="2025-03-03T23:30:00Z"), "publication_datetime_outside_request_window"), (bad(url="-"), "invalid_article_url"), (bad(body=""), "missing_article_body"), (bad(title=3), "invalid_article_title"),
    (bad(source="x"), "invalid_article_source"), (bad(authors=[{"isAgency": "no"}]), "invalid_article_authors"), (bad(authors=[1]), "invalid_article_authors"), (bad(authors="-"), "invalid_article_authors"), (bad(title=None, uri=None, authors=[]), None), (GOOD, None),
]


@pytest.fixture(scope="module")
def judged(spark):
    body = json.dumps({"articles": {"results": [c for c, _ in CASES]}})
    responses = spark.createDataFrame([("r1", "p/r1.json", body), ("r2", "p/r2.json", json.dumps({"articles": {"results": [GOOD]}}))], "request_id string, raw_response_path string, body string")
    requests = spark.createDataFrame([(r, 1, 2025, "l", s, 5, "t", "kind", "concept", "2025-03-01", "2025-03-03", "deu") for r, s in (("r1", "home"), ("r2", "away"))], "request_id string, match_id int, season int, league string, side string, team_id int, team string, request_type string, query_strategy string, date_start string, date_end string, lang string")
    policy = json.dumps({"schema_version": 1, "unknown_hosts": "exclude", "rules": [{"host": "paper.de", "match": "exact_host", "decision": "include"}, {"host": "spam.de", "match": "exact_host", "decision": "exclude"}]})
    doc = spark.createDataFrame([(policy,)], "body string")
    assert A.policy_violations(doc).isEmpty() and A.request_violations(requests).isEmpty()
    assert A.response_violations(responses, ["request_id"]).isEmpty()
    return A.judge(A.occurrences(responses), requests, A.policy_decisions(doc), "Europe/Berlin").cache()


def test_chain_gives_the_first_reason(judged):
    got = [r.reason for r in judged.filter("request_id = 'r1'").orderBy("request_article_index").collect()]
    assert got == [c for _, c in CASES]


def test_articles_and_links(judged):
    got = {r.article_id: r for r in A.articles(judged).collect()}
    first = got["event_registry:7"]
    assert list(first.asDict()) == list(A.ARTICLE) and len(got) == 2
    assert (first.url, first.title, first.body, first.source_host, first.event_registry_date) == ("https://www.paper.de/@me/a?x=1", "T", "text", "paper.de", dt.date(2025, 3, 2))
    assert [a.asDict() for a in first.authors] == [{"uri": "u", "name": "N", "type": "author", "is_agency": False}]
    links = A.links(judged).orderBy("request_id", "article_id").collect()
    assert list(links[0].asDict()) == list(A.LINK)
    assert [(r.request_id, r.article_id[:14], r.request_article_index) for r in links] == [("r1", "event_registry", 1), ("r1", "url_sha256:" + links[1].article_id[11:14], 18), ("r2", "event_registry", 1)]


def test_violations(spark):
    r = spark.createDataFrame([("a", "[]"), ("b", '{"articles":{"results":[1]}}'), ("c", '{"articles":{}}'), ("d", None), ("e", '{"articles":{"results":[]}}')], "k string, body string")
    assert {x.key for x in A.response_violations(r, ["k"]).collect()} == {"a", "b", "c", "d"}
    p = spark.createDataFrame([('{"schema_version":2,"unknown_hosts":"exclude","rules":[{"host":"WWW.a.de","match":"exact_host","decision":"include"},{"host":"b.de","match":"suffix","decision":"x"},{"host":"b.de","match":"exact_host","decision":"include"}]}',)], "body string")
    assert sorted((x.check, x.key) for x in A.policy_violations(p).collect()) == [("policy", ""), ("policy host", "b.de"), ("policy rule", "WWW.a.de"), ("policy rule", "b.de")]
    q = spark.createDataFrame([("x", 1, "home", "2025-01-02", "2025-01-01"), ("y", 1, "away", "2025-01-01", "2025-01-01"), ("z", 2, "left", "2025-01-01", "2025-01-01")], "request_id string, match_id int, side string, date_start string, date_end string")
    assert sorted((x.check, x.key) for x in A.request_violations(q).collect()) == [("request", "x"), ("request", "z"), ("request sides", "2")]
    t = spark.createDataFrame([("H", 1.0, 1), ("X", 9.0, 2), (None, float("nan"), 3)], "target string, v double, id int")
    assert sorted((x.key, x.detail) for x in A.class_violations(t).collect()) == [("", "rule broken"), ("A", "only right"), ("D", "only right"), ("X", "only left")]
    assert sorted(x.key for x in A.range_violations(t, ["id"], {"v": (0, 5)}).collect()) == ["2", "3"]
    assert [x.id for x in A.chosen(t, "target", "H").collect()] == [1]
    with pytest.raises(Exception):
        A.chosen(t, "target", "nobody").collect()
    with pytest.raises(ValueError):
        A.zone("Mars/Base")


def test_small_functions(spark):
    d = spark.createDataFrame([(0, '{"done":true}', " Ａ  b "), (1, '{"done":true,"done_reason":"length"}', " "), (2, '{"done":true,"done_reason":"stop"}', None), (3, "{}", "x")], "i int, x string, t string")
    got = d.select("i", A.completion_ok(F.col("x")).alias("ok"), A.normalized_title(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r.ok for r in got] == [True, False, True, False] and [r.t for r in got] == ["a b", None, None, "x"]
