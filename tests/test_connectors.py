"""Data sources for services, the bounded window and the lease: commits, retries, aborts, pushdown, fencing."""

import json
import os
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY
from tidemark.plans.fixtures import view
from tidemark.sources import connectors as K
from tidemark.sources import store
from tidemark.sources.services import Reply


def counted(folder, body=None, fail=None):
    """A transport that notes every post in a folder; ``fail(payload, posts of it before)`` may raise or give a reply."""

    def post(payload):
        seen = sum(n.startswith(store.file_name(payload) + "@") for n in os.listdir(folder))
        open(f"{folder}/{store.file_name(payload)}@{seen}", "w").close()
        if fail and (reply := fail(payload, seen)):
            return reply
        return Reply(200, json.dumps({"articles": {"results": [1] * (len(payload) % 4)}}))

    return post


def posts(folder):
    return Counter(n.split("@")[0] for n in os.listdir(folder))


def requests_of(spark, n=40, parts=4):
    return view(spark, TINY, "pages").orderBy("page_id").limit(n).select(F.concat(F.lit("r/"), "page_id").alias("request_id"), F.col("page_id").cast("string").alias("payload")).repartition(parts)


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "posts").mkdir()
    return str(tmp_path / "out"), str(tmp_path / "posts")


def test_fetch_commits_once_and_resumes(spark, folders):
    out, seen = folders
    requests = requests_of(spark)
    K.post_all(requests.filter("payload < '2'"), out, K.response_sink(counted(seen)))
    first = K.committed_log(spark, out).count()
    K.post_all(requests, out, K.response_sink(counted(seen)))
    K.post_all(requests, out, K.response_sink(counted(seen)))
    log = K.committed_log(spark, out).collect()
    assert 0 < first < 40 == len(log) == len({r.request_id for r in log})
    assert posts(seen) == Counter({r.payload: 1 for r in requests.collect()})
    assert all(r.article_count == len(r.request_id[2:]) % 4 and K.article_count(store.read_bytes(r.raw_path).decode()) == r.article_count for r in log)
    assert len(store.listed(f"{out}/commits")) == 3


def test_aborted_run_leaves_no_log_and_pays_once(spark, folders):
    """One request is refused: the run fails, nothing of it counts, and the next run posts only what is missing."""
    out, seen = folders
    requests = requests_of(spark, parts=1)
    bad = sorted(r.payload for r in requests.collect())[20]
    with pytest.raises(Exception, match="status 500"):
        K.post_all(requests, out, K.response_sink(counted(seen, fail=lambda p, n: Reply(500, "no") if p == bad else None)), tasks=1)
    assert K.committed_log(spark, out).count() == 0 and store.listed(f"{out}/parts") == [] and store.listed(f"{out}/commits") == []
    K.post_all(requests, out, K.response_sink(counted(seen)))
    assert K.committed_log(spark, out).select("request_id").distinct().count() == K.committed_log(spark, out).count() == 40
    assert posts(seen) == Counter({r.payload: 1 + (r.payload == bad) for r in requests.collect()})


def test_second_attempt_of_a_task_posts_only_the_rest(folders):
    """The writer itself, attempt by attempt: the first one dies in the middle, the second lists all and posts the rest."""
    out, seen = folders
    rows = [{"request_id": f"r{i}", "payload": f"p{i}"} for i in range(6)]

    class Dead(Exception):
        pass

    def fail(payload, before):
        if payload == "p3" and not before:
            raise Dead

    source = K.response_sink(counted(seen, fail=fail))({"path": out})
    writer = source.writer(None, False)
    K.TaskContext = type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))})
    try:
        with pytest.raises(Dead):
            writer.write(iter(rows))
        message = writer.write(iter(rows))
    finally:
        from pyspark import TaskContext

        K.TaskContext = TaskContext
    assert message.fetched == 6 and posts(seen) == Counter({f"p{i}": 1 + (i == 3) for i in range(6)})
    writer.commit([message, None])
    marker = json.loads(store.read_bytes(f"{out}/commits/{store.listed(f'{out}/commits')[0]}"))
    assert marker["parts"] == store.listed(f"{out}/parts") and marker["fetched"] == 6


def test_rate_limit_waits_and_invalid_replies_end_the_run(spark, folders):
    out, seen = folders
    few = requests_of(spark, 3, 1)
    K.post_all(few, out, K.response_sink(counted(seen, fail=lambda p, n: Reply(429, "") if n < 2 else None), wait=0.0))
    assert set(posts(seen).values()) == {3} and K.committed_log(spark, out).count() == 3
    with pytest.raises(Exception, match="status 200"):
        K.post_all(few.withColumn("request_id", F.lit("new")), out, K.response_sink(lambda p: Reply(200, '{"articles": {}}')))
    with pytest.raises(Exception, match="status 429"):
        K.post_all(few.withColumn("request_id", F.lit("new")), out, K.response_sink(lambda p: Reply(429, ""), wait=0.0))


def test_lease_lets_one_writer_in_and_fences_the_other(spark, folders):
    out, seen = folders
    now = [1000.0]
    first = store.Lease.acquire(spark, out, "one", 60, lambda: now[0])
    with pytest.raises(store.LeaseHeld, match="one"):
        store.Lease.acquire(spark, out, "two", 60, lambda: now[0])
    now[0] += 50
    first.renew()
    now[0] += 50
    with pytest.raises(store.LeaseHeld):
        store.Lease.acquire(spark, out, "two", 60, lambda: now[0])
    now[0] += 11
    second = store.Lease.acquire(spark, out, "two", 60, lambda: now[0])
    assert second.number == first.number + 1
    with pytest.raises(store.Fenced):
        first.renew()
    few = requests_of(spark, 4, 2)
    with pytest.raises(Exception, match="taken over"):
        K.post_all(few, out, K.response_sink(counted(seen)), first)
    assert K.committed_log(spark, out).count() == 0 and store.listed(f"{out}/parts") == []
    with second:
        K.post_all(few.withColumn("request_id", F.concat("request_id", F.lit("x"))), out, K.response_sink(counted(seen)), second)
    assert K.committed_log(spark, out).count() == 4
    assert store.Lease.acquire(spark, out, "three", 60, lambda: now[0]).number == 3


def test_of_many_takers_one_gets_the_lease(spark, tmp_path):
    out, got = str(tmp_path / "o"), []

    def take(i):
        try:
            got.append(store.Lease.acquire(spark, out, str(i)))
        except store.LeaseHeld:
            pass

    threads = [threading.Thread(target=take, args=(i,)) for i in range(16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(got) == 1 and store.highest(out) == 1


def test_match_service_equals_the_table_served(spark, tmp_path):
    """One fetch for each season asked for; filters on league and season decide which."""
    folder = tmp_path / "gets"
    folder.mkdir()
    matches = view(spark, TINY, "fx_match").select(F.concat(F.lit("l"), "league").alias("league"), F.col("season").cast("int").alias("season"), "match_id", "home_goals", "matchday")
    served = {}
    for r in matches.collect():
        served.setdefault((r.league, r.season), []).append({"match_id": r.match_id, "home_goals": r.home_goals, "matchday": r.matchday})

    def get(league, season):
        open(f"{folder}/{league}-{season}", "a").write("x")
        return json.dumps(served[league, season])

    source = K.match_service(get, sorted(served), "match_id long, home_goals long, matchday long")
    out = K.read_matches(spark, source)
    assert Counter(map(tuple, out.select(*matches.columns).collect())) == Counter(map(tuple, matches.collect()))
    [p.unlink() for p in folder.iterdir()]
    some = sorted(served)[0][0]
    assert out.filter((F.col("league") == some) & (F.col("home_goals") >= 0)).count() == matches.filter(F.col("league") == some).count()
    assert {p.name.split("-")[0] for p in folder.iterdir()} == {some}
    assert out.filter("league IN ('l0', 'none') AND season = 1999").count() == 0
    with pytest.raises(Exception, match="not a list"):
        K.read_matches(spark, K.match_service(lambda a, b: "{}", [("l", 1)], "match_id long")).collect()


def test_window_is_bounded_and_keeps_what_is_done():
    lock, state = threading.Lock(), {"open": 0, "most": 0, "drawn": 0}

    def call(i):
        with lock:
            state["open"] += 1
            state["most"] = max(state["most"], state["open"])
        time.sleep(0.03 if i == 0 else 0.002)
        with lock:
            state["open"] -= 1
        if i % 7 == 3:
            raise ValueError(i)
        return i * i

    def items():
        for i in range(50):
            assert state["drawn"] - 50 <= 0
            state["drawn"] += 1
            yield i

    got = list(K.in_flight(items(), call, 4))
    assert state["most"] <= 4 and sorted(i for i, _, _ in got) == list(range(50)) and got[0][0] != 0
    assert all((r == i * i) if e is None else (i % 7 == 3 and isinstance(e, ValueError)) for i, r, e in got)

    def broken():
        yield from range(5)
        raise OSError("no more")

    seen = []
    with pytest.raises(OSError):
        for g in K.in_flight(broken(), lambda i: i, 3):
            seen.append(g[0])
    assert sorted(seen) == list(range(5))


def test_calls_in_flight_equal_calls_one_by_one(spark):
    docs = view(spark, TINY, "documents").select("doc_id", "text").repartition(3)

    def call(text):
        if len(text) % 5 == 0:
            raise ValueError("five")
        return str(len(text))

    got = {r.doc_id: (r.answer, r.error) for r in K.call_in_flight(docs.filter("text IS NOT NULL"), "doc_id", "text", call, 6, 7).collect()}
    assert got == {r.doc_id: (None, "ValueError: five") if len(r.text) % 5 == 0 else (str(len(r.text)), None) for r in docs.collect() if r.text is not None}
