"""The content queries over all documents against Python's own normalisation, and against SQL on plain ASCII."""

import hashlib
import unicodedata
from collections import Counter, defaultdict

import duckdb
import pytest

from tests.conftest import TINY
from tests.test_oracles import plain
from tidemark.functions import scalars as S
from tidemark.operators import news as N
from tidemark.plans import registry
from tidemark.plans.fixtures import duck, view

CONTENT = "c AS (SELECT 'content_sha256:' || sha256(trim(regexp_replace(lower(text), '[ \\t-\\r\\x1c-\\x1f]+', ' ', 'g'))) AS content_id, min(doc_id) AS representative, count(*) AS members, count(DISTINCT source) AS hosts FROM fx_ascii GROUP BY 1)"
SQL = {
    "agg_06_fn_02_04_contents": f"WITH {CONTENT} SELECT * FROM c",
    "agg_07_flt_13_duplicate_report": f"WITH {CONTENT} SELECT count(*) AS contents, sum(members)::BIGINT AS articles, sum(members - 1)::BIGINT AS collapsed, count(*) FILTER (members > 1) AS groups, coalesce(sum(members) FILTER (members > 1), 0)::BIGINT AS grouped, count(*) FILTER (members > 1 AND hosts > 1) AS cross_source, max(members) AS largest FROM c",
    "agg_07_group_sizes": f"WITH {CONTENT} SELECT members, count(*) AS n FROM c GROUP BY members",
}
TEXTS = ["Straße  ﬁn", "STRASSE fin", "strasse\u00a0ﬁN\n", "A\tB ", "a b", "ａ Ｂ", "é", "e\u0301", "É ", "plain", "İ", "i\u0307", "\u2003", "", " \x1c", None, None, "ς", "σ", "日本", "日本 "]


def expected(rows):
    """The three results from (doc_id, text, source) by brute force."""
    groups = defaultdict(list)
    for d, t, s in rows:
        key = None if t is None else "content_sha256:" + hashlib.sha256(" ".join(unicodedata.normalize("NFKC", t).casefold().split()).encode()).hexdigest()
        groups[key].append((d, s))
    contents = {(k, min(d for d, _ in g), len(g), len({s for _, s in g} - {None})) for k, g in groups.items()}
    many = [c for c in contents if c[2] > 1]
    report = (len(contents), len(rows), len(rows) - len(contents), len(many), sum(c[2] for c in many), sum(c[3] > 1 for c in many), max(c[2] for c in contents))
    return contents, report, dict(Counter(c[2] for c in contents))


def check(spark, d):
    rows = [(r.doc_id, r.text, r.source) for r in view(spark, d, "documents").select("doc_id", "text", "source").collect()]
    contents, report, sizes = expected(rows)
    run = lambda name: registry.QUERIES[name](spark, d).collect()
    assert {(r.content_id, r.representative, r.members, r.hosts) for r in run("agg_06_fn_02_04_contents")} == contents
    assert [(r.contents, r.articles, r.collapsed, r.groups, r.grouped, r.cross_source, r.largest) for r in run("agg_07_flt_13_duplicate_report")] == [report]
    assert {r.members: r.n for r in run("agg_07_group_sizes")} == sizes
    return report


def test_contents_of_all_documents(spark):
    assert check(spark, TINY)[1] == view(spark, TINY, "documents").count()


def test_contents_of_odd_texts(spark, tmp_path):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert check(spark, str(tmp_path))[:2] == (9, len(TEXTS))


@pytest.mark.parametrize("name", sorted(SQL))
def test_contents_match_sql_on_ascii(spark, name):
    groups = N.contents(view(spark, TINY, "fx_ascii"), S.normalized_body(registry.F.col("text")), "doc_id", "source")
    df = {"agg_06_fn_02_04_contents": lambda: groups, "agg_07_flt_13_duplicate_report": lambda: N.duplicate_report(groups), "agg_07_group_sizes": lambda: groups.groupBy("members").agg(registry.F.count("*").alias("n"))}[name]()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{TINY}/documents.parquet'")
    cur = con.execute(duck(SQL[name]))
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in cur.fetchall())
