"""Queries over whole tables by brute force, and by SQL on the part of the rows that it covers."""

import duckdb

from tests.conftest import TINY
from tidemark.plans import registry, registry_articles, registry_models, registry_more, registry_provenance, registry_streams  # noqa: F401
from tidemark.plans.fixtures import view

PERCENT_SQL = "SELECT o_orderkey, printf('%.1f %%', 100.0 * (o_orderkey % 1000) / 1000) AS shown FROM orders WHERE o_orderkey % 1000 % 5 = 0"
LINES_SQL = "SELECT doc_id, CAST(i AS INT) AS ordinal, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE i % 2 = 0"


def by_sql(sql, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TINY}/{table}.parquet'")
    return sorted(con.execute(sql).fetchall())


def test_percent_format_of_all_orders(spark):
    got = sorted(map(tuple, registry.QUERIES["fn_33_percent_format"](spark, TINY).collect()))
    keys = [r.o_orderkey for r in view(spark, TINY, "orders").select("o_orderkey").collect()]
    assert got == sorted((k, f"{k % 1000 / 10:.1f} %") for k in keys)
    assert [r for r in got if r[0] % 1000 % 5 == 0] == by_sql(PERCENT_SQL, "orders")


def test_numbered_elements_of_all_lines(spark):
    got = sorted((r.doc_id, r.ordinal, r.line) for r in registry.QUERIES["src_06_numbered_elements"](spark, TINY).collect())
    docs = view(spark, TINY, "documents").select("doc_id", "text").collect()
    assert got == sorted((r.doc_id, i, x) for r in docs if r.text is not None for i, x in enumerate(r.text.split("\n"), 1))
    assert [r for r in got if r[1] % 2 == 0] == by_sql(LINES_SQL, "documents")


def test_normalized_titles_of_all_documents(spark):
    import unicodedata

    plain = lambda t: " ".join(unicodedata.normalize("NFKC", t.split("\n")[0]).casefold().split()) or None
    got = {r.doc_id: r.title for r in registry.QUERIES["fn_03_normalized_titles"](spark, TINY).collect()}
    assert got == {r.doc_id: None if r.text is None else plain(r.text) for r in view(spark, TINY, "documents").collect()}


def test_seeded_sample_of_all_events(spark):
    import random

    ids = sorted(str(r.event_id) for r in view(spark, TINY, "events").select("event_id").collect())
    got = [r.task_id for r in registry.QUERIES["ord_10_seeded_sample"](spark, TINY).orderBy("ordinal").collect()]
    assert got == random.Random(20260101).sample(ids, 100)
