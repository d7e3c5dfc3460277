"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import re

import duckdb
import pytest

from tests.conftest import TINY
from tidemark.plans import registry, registry_articles, registry_models, registry_more, registry_provenance, registry_streams, registry_workbooks  # noqa: F401
from tidemark.plans.fixtures import TABLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, TINY)
    cur = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, TINY).count() > 0


def test_names_carry_their_operators():
    assert all(re.match(r"(prj|win|join|flt|agg|fn|stat|ml|ord|set|chk|src|str)_\d\d", n) for n in registry.QUERIES)
