"""Every registered query with SQL agrees with it; the entry point works without the optional parts."""

import math

import duckdb
import pytest

import __spark_entry__
from shelfmark.plans import registry, serving  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert columns == sorted(names)
    theirs = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in found.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = registry.filtered_topk(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan and "TakeOrderedAndProject" in plan
