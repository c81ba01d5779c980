"""Every catalogue query over the small tables, against DuckDB where SQL expresses it."""

import math
import os

import duckdb
import pytest

from lodestone.plans import catalogue

DATA = os.environ.get("LODESTONE_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "" if math.isnan(v) else f"{v:.6f}"
    return str(v)


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables aren't here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert bag(got, df.columns) == bag(want.fetchall(), want.columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables aren't here")
def test_companions_are_all_pairs(spark):
    """Every companion by its own key, not their number."""
    found = {tuple(r) for r in catalogue.QUERIES["companion_accounts"](spark, DATA).select("account", "companion").collect()}
    c, s = (spark.read.parquet(f"{DATA}/{t}.parquet").collect() for t in ("customer", "supplier"))
    want = {(a["c_custkey"], b["s_suppkey"]) for a in c for b in s if a["c_mktsegment"] == "BUILDING" and a["c_nationkey"] == b["s_nationkey"] and a["c_custkey"] % 10 == b["s_suppkey"] % 10}
    assert found == want


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() > 0
