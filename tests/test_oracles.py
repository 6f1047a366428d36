"""Each sky query against its SQL on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from starloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SLOW = {"resample_lanczos", "zscale_range"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    q = duck.execute(ORACLES[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=str)


def test_queries_without_sql_run(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, SF).count() > 0


def test_cone_band_reaches_the_scan(spark):
    from starloom.operators.matching import cone_search

    cat = spark.read.parquet(f"{SF}/supplier.parquet").selectExpr("s_suppkey AS id", "s_acctbal AS ra", "s_acctbal AS dec")
    plan = cone_search(cat, 10.0, 5.0, 3600.0, "id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(s_acctbal,4.0)" in plan and "TakeOrderedAndProject" in plan


def test_cross_match_is_an_equi_join(spark):
    from starloom.operators.matching import cross_match

    left = spark.range(10).selectExpr("id AS lid", "id * 1.0D AS ra", "id * 1.0D AS dec")
    plan = cross_match(left, left.withColumnRenamed("lid", "rid"), 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
