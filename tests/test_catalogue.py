"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from setwise.operators import algebra
from setwise.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, oracle, name):
    df = catalogue.queries()[name](spark, SF)
    want = oracle.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_pairs_of_many_sets(spark):
    sets = spark.range(1200).selectExpr("lpad(id, 5, '0') AS set_id", "id DIV 2 AS v")
    got = algebra.consecutive_pairs(sets).orderBy("a").collect()
    assert [r["and_card"] for r in got] == [1, 0] * 599 + [1] and (got[0]["a"], got[0]["b"]) == ("00000", "00001")
