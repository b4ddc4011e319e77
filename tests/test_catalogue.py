import math

import duckdb
import pandas as pd
import pytest

from scoreloom.plans import catalogue, engine_cases

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


QUERIES, ORACLES = {**catalogue.QUERIES, **engine_cases.QUERIES}, {**catalogue.ORACLES, **engine_cases.ORACLES}


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return f"{float(v):.6f}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_assignment_covers_every_row(spark):
    out = catalogue.QUERIES["hungarian_rows"](spark, SF).toPandas()
    assert len(out) == spark.read.parquet(f"{SF}/lineitem.parquet").count() and out.complete.all()
    assert not out.duplicated(["l_orderkey", "true_row"]).any() and not out.duplicated(["l_orderkey", "predicted_row"]).any()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"hungarian_rows"}))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
