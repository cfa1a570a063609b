"""Every registered query with SQL gives the rows that DuckDB gives; every other one runs."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


def shown(x) -> str:
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "-"
    return repr(float(x)) if isinstance(x, float) else str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"])
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    if name in __spark_entry__.oracle_sql():
        want = duck.sql(__spark_entry__.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
