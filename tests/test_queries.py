"""Each query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lookback.plans import arms, cases, evaluation, index, instruments, judgments, lineage, measures, queries, review  # noqa: F401
from lookback.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Queries over texts meet letters in the larger table that the smaller one lacks.
LARGER, OF_TEXTS = "/root/testdata/sf0.01", ("near_identical_titles", "normalized_urls", "similar_documents", "states_rebuilt", "prefilter_orders")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("the shared tables aren't here")
    return connect(SF)


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return "null"
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if float(v).is_integer() else repr(round(float(v), 6))
    return str(v).replace(" 00:00:00", "") if isinstance(v, pd.Timestamp) else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", OF_TEXTS)
def test_queries_over_texts_on_the_larger_table(spark, name):
    if not os.path.isdir(LARGER):
        pytest.skip("the shared tables aren't here")
    assert rows(QUERIES[name](spark, LARGER).toPandas()) == rows(connect(LARGER).execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_have_rows(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("the shared tables aren't here")
    assert QUERIES[name](spark, SF).count() > 0
