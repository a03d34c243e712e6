"""Every registered query with an SQL text gives the same rows in DuckDB; the others give rows."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from datamill.queries import all_queries, all_sql

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    return str(v)


def table_rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in pdf[columns].astype(object).itertuples(index=False)), key=repr)


#: Minutes of training each; what they are made of is tested on small fixtures.
SLOW = {"text_classifier", "compare_algorithms", "grid_search", "trained_ensemble", "feature_importance", "field_models", "train_and_register"}


@pytest.mark.parametrize("name", sorted(set(all_sql()) - SLOW))
def test_same_as_sql(spark, duck, name):
    got = table_rows(all_queries()[name](spark, FOLDER).toPandas())
    result = duck.execute(all_sql()[name])
    want = table_rows(pd.DataFrame(result.fetchall(), columns=[d[0] for d in result.description]))
    assert got == want
    assert got[1]


@pytest.mark.parametrize("name", ["tagger_uncertainty"])
def test_rows_only(spark, name):
    assert not all_queries()[name](spark, FOLDER).isEmpty()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
