"""Every registered query with SQL gives the same rows as that SQL."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from clinloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are missing")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float) and abs(v) < 1e15 and v == int(v):
        v = int(v)
    return repr(v)


def rows(pdf: pd.DataFrame) -> list:
    cols = sorted(pdf.columns)
    return [cols, sorted(tuple(cell(v) for v in r) for r in pdf[cols].itertuples(index=False))]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_others_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).limit(1).count() == 1


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() > 0
