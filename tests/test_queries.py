"""Every query of the catalogue against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from keystrata import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else v if v is None else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(rows, key=str) == sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["segment", "n", "revenue"]
    assert set(queries.oracle_sql()) == set(queries.queries()) and set(queries.queries()) <= set(__spark_entry__.queries())
