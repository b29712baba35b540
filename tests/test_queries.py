"""Every query with SQL gives what DuckDB gives; the others give rows."""

import math

import duckdb
import pandas as pd
import pytest

from millrace.queries import ORACLES, QUERIES
from millrace.session import release

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "NULL" if v is None or v is pd.NaT else str(v)


def table(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(shown(r[k]) for k in at) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, sql, name):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    release()
    if name not in ORACLES:
        assert got
        return
    found = sql.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, got) == table(columns, found.fetchall())


def test_registry_is_complete():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150
    assert len(QUERIES) - len(ORACLES) <= 3
