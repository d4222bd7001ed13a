"""Every registered query that has SQL gives the same rows in DuckDB."""

import math
import os

import duckdb
import pytest

from tickspark.plans.oracle import all_sql
from tickspark.plans.oracle_sequences import sequence_sql
from tickspark.plans.oracle_storage import storage_sql
from tickspark.plans.oracle_studies import study_sql
from tickspark.plans.queries import QUERIES

SQL = all_sql() | sequence_sql() | study_sql() | storage_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def same(v):
    return ("nan" if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got and name in ("universe_fingerprint", "meta_label")  # brute force in test_operators.py
        return
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted((tuple(same(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert got == want


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
