"""Every registered query that has SQL is compared with DuckDB on the smallest data set."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as contract
from check_oracle import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(canonical(r[c]) for c in cols) for r in df.collect())
    rel = db.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(canonical(r[i]) for i in at) for r in rel.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    out = contract.entry(spark)
    assert out.columns == ["identifier", "x", "y", "z", "label", "lang"] and out.count() == 500


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"mds2", "mds_similarity"}))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
