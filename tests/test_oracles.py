"""Every registered query with oracle SQL, compared on the smallest driver tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, compare

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, db, key):
    df = QUERIES[key](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    result = db.execute(ORACLES[key])
    columns = [d[0] for d in result.description]
    assert compare(df.columns, rows, columns, result.fetchall()) is None


@pytest.mark.parametrize("key", ["summary_json", "run_summary_json", "corr_pvalue", "chi2_pvalue", "correlation_report"])
def test_queries_without_oracle_give_rows(spark, sf_dir, key):
    assert QUERIES[key](spark, sf_dir).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 18 and "macro_f1_present" in df.columns
