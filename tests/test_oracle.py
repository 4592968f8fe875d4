"""Every registered query with an SQL form equals its DuckDB oracle (sf0.001)."""
import duckdb
import pytest

import __spark_entry__ as E
from sparkaudit.plans.views import BASE_TABLES

from scripts_check import rows_key  # noqa: F401  (helper lives next to the tests)

SLOW: set[str] = set()


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - SLOW))
def test_query_matches_oracle(spark, duck, sf_small, name):
    df = E.queries()[name](spark, sf_small)
    s_rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    d_rows = cur.fetchall()
    d_cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert rows_key(df.columns, s_rows) == rows_key(d_cols, d_rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["run_id", "rank", "id", "ord", "entry_file", "sink_name", "sink_type", "score", "detail"]
