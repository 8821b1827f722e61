"""Spark result == DuckDB oracle for a representative subset of the registered queries."""

import os
import sys

import duckdb
import pytest

from conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, digest  # noqa: E402

SUBSET = ["clean_transactions", "merchant_dimension", "incremental_load", "full_view", "category_share",
          "kpis", "budget_variance", "transfers_by_code", "code_classification", "quality_ratios",
          "singleton_merchant_count", "null_check", "running_month_spend", "unusual_amounts", "recurring_payments",
          "merchant_groups", "compare_statements", "manual_override"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", SUBSET)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    d_rows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(d_rows)
    assert digest(df.columns, rows) == digest(rel.columns, d_rows)
