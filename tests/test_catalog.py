"""Registered queries against their SQL on the smallest tables (the full comparison is tools/check.py)."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows

SF = "/root/testdata/sf0.001"
QUICK = ["a06_risk_distribution", "a08_daily_series", "c04_travel_speed", "e06_amount_evidence", "f11_account_history", "g04_fan_metrics", "m01_native_features", "s09_validate", "u02_temporal_signal",
         "w07_pass_through", "w08_pass_through_summary", "w12_temporal_features", "x03_cross_bank_alerts"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.collect(), df.columns) == rows(rel.fetchall(), list(rel.columns))


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")
def test_entry(spark):
    df = entry.entry(spark)
    assert {"account", "composite_risk_score", "risk_level"} <= set(df.columns) and df.count() > 0
