"""Registered queries against their SQL on the smallest data. All of them with TAPE_ALL_ORACLES=1."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracles import TABLES, compare
from tapestudy.plans import load_entries

SF = "/root/testdata/sf0.001"
SAMPLE = ["A2_normalize_numeric", "A3_normalize_time", "A5_profile_series", "B9_exclude_event_window", "C3_asof_strict_by", "C3_asof_nearest_later", "C7_pairwise_join", "D14_crosses", "D17_atr", "E8_threshold_curve",
          "E10_outcome_by_year", "E12_volume_gate_curve", "E20_engulfing_filtered", "F1_event_stats", "F2_conditional_next", "F16_correlation_catalog", "F19_return_distribution", "G4_entry_sessions", "G7_overnight_vs_day",
          "G13_horizon_return_from_open", "H1_calendar_features", "H3_days_to_since", "H25_quantile_buckets", "I4_candle_pattern_discovery", "I5_threshold_direction_scan", "I20_pair_outperformance", "I22_score_scan_rows", "J2_pead_signals",
          "J10_price_structures", "J13_latest_per_label", "L2_top_k_per_group", "M1_stream_bars", "M2_stream_scan"]
ORACLE = entry_points.oracle_sql()
NAMES = sorted(ORACLE) if os.environ.get("TAPE_ALL_ORACLES") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry_points.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    problem = compare(df.columns, got, [c[0] for c in cur.description], cur.fetchall())
    assert problem is None, problem


def test_entry_point(spark):
    out = entry_points.entry(spark)
    assert out.columns == ["symbol", "n", "pct_pos_next", "mean_next", "median_next"] and out.count() == 6


def test_registry_is_consistent():
    queries = entry_points.queries()
    assert set(ORACLE) <= set(queries) and len(queries) > 200
    families = {k.split("_")[0] for k in load_entries()}
    expected = {f"{p}{i}" for p, n in (("A", 9), ("B", 14), ("C", 9), ("D", 21), ("E", 21), ("F", 31), ("G", 21), ("H", 25), ("I", 23), ("J", 13), ("K", 6), ("L", 12), ("M", 2)) for i in range(1, n + 1)}
    assert expected == families
