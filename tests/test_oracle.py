"""Registered queries against their SQL counterparts.

A sample runs by default; TIDEGRID_ALL=1 runs every query at TIDEGRID_SF_DIR
(default /root/testdata/sf0.01).
"""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF_DIR = os.environ.get("TIDEGRID_SF_DIR", "/root/testdata/sf0.01")
SAMPLE = ("src5_parallel_arrays", "prj8_within_cycle", "sc5_horizon_check", "ts7_hourly_prices", "ts11_price_hour_slots", "jn6_asof_prefer",
          "jn9_exogenous_frame", "wn5_build_gold", "wn11_downsample_extremes", "wn17_cooldown", "ag6_price_drift", "ag14_regime_performance",
          "ag19_realized_performance", "mrg2_merge_revisions", "mrg5_merge_audit", "tk5_simplest_within", "in2_ingest_audit", "dq12_leakage_audit",
          "dq19_vintage_health", "ml15_seasonal_forecast", "ss1_stream_hourly", "ml6_correlations", "ml7_fold_sums", "snk4_fingerprint",
          "src2_wide_file", "src3_price_documents", "dq10_validate_vintages", "mrg6_should_rebuild", "prj19_drop_sensitive_keys",
          "prj21_history_message", "ag24_max_abs_corr", "ag21_reason_counts")
ORACLES = entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("TIDEGRID_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    line, good = compare(spark, connect(SF_DIR), SF_DIR, name, entry.queries()[name], ORACLES[name])
    assert good, line
