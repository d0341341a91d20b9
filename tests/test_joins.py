import numpy as np
import pandas as pd
import pytest
from frames import silver_pandas, table, values
from pyspark.sql import functions as F

from tidegrid import DataContractError
from tidegrid.operators import features, joins as ops
from tidegrid.operators.quality import leakage_audit
from tidegrid.operators.series import accepted, hourly_vintages, reject_counts
from tidegrid.operators.stats import reason_counts


def random_vintages(n=600):
    rng = np.random.default_rng(11)
    cycle = pd.Timestamp("2026-10-15") + pd.to_timedelta(rng.integers(0, 40, n), unit="h")
    return pd.DataFrame({
        "series_id": "one", "technology": np.where(rng.random(n) < 0.6, "SOLAR", "WIND_ONSHORE"),
        "process_type": rng.choice(["A40", "A01"], n), "document_id": [f"d{i % 50}" for i in range(n)],
        "revision_number": rng.choice(["1", "2", "10", "x"], n), "source_created_at_utc": cycle - pd.Timedelta(minutes=20),
        "effective_issue_time": cycle, "acquired_at_utc": cycle + pd.to_timedelta(rng.integers(0, 59, n), unit="m"),
        "target_timestamp": cycle + pd.to_timedelta(rng.integers(1, 60, n), unit="h"), "value_mw": rng.normal(0, 1, n).round(6)})


def brute(pdf, issue, target, technology, prefer=False):
    c = pdf[(pdf.technology == technology) & (pdf.target_timestamp == target) & (pdf.effective_issue_time <= issue)].copy()
    if c.empty:
        return None
    c["rank"] = pd.to_numeric(c.revision_number, errors="coerce").fillna(-1)
    c["p"] = (c.process_type == "A40").astype(int) if prefer else 0
    return c.sort_values(["p", "effective_issue_time", "source_created_at_utc", "rank", "acquired_at_utc", "document_id", "value_mw"]).iloc[-1].value_mw


@pytest.mark.parametrize("prefer", [False, True])
def test_asof_selection_equals_brute_force(spark, prefer):
    pdf = random_vintages()
    cycles = spark.createDataFrame([("one", t) for t in pd.date_range("2026-10-15", periods=45, freq="h").to_pydatetime()], "series_id string, issue timestamp")
    asked = ops.request_grid(cycles).withColumn("technology", F.explode(F.array(F.lit("SOLAR"), F.lit("WIND_ONSHORE"))))
    choose = ops.asof_prefer if prefer else ops.asof_latest
    out = choose(asked, spark.createDataFrame(pdf), ["series_id", "technology"], ops.vintage_order(["value_mw"]), ["value_mw"]).toPandas()
    assert len(out) == 45 * 24 * 2
    for row in out.itertuples():
        want = brute(pdf, row.issue, row.target_ts, row.technology, prefer)
        assert (want is None and pd.isna(row.value_mw)) or row.value_mw == want


VINTAGE = ("series_id string, source string, document_type string, process_type string, document_id string, revision_number string, "
           "source_created_at_utc timestamp, collection_issue_time timestamp, acquired_at_utc timestamp, target_timestamp timestamp, "
           "resolution string, technology string, value_mw double")
KINDS = {"TOTAL_LOAD": ("A65", "A01"), "TOTAL_GENERATION": ("A71", "A01"), "SOLAR": ("A69", "A40"), "WIND_OFFSHORE": ("A69", "A01"), "WIND_ONSHORE": ("A69", "A01")}


def vintages(spark, issue="2026-10-15 12:00:00", document="d1", revision="1", base=0.0, only=None, legacy=False):
    at = pd.Timestamp(issue)
    rows = []
    for technology, (document_type, process) in KINDS.items():
        if only and technology not in only:
            continue
        for h in range(1, 25):
            for q in range(4):
                rows.append(("one", "S", document_type, process, document, revision, str(at - pd.Timedelta(minutes=20)), None if legacy else str(at),
                             str(at + pd.Timedelta(minutes=5)), str(at + pd.Timedelta(hours=h, minutes=15 * q)), "PT15M", technology, base + 10 * h + 10 * q))
    return table(spark, VINTAGE, rows)


def weather(spark, issue="2026-10-15 12:00:00"):
    at = pd.Timestamp(issue)
    rows = [("one", str(at), str(at + pd.Timedelta(minutes=5)), str(at + pd.Timedelta(hours=h)), 10.0 + h, "P", "m") for h in range(1, 25)]
    return table(spark, "series_id string, collection_issue_time timestamp, acquired_at_utc timestamp, target_timestamp timestamp, temperature_2m double, provider string, model string", rows)


def exogenous(spark, raw, sky, issue="2026-10-15 12:00:00"):
    start = str(pd.Timestamp(issue) - pd.Timedelta(hours=200))
    silver = spark.createDataFrame(silver_pandas(225, start))
    hourly = accepted(hourly_vintages(ops.within_cycle(raw)))
    cycles = ops.distinct_cycles([hourly.withColumnRenamed("effective_issue_time", "c"), sky.withColumnRenamed("collection_issue_time", "c")], "c", ["series_id"])
    prices = silver.select("series_id", "ts", F.col("price_eur_mwh").alias("price"))
    return ops.build_exogenous(cycles, features.issue_features(silver), prices, raw, sky, ["temperature_2m"])


def test_exogenous_frame_is_complete_and_passes_its_audit(spark):
    frame = exogenous(spark, vintages(spark), weather(spark))
    rows = ops.complete_rows(frame)
    assert rows.count() == 24
    first = rows.orderBy("horizon").first()
    assert first["forecast_load_mw"] == 10 + 15 and first["solar_forecast_process_type"] == "A40" and first["target_hour"] == 13
    sources = ["load_forecast", "generation_forecast", "solar_forecast", "wind_offshore_forecast", "wind_onshore_forecast", "weather_forecast"]
    assert {r["status"] for r in leakage_audit(rows, sources, ["forecast_load_mw", "forecast_temperature_2m"]).collect()} == {"PASSED"}


def test_newest_revision_wins_and_later_cycles_are_invisible(spark):
    raw = vintages(spark).unionByName(vintages(spark, document="d2", revision="2", base=1000.0)).unionByName(
        vintages(spark, issue="2026-10-15 13:00:00", document="d3", revision="9", base=5000.0))
    rows = ops.complete_rows(exogenous(spark, raw, weather(spark)))
    assert {str(t[0]) for t in values(rows, "issue")} == {"2026-10-15 12:00:00"}
    assert rows.agg(F.min("forecast_load_mw")).first()[0] == 1025.0 and rows.agg(F.max("forecast_load_mw")).first()[0] < 5000


def test_missing_parts_are_counted(spark):
    frame = exogenous(spark, vintages(spark, only={"TOTAL_LOAD", "SOLAR"}, legacy=True), weather(spark))
    counts = {r["reason"]: r["rows"] for r in reason_counts(frame).collect()}
    assert counts == {"missing_generation_forecast": 24, "missing_wind_offshore_forecast": 24, "missing_wind_onshore_forecast": 24}


def test_incomplete_quarters_are_rejected_per_vintage(spark):
    raw = vintages(spark).filter("NOT (technology = 'SOLAR' AND minute(target_timestamp) = 45 AND hour(target_timestamp) = 14)")
    hourly = hourly_vintages(ops.within_cycle(raw))
    assert values(reject_counts(hourly), "reject_reason", "rejected") == [("incomplete_pt15m_hour", 1)]


def test_scoring_needs_issuance_before_the_target(spark):
    columns = "series_id string, model_release string, forecast_issue_time timestamp, horizon_hours int, target_timestamp timestamp, predicted_price_eur_mwh double, issued_at_utc timestamp"
    rows = [("one", "m", "2026-01-01 00:00:00", h, f"2026-01-01 {h:02d}:00:00", 10.0 * h, f"2026-01-01 0{i}:00:00") for h, i in ((1, 1), (2, 1), (3, 1))]
    history = table(spark, columns, rows)
    actual = table(spark, "series_id string, target_timestamp timestamp, price_eur_mwh double", [("one", f"2026-01-01 0{h}:00:00", 15.0) for h in (1, 2, 3)])
    out = ops.match_realized(history, actual, "2026-01-01 03:30:00", check=True)
    assert values(out, "horizon_hours", "signed_error") == [(2, 5.0)]
    with pytest.raises(DataContractError):
        ops.match_realized(history.unionByName(history), actual, "2026-01-01 03:30:00", check=True)


def test_overlapping_periods_against_any_earlier_one(spark):
    rows = [("k", "a", "2026-01-01", "2026-06-01"), ("k", "b", "2026-02-01", "2026-02-02"), ("k", "c", "2026-05-01", "2026-05-03"), ("k", "d", "2026-06-01", "2026-06-02")]
    df = table(spark, "key string, period_id string, start_ts timestamp, end_ts timestamp", rows)
    for width in (86400, 10**9):
        assert [r[0] for r in values(ops.overlapping_periods(df, ["key"], width_s=width), "period_id")] == ["b", "c"]
