import pytest
from frames import table, values

from tidegrid import DataContractError
from tidegrid.functions.times import HOUR, QUARTER
from tidegrid.operators import series as ops

POINTS = "period_id string, curve_type string, period_start timestamp, period_end timestamp, resolution string, position int, value double"
DAY = ("2026-10-24 22:00:00", "2026-10-25 22:00:00", "PT15M")


def test_93_blocks_cover_96_quarters(spark):
    rows = [("p", "A03", *DAY, i, float(i)) for i in range(1, 97) if i not in (5, 6, 96)]
    out = ops.expand_blocks(table(spark, POINTS, rows)).orderBy("ts").collect()
    assert len(out) == 96 and out[4]["value"] == 4.0 and out[5]["value"] == 4.0 and out[95]["value"] == 95.0


def test_explicit_points_are_never_filled(spark):
    rows = [("p", "A01", *DAY, i, float(i)) for i in (1, 2, 5)]
    df = table(spark, POINTS, rows)
    assert ops.expand_blocks(df).count() == 3
    assert ops.decode_diagnostics(df).first()["classification"] == "upstream_missing_a01_points"


@pytest.mark.parametrize("rows, reason", [
    ([("p", "A03", *DAY, 2, 1.0)], "initial_coverage"),
    ([("p", "A01", *DAY, 97, 1.0)], "position"),
    ([("p", "A01", *DAY, 1, 1.0), ("p", "A01", *DAY, 1, 2.0)], "duplicate_position"),
    ([("p", "A01", *DAY, 1, float("nan"))], "value"),
    ([("p", "A05", *DAY, 1, 1.0)], "curve_type"),
])
def test_broken_periods_are_reported(spark, rows, reason):
    assert [r["reason"] for r in ops.block_violations(table(spark, POINTS, rows)).collect()] == [reason]


@pytest.mark.parametrize("hours", [23, 25])
def test_short_and_long_local_days(spark, hours):
    end = f"2026-10-25 {22 + hours - 24:02d}:00:00"
    df = table(spark, POINTS, [("p", "A03", "2026-10-24 22:00:00", end, "PT60M", 1, 7.0)])
    assert ops.expand_blocks(df).count() == hours


def quarters(hour, minutes, label=None):
    return [("one", f"2026-01-05 {hour:02d}:{m:02d}:00", 1.0 * hour, label) for m in minutes]


PRICES = "series_id string, ts timestamp, value double, resolution string"


def test_hour_needs_its_own_resolution(spark):
    rows = quarters(0, (0, 15, 30, 45), "PT15M") + quarters(1, (0, 15, 30), "PT15M") + quarters(2, (0,), "PT60M") + quarters(3, (0,))
    out = ops.hourly_prices(table(spark, PRICES, rows), ["series_id"], "value")
    assert [str(r["ts"])[11:13] for r in out.orderBy("ts").collect()] == ["00", "02"]


def test_mixed_hour_is_fatal(spark):
    rows = quarters(0, (0, 15, 30), "PT15M") + quarters(0, (45,), "PT60M")
    with pytest.raises(DataContractError):
        ops.hourly_prices(table(spark, PRICES, rows), ["series_id"], "value")


def test_prefix_ends_at_the_first_gap_and_reports_it(spark):
    rows = [("one", f"2026-01-05 {h:02d}:00:00", 1.0) for h in (0, 1, 3, 4)]
    df = table(spark, "series_id string, ts timestamp, value double", rows)
    start = "2026-01-05 00:00:00"
    assert ops.contiguous_prefix(df, ["series_id"], start, HOUR).count() == 2
    report = ops.gap_report(df, ["series_id"], start, HOUR).first()
    assert (report["missing_count"], report["later_rows"], str(report["first_gap"])) == (1, 2, "2026-01-05 02:00:00")


def test_cadence_change_and_partial_last_hour(spark):
    cut = "2026-01-05 02:00:00"
    rows = [("one", f"2026-01-05 {t}:00", 1.0) for t in ("00:00", "01:00", "02:00", "02:15", "02:30", "02:45", "03:00", "03:15")]
    df = table(spark, "series_id string, ts timestamp, value double", rows)
    args = (["series_id"], "2026-01-05 00:00:00", HOUR, cut)
    assert ops.missing_slots(df, *args).count() == 0
    assert ops.missing_slots(df, *args, whole_hours=True).count() == 2
    assert ops.contiguous_prefix(df, *args, whole_hours=True).count() == 6


def test_gap_in_the_middle_of_an_hour_drops_that_hour_only(spark):
    cut = "2026-01-05 00:00:00"
    times = ["00:00", "00:15", "00:30", "00:45", "01:00", "01:30", "01:45", "02:00"]
    df = table(spark, "series_id string, ts timestamp, value double", [("one", f"2026-01-05 {t}:00", 1.0) for t in times])
    args = (["series_id"], cut, QUARTER, cut)
    assert ops.contiguous_prefix(df, *args, whole_hours=True).count() == 4
    assert [str(r["ts"])[11:16] for r in ops.missing_slots(df, *args, whole_hours=True).collect()] == ["01:15"]


def test_empty_price_hour_carries_the_resolution_before_it(spark):
    rows = quarters(0, (0,), "PT60M") + quarters(2, (0, 15, 30, 45), "PT15M") + quarters(4, (0, 15, 30, 45), "PT15M")
    df = table(spark, PRICES, rows)
    gaps = values(ops.price_hour_slots(df, ["series_id"], "2026-01-05 00:00:00"), "ts")
    assert [str(t[0])[11:16] for t in gaps] == ["01:00", "03:00", "03:15", "03:30", "03:45"]
    assert ops.contiguous_price_prefix(df, ["series_id"], "2026-01-05 00:00:00").count() == 1


def test_duplicate_input_does_not_change_the_resample(spark):
    rows = quarters(0, (0, 15, 30, 45))
    df = table(spark, PRICES, rows).drop("resolution")
    assert ops.resample_complete(df, ["series_id"], ["value"]).count() == 1
    assert ops.resample_complete(df.unionByName(df), ["series_id"], ["value"]).count() == 0


def test_block_violations_hold_no_table_of_points(spark):
    rows = [("a", "A01", *DAY, 1, 1.0), ("a", "A01", *DAY, None, 1.0), ("b", "A01", *DAY, 2, 1.0), ("b", "A01", *DAY, 2, 1.0),
            ("c", "A01", *DAY, 3, 1.0), ("c", "A01", *DAY, 1, float("nan")), ("d", "A03", *DAY, 1, 1.0), (None, "A03", *DAY, 2, None), (None, "A03", *DAY, 1, 2.0)]
    out = ops.block_violations(table(spark, POINTS, rows))
    found = {r["period_id"]: (r["reason"], r["low"], r["high"], r["n"], r["n_distinct"], r["bad"]) for r in out.collect()}
    assert found == {"a": ("duplicate_position", 1, 1, 2, 1, 0), "b": ("duplicate_position", 2, 2, 2, 1, 0),
                     "c": ("value", 1, 3, 2, 2, 1), None: ("value", 1, 2, 2, 2, 1)}
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
