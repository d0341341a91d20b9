import pytest
from frames import table
from pyspark.sql import functions as F

from tidegrid.functions import scalars, times
from tidegrid.operators import quality as ops, stats
from tidegrid.operators.features import active_incidents, failure_streak


@pytest.mark.parametrize("age, state", [(0, "Fresh"), (180, "Fresh"), (181, "Warning"), (360, "Warning"), (361, "Stale"), (-1, "Future timestamp")])
def test_freshness_limits(spark, age, state):
    df = table(spark, "source_kind string, ts timestamp", [("price", "2026-01-01 00:00:00")])
    now = str((__import__("pandas").Timestamp("2026-01-01") + __import__("pandas").Timedelta(minutes=age)))
    assert ops.freshness(df, now).first()["state"] == state


def facts(spark, **changes):
    row = {"latest_run_status": "SUCCESS", "latest_success_time": "2026-01-01 11:00:00", "oldest_core_ts": "2026-01-01 10:00:00",
           "forecast_issue_time": "2026-01-01 10:00:00", "forecast_withheld": False, "failed_checks": 0, "warning_checks": 0, "gap_count": 0, "artifacts_available": True}
    row.update(changes)
    return table(spark, "latest_run_status string, latest_success_time timestamp, oldest_core_ts timestamp, forecast_issue_time timestamp, forecast_withheld boolean, "
                 "failed_checks int, warning_checks int, gap_count int, artifacts_available boolean", [tuple(row.values())])


@pytest.mark.parametrize("changes, label", [
    ({}, "Healthy"), ({"latest_run_status": "error"}, "Degraded"), ({"oldest_core_ts": None}, "Degraded"), ({"artifacts_available": False}, "Degraded"),
    ({"failed_checks": 1}, "Degraded"), ({"latest_success_time": "2026-01-01 05:00:00"}, "Degraded"), ({"latest_success_time": None}, "Degraded"),
    ({"latest_success_time": "2026-01-01 09:00:00"}, "Warning"), ({"forecast_withheld": True}, "Warning"), ({"forecast_issue_time": None}, "Warning"),
    ({"gap_count": 2}, "Warning"), ({"warning_checks": 1}, "Warning"), ({"oldest_core_ts": "2026-01-01 07:30:00"}, "Warning"),
])
def test_operational_health(spark, changes, label):
    assert ops.operational_health(facts(spark, **changes), "2026-01-01 12:00:00").first()["label"] == label


def test_worst_source_decides(spark):
    df = spark.createDataFrame([("HEALTHY",), ("STALE",), ("DEGRADED",)], "status string")
    assert ops.overall_status(df).first()[0] == "STALE"
    assert ops.overall_status(df.limit(0)).first()[0] == "FAILED"


RUNS = "component string, id long, run_time timestamp, status string"


def test_failures_since_the_latest_success(spark):
    rows = [("a", 1, "2026-01-01", "FAILED"), ("a", 2, "2026-01-02", "SUCCESS"), ("a", 3, "2026-01-03", "FAILED"), ("a", 4, "2026-01-04", "UNKNOWN"),
            ("a", 5, "2026-01-05", "FAILED"), ("b", 6, "2026-01-01", "FAILED"), ("c", 7, "2026-01-01", "SUCCESS")]
    got = {r["component"]: r["failures"] for r in failure_streak(table(spark, RUNS, rows), ["component"]).collect()}
    assert got == {"a": 2, "b": 1, "c": 0}


def test_active_incident_is_the_latest_status(spark):
    rows = [("a", 1, "2026-01-01", "ACTIVE"), ("a", 2, "2026-01-02", "RESOLVED"), ("b", 3, "2026-01-01", "ACTIVE")]
    assert [r["component"] for r in active_incidents(table(spark, RUNS, rows), ["component"]).collect()] == ["b"]


def test_out_of_order_rows_are_seen_across_buckets(spark):
    rows = [(i, f"2026-01-{1 + i:02d}") for i in range(20)]
    rows[15] = (15, "2026-01-02")
    df = table(spark, "n long, ts timestamp", rows)
    for width in (4, 100):
        report = {r["check_name"]: r["failing"] for r in ops.check_timestamps(df, ingest_order="n", width=width).collect()}
        assert report == {"timestamp_parseable": 0, "timestamp_unique": 1, "timestamp_order": 1}


def test_readiness_levels(spark):
    grid = spark.range(24 * 20).select((F.col("id") % 24 + 1).cast("int").alias("horizon"),
                                       (F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(F.floor(F.col("id") / 24).cast("int"))).alias("issue"))
    assert stats.readiness(grid).first()["status"] == "READY_FOR_EVALUATION"
    assert stats.readiness(grid.filter("issue < '2026-01-06'")).first()["status"] == "PARTIALLY_READY"
    assert stats.readiness(grid.filter("horizon < 24")).first()["status"] == "NOT_READY"
    assert stats.readiness(grid.unionByName(grid.limit(1))).first()["status"] == "NOT_READY"


def test_text_rules(spark):
    rows = [("http://h/p?api-key=abc&x=1#top", "Bearer abc.def then password: hunter2 x", "PT1H30M", "  a \n b  ")]
    row = spark.createDataFrame(rows, "u string, t string, d string, b string").select(
        scalars.redact_query("u"), scalars.redact_text("t"), times.iso_duration_seconds("d"), scalars.concise("b"), scalars.concise(F.repeat(F.lit("x"), 200))).first()
    assert row[0] == "http://h/p?api-key=[REDACTED]&x=1#top" and row[1] == "Bearer [REDACTED] then password=[REDACTED] x"
    assert row[2] == 5400 and row[3] == "a b" and len(row[4]) == 160 and row[4].endswith("…")


@pytest.mark.parametrize("text, clean", [
    ("Authorization: Bearer a.b", "Authorization=[REDACTED] [REDACTED]"), ("api_key=a1, x=2", "api_key=[REDACTED], x=2"),
    ("go http://h/p?token=abc&x=1", "go http://h/p?token=[REDACTED]&x=1"), ("db://me:p,w@host/t", "db://[REDACTED]@host/t"),
    ("the secret = s3 is", "the secret =[REDACTED] is"), ("a secret is kept at 10:30", "a secret is kept at 10:30"),
    ("token=&x=1", "token=&x=1"), ("http://h:80/a@b", "http://[REDACTED]@b"), ("", ""), (None, None), (" \n a  b ", " \n a  b ")])
def test_free_text_is_redacted_by_its_pieces(spark, text, clean):
    # a port before a path with an @ could be a password with a slash, so it is masked
    assert spark.createDataFrame([(text,)], "t string").select(scalars.redact_text("t")).first()[0] == clean


@pytest.mark.parametrize("text, seconds", [("PT15M", 900), ("PT60M", 3600), ("PT90S", 90), ("P1D", None), ("PT", None), ("PT0M", None), ("15M", None), (None, None)])
def test_iso_durations(spark, text, seconds):
    assert spark.createDataFrame([(text,)], "d string").select(times.iso_duration_seconds("d")).first()[0] == seconds


def test_closeness_and_cells(spark):
    rows = [("1.0", "1.0000000001", True), ("1.0", "1.00001", False), ("a", "a", True), ("a", None, False), (None, None, True), ("0", "1e-13", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.filter(scalars.same_cell(F.col("a"), F.col("b")) != F.col("want")).count() == 0


@pytest.mark.parametrize("text, held", [
    ("some words of prose, at 10:30 = noon", False), ("http://h/p?x=1", False), ("a Pass-Word: x", True), ("BEARER y", True),
    ("db_TOKEN=", True), ("access key", True), ("", False)])
def test_only_text_that_may_hold_a_secret_is_cut_into_pieces(spark, text, held):
    row = spark.createDataFrame([(text,)], "t string").select(scalars._may_hold_secret(F.col("t")), scalars.redact_text("t")).first()
    assert row[0] == held and (held or row[1] == text)


def test_vintage_health_reads_its_rows_once(spark, tmp_path):
    rows = [("s", "A69", "A01", "d", "1", "2026-01-01 00:00:00", "x", "2026-01-02 00:00:00", "SOLAR", "PT60M", "2026-01-01 01:00:00", "2026-01-01 02:00:00")] * 2
    table(spark, "source string, document_type string, process_type string, document_id string, revision_number string, source_created_at_utc timestamp, "
          "series_id string, target_timestamp timestamp, technology string, resolution string, collection_issue_time timestamp, acquired_at_utc timestamp",
          rows).write.parquet(str(tmp_path / "given"))
    out = ops.vintage_health(spark.read.parquet(str(tmp_path / "given")), "2026-01-01 02:30:00", ["process_type"])
    row = out.first()
    assert (row["newest_rows"], row["revisions"], row["duplicates"], row["status"]) == (2, 1, 1, "DEGRADED")
    assert "/given" not in out._jdf.queryExecution().executedPlan().toString()
