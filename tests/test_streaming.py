import time

import pytest
from frames import table, values
from pyspark.sql import functions as F

from tidegrid.sources.sinks import VersionTaken, manifest, publish_parts, publish_table, read_published
from tidegrid.streaming import jobs


def feed(path, frames):
    """One file per frame, in order of time."""
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


def drain(df, tmp_path, spark):
    out = str(tmp_path / "out")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_quarters_complete_an_hour_until_the_watermark(spark, tmp_path):
    schema = "series_id string, ts timestamp, value double"
    first = [("a", f"2026-01-01 0{h}:{m:02d}:00", 1.0 + m) for h, m in ((0, 0), (0, 15), (0, 30), (1, 0), (1, 15), (1, 30))]
    late = [("a", "2026-01-01 00:45:00", 1.0)]
    far, farther = [("a", "2026-01-09 00:00:00", 1.0)], [("a", "2026-01-09 02:00:00", 1.0)]  # Spark drops late rows one batch after the watermark moved
    too_late = [("a", "2026-01-01 01:45:00", 1.0)]
    feed(str(tmp_path / "in"), [table(spark, schema, rows) for rows in (first, late, far, farther, too_late)])
    out = drain(jobs.stream_hourly(source(spark, str(tmp_path / "in"), schema), ["series_id"], ["value"]), tmp_path, spark)
    assert [str(r[0]) for r in values(out, "ts")] == ["2026-01-01 00:00:00"]


def test_first_copy_of_a_vintage_wins(spark, tmp_path):
    schema = "id string, acquired_at_utc timestamp"
    feed(str(tmp_path / "in"), [table(spark, schema, rows) for rows in ([("d", "2026-01-01 00:00:00")], [("d", "2026-01-01 01:00:00"), ("e", "2026-01-01 01:00:00")])])
    out = drain(jobs.stream_dedupe(source(spark, str(tmp_path / "in"), schema), ["id"]), tmp_path, spark)
    assert [str(r[1]) for r in values(out, "id", "acquired_at_utc")] == ["2026-01-01 00:00:00", "2026-01-01 01:00:00"]


def test_stream_merge_equals_batches_in_order(spark, tmp_path):
    schema = "series_id string, ts timestamp, value double"
    root = str(tmp_path / "table")
    publish_table(table(spark, schema, [("a", "2026-01-01", 1.0), ("a", "2026-01-02", None)]), root)
    feed(str(tmp_path / "in"), [table(spark, schema, rows) for rows in ([("a", "2026-01-01", 9.0), ("a", "2026-01-02", 2.0)], [("a", "2026-01-02", 3.0), ("a", "2026-01-03", 4.0)])])
    jobs.stream_merge(source(spark, str(tmp_path / "in"), schema), root, ["series_id", "ts"], ("2026-01-02 00:00:00", "2026-01-03 00:00:00"),
                      checkpoint=str(tmp_path / "cp")).awaitTermination()
    assert values(read_published(spark, root), "value") == [(1.0,), (3.0,), (4.0,)]


def test_a_batch_writes_only_the_parts_that_it_touches(spark, tmp_path):
    schema = "series_id string, ts timestamp, value double"
    root, window = str(tmp_path / "table"), ("2026-01-01 00:00:00", "2026-04-01 00:00:00")
    feed(str(tmp_path / "in"), [table(spark, schema, rows) for rows in (
        [("a", f"2026-0{m}-10 00:00:00", float(m)) for m in (1, 2, 3)], [("a", "2026-02-10 00:00:00", 9.0), ("a", "2026-02-11 00:00:00", 8.0)])])
    jobs.stream_merge(source(spark, str(tmp_path / "in"), schema), root, ["series_id", "ts"], window, checkpoint=str(tmp_path / "cp")).awaitTermination()
    first, second = manifest(spark, root, 1), manifest(spark, root)
    assert second.version == 2 and {p for p in second.parts if second.parts[p] != first.parts.get(p)} == {"2026-02"}
    assert values(read_published(spark, root), "value") == [(1.0,), (3.0,), (8.0,), (9.0,)]
    with pytest.raises(VersionTaken):  # another writer that had read version 1
        publish_parts(table(spark, schema, [("a", "2026-03-10 00:00:00", 0.0)]), root, F.date_format("ts", "yyyy-MM"), first)
    assert manifest(spark, root) == second


@pytest.mark.parametrize("split", [1, 3])
def test_stream_cooldown_equals_the_batch_rule(spark, tmp_path, split):
    schema = "component string, run_time timestamp, id long"
    rows = [("a", f"2026-01-01 {m // 60:02d}:{m % 60:02d}:00", m) for m in (0, 59, 61, 119, 121)] + [("b", "2026-01-01 00:30:00", 1)]
    rows.sort(key=lambda r: r[1])
    size = -(-len(rows) // split)
    feed(str(tmp_path / "in"), [table(spark, schema, rows[i:i + size]) for i in range(0, len(rows), size)])
    root, feed_schema = str(tmp_path / "kept"), table(spark, schema, rows[:1]).schema
    jobs.stream_cooldown(source(spark, str(tmp_path / "in"), schema), root, ["component"], 60, checkpoint=str(tmp_path / "cp")).awaitTermination()
    out = jobs.read_cooldown(spark, root, feed_schema)
    assert sorted((r["component"], r["id"]) for r in out.collect()) == [("a", 0), ("a", 61), ("a", 121), ("b", 1)]
    # the state goes on after a restart: 12 minutes after the last kept event of a, and an event far too late
    more = [("a", "2026-01-01 02:13:00", 133), ("a", "2026-01-01 03:02:00", 182), ("c", "2026-01-01 00:10:00", 5)]
    feed(str(tmp_path / "in"), [table(spark, schema, more)])
    jobs.stream_cooldown(source(spark, str(tmp_path / "in"), schema), root, ["component"], 60, checkpoint=str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["id"] for r in jobs.read_cooldown(spark, root, feed_schema).collect()) == [0, 1, 61, 121, 182]


def test_stream_realized_needs_earlier_issuance(spark, tmp_path):
    f = "series_id string, forecast_issue_time timestamp, target_timestamp timestamp, issued_at_utc timestamp, predicted_price_eur_mwh double"
    a = "series_id string, target_timestamp timestamp, price_eur_mwh double"
    feed(str(tmp_path / "f"), [table(spark, f, [("s", "2026-01-01 00:00:00", "2026-01-01 01:00:00", "2026-01-01 00:10:00", 5.0), ("s", "2026-01-01 00:00:00", "2026-01-01 02:00:00", "2026-01-01 02:10:00", 6.0)])])
    feed(str(tmp_path / "a"), [table(spark, a, [("s", "2026-01-01 01:00:00", 4.0), ("s", "2026-01-01 02:00:00", 4.0)])])
    out = drain(jobs.stream_realized(source(spark, str(tmp_path / "f"), f), source(spark, str(tmp_path / "a"), a)), tmp_path, spark)
    assert values(out.withColumn("signed_error", F.round("signed_error", 6)), "signed_error") == [(1.0,)]
