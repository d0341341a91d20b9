"""Queries that run a table through a streaming job in several micro-batches and read its sink.

The rows come as files in order of time. Some come later than their time: one
batch later, inside the watermark, or three batches later, beyond it. After
half of the files the job is stopped and goes on from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.times import DAY, elapsed_seconds, instant, shift
from tidegrid.plans import features  # noqa: F401  registers the batch cooldown and its SQL
from tidegrid.plans.adapters import F_SQL, H_SQL, M_SQL, K, actuals, forecasts, hours, quarters_all, runs, stored_and_incoming
from tidegrid.plans.registry import ORACLES, query
from tidegrid.plans.sources import scratch
from tidegrid.session import written
from tidegrid.sources.sinks import publish_table, read_published
from tidegrid.streaming import jobs

START = "2024-01-01 00:00:00"
#: Batches of a feed, and days of each.
BATCHES, DAYS = 6, 5


def chunk(ts="ts"):
    """The batch that a time belongs to, and the day inside it."""
    day = F.floor(elapsed_seconds(ts, instant(START)) / DAY)
    return F.least(F.greatest(F.floor(day / DAYS), F.lit(0)), F.lit(BATCHES - 1)).cast("int"), F.pmod(day, F.lit(DAYS))


_DAY = f"date_diff('day', TIMESTAMP '{START}', date_trunc('day', {{0}}))"
CHUNK_SQL = f"least(greatest({_DAY} // {DAYS}, 0), {BATCHES - 1})"
DAY_SQL = f"{_DAY} % {DAYS}"


def feed(df, batch, numbers, path):
    """Append a file for each batch number, one after another, so that a stream takes them in this order."""
    rows = written(df.withColumn("_batch", batch))
    for n in numbers:
        rows.filter(F.col("_batch") == n).drop("_batch").coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_in_two(spark, sources, build):
    """Feed half of the batches, run to the end, feed the rest, and go on from the checkpoint; read what was written.

    ``sources`` are pairs of a frame and the batch of its rows; ``build`` makes
    the streaming frame of their streams.
    """
    out, checkpoint = scratch(spark), scratch(spark)
    paths = [scratch(spark) for _ in sources]
    for numbers in (range(BATCHES // 2), range(BATCHES // 2, BATCHES)):
        for (df, batch), path in zip(sources, paths, strict=True):
            feed(df, batch, numbers, path)
        frame = build(*[stream_of(spark, path, df.schema) for (df, _), path in zip(sources, paths, strict=True)])
        frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


# Hours that closed: the watermark ends 48 hours before the newest quarter. Quarters that come three batches late leave
# their hour incomplete; those that come one batch late, from the last half day of their batch, still complete theirs.
LOST_SQL = f"({DAY_SQL.format('ts')} = 0 AND minute(ts) = 15 AND hour(ts) % 3 = 0 AND {CHUNK_SQL.format('ts')} <= 2)"


@query("ss1_stream_hourly", f"""WITH q AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, round((avg(value) * {K}) * 1024) / 1024 AS value FROM events GROUP BY 1)
SELECT 'all' AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM q WHERE NOT {LOST_SQL} GROUP BY 2
HAVING count(*) = 4 AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM q) - INTERVAL 48 HOUR""")
def _(spark, d):
    source = quarters_all(spark, d).select("series_id", "ts", "value")
    own, day = chunk()
    minute, hour = F.minute("ts"), F.hour("ts")
    lost = (day == 0) & (minute == 15) & (hour % 3 == 0) & (own <= 2)
    late = (day == DAYS - 1) & (hour >= 12) & (minute == 30) & (own < BATCHES - 1)
    batch = F.when(lost, own + 3).when(late, own + 1).otherwise(own)
    return run_in_two(spark, [(source, batch)], lambda s: jobs.stream_hourly(s, ["series_id"], ["value"]))


# A copy within the watermark is dropped, one that comes 20 days later finds no state any more; rows that come three
# batches late are dropped unless a copy of them came in time.
@query("ss2_stream_dedupe", f"""WITH {H_SQL}, x AS (SELECT *, {CHUNK_SQL.format('ts')} AS own, {DAY_SQL.format('ts')} AS day FROM h)
SELECT series_id, ts, value FROM x WHERE NOT (day = 0 AND hour(ts) % 7 = 0 AND own <= 2)
UNION ALL SELECT series_id, ts, value FROM x WHERE ts < TIMESTAMP '{START}' + INTERVAL 10 DAY""")
def _(spark, d):
    base = hours(spark, d).select("series_id", "ts", "value")
    own, day = chunk()
    lost = (day == 0) & (F.hour("ts") % 7 == 0) & (own <= 2)
    first = base.withColumns({"acquired_at_utc": shift("ts", 600), "_b": F.when(lost, own + 3).otherwise(own)})
    again = base.filter(~lost).withColumns({"acquired_at_utc": shift("ts", 900), "_b": F.least(own + F.when(
        (day == DAYS - 1) & (F.hour("ts") >= 12), 1).otherwise(0), F.lit(BATCHES - 1))})
    much_later = base.filter(F.col("ts") < shift(instant(START), 10 * DAY)).withColumns(
        {"acquired_at_utc": shift("ts", 20 * DAY), "_b": own + 4})
    both = written(first.unionByName(again).unionByName(much_later))
    kept = run_in_two(spark, [(both, F.col("_b"))],
                      lambda s: jobs.stream_dedupe(s.drop("_b"), ["series_id", "ts"]))
    return kept.select("series_id", "ts", "value")


@query("ss3_stream_merge", f"""WITH {M_SQL} SELECT coalesce(s.series_id, i.series_id) AS series_id, coalesce(s.ts, i.ts) AS ts,
  CASE WHEN s.ts IS NULL THEN i.price ELSE coalesce(s.price, i.price) END AS price,
  CASE WHEN s.ts IS NULL OR (i.ts >= TIMESTAMP '1998-06-01 00:00:00' AND i.ts < TIMESTAMP '1999-03-01 00:00:00' AND i.total IS NOT NULL) THEN i.total ELSE s.total END AS total
FROM stored s FULL JOIN incoming i ON i.series_id = s.series_id AND i.ts = s.ts""")
def _(spark, d):
    stored, incoming = stored_and_incoming(spark, d)
    root = scratch(spark)
    publish_table(stored, root)
    path, checkpoint = scratch(spark), scratch(spark)
    year = F.greatest(F.least(F.year("ts") - 1997, F.lit(3)), F.lit(0))
    for numbers in ((0, 1), (2, 3)):
        feed(incoming, year, numbers, path)
        jobs.stream_merge(stream_of(spark, path, incoming.schema), root, ["series_id", "ts"], ("1998-06-01 00:00:00", "1999-03-01 00:00:00"),
                          checkpoint=checkpoint).awaitTermination()
    return read_published(spark, root)


# Values of the last half day of a batch come one batch late and still meet their forecasts in the state; some of the
# first day come three batches late and are dropped.
@query("ss4_stream_realized", f"""WITH {F_SQL}, a AS (SELECT * FROM actual WHERE NOT ({DAY_SQL.format('target_timestamp')} = 0
  AND hour(target_timestamp) = 6 AND {CHUNK_SQL.format('target_timestamp')} <= 2))
SELECT f.series_id, model_release, forecast_issue_time, CAST(horizon_hours AS INTEGER) AS horizon_hours, f.target_timestamp,
  predicted_price_eur_mwh - a.price_eur_mwh AS signed_error
FROM history f JOIN a ON a.series_id = f.series_id AND a.target_timestamp = f.target_timestamp WHERE issued_at_utc < f.target_timestamp""")
def _(spark, d):
    own, day = chunk("target_timestamp")
    hour = F.hour("target_timestamp")
    batch = F.when((day == 0) & (hour == 6) & (own <= 2), own + 3).when((day == DAYS - 1) & (hour >= 12) & (own < BATCHES - 1), own + 1).otherwise(own)
    return run_in_two(spark, [(forecasts(spark, d), own), (actuals(spark, d), batch)], jobs.stream_realized).select(
        "series_id", "model_release", "forecast_issue_time", "horizon_hours", "target_timestamp", "signed_error")


@query("ss5_stream_cooldown", ORACLES["wn17_cooldown"])
def _(spark, d):
    events, root, path, checkpoint = runs(spark, d).select("component", "run_time", "id"), scratch(spark), scratch(spark), scratch(spark)
    own, _ = chunk("run_time")
    for numbers in (range(BATCHES // 2), range(BATCHES // 2, BATCHES)):
        feed(events, own, numbers, path)
        jobs.stream_cooldown(stream_of(spark, path, events.schema), root, ["component"], 60, checkpoint=checkpoint).awaitTermination()
    return jobs.read_cooldown(spark, root, events.schema)
