"""Structured Streaming forms of the incremental rules.

Each job returns a configured query writer or a started query; the caller
chooses sink, checkpoint folder and trigger.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidegrid.checks import ensure_unique
from tidegrid.functions.times import HOUR, QUARTER, is_exact
from tidegrid.operators.features import cooldown
from tidegrid.operators.merge import merge_revisions
from tidegrid.session import written
from tidegrid.sources.sinks import Manifest, VersionTaken, _path, manifest, publish_parts, read_parts, read_published

LATE = "48 hours"


def stream_hourly(df: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str = "ts", late: str = LATE) -> DataFrame:
    """Hourly means of complete hours (four aligned quarters), emitted once they can no longer change."""
    complete = (F.col("_rows") == 4) & F.col("_aligned")
    for v in values:
        complete = complete & (F.col(f"_n_{v}") == 4)
    hourly = df.withWatermark(ts, late).groupBy(*keys, F.window(ts, "1 hour")).agg(
        *[F.avg(v).alias(v) for v in values], F.count("*").alias("_rows"), F.min(is_exact(ts, QUARTER)).alias("_aligned"),
        *[F.count(v).alias(f"_n_{v}") for v in values])
    return hourly.filter(complete).select(*keys, F.col("window.start").alias("ts"), *values)


def stream_dedupe(df: DataFrame, identity: Sequence[str], ts: str = "acquired_at_utc", late: str = LATE) -> DataFrame:
    """First row of every vintage identity; state older than the watermark is dropped."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(identity))


def stream_merge(df: DataFrame, root: str, keys: Sequence[str], window: tuple, *, checkpoint: str, ts: str = "ts",
                 order: str | None = None, part: Column | None = None, tries: int = 5) -> StreamingQuery:
    """Merge every micro-batch into a published table under the revision rules, part by part.

    ``part`` names the part of a row (its month by default) and must follow
    from the keys. Only the parts that a batch delivers rows for are read,
    merged and written; the manifest goes on referring to all others. The
    batch number is published with the version, so a batch that Spark repeats
    after a failure is not merged twice; if another writer publishes in
    between, the batch is merged again on top of that.
    """
    part = F.date_format(ts, "yyyy-MM") if part is None else part

    def merged(spark: SparkSession, incoming: DataFrame, touched: list[str], before: Manifest | None) -> DataFrame:
        if before is None:
            return incoming
        if list(before.parts) == [""]:  # published as a whole so far
            return merge_revisions(read_published(spark, root), incoming, keys, ts=ts, window=window, retain=True).data
        return merge_revisions(read_parts(spark, root, before, touched), incoming, keys, ts=ts, window=window, retain=True).data

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        incoming = batch
        if order:
            row = F.max(F.struct(F.col(order), F.struct(*batch.columns).alias("r")))["r"]
            incoming = batch.groupBy(*keys).agg(row.alias("_r")).select("_r.*").drop(order)
        else:
            ensure_unique(incoming, list(keys), "The delivery repeats a key")
        touched = [r[0] for r in incoming.select(part.alias("p")).distinct().collect()]  # parts, not rows
        for turn in range(tries):
            before = manifest(spark, root)
            if before and before.mark is not None and int(before.mark) >= number:
                return
            out = merged(spark, incoming, touched, before)
            base = before._replace(parts={}) if before and list(before.parts) == [""] else before
            try:
                publish_parts(out, root, part, base, mark=str(number))
                return
            except VersionTaken:
                if turn + 1 == tries:
                    raise

    return df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_realized(forecasts: DataFrame, actual: DataFrame, late: str = "25 hours", step_s: int = HOUR) -> DataFrame:
    """Stream-stream join of issued forecasts with the values that came true.

    Both sides carry a watermark and the target times bound each other, so old
    forecasts and old observations leave the state.
    """
    issued = forecasts.withWatermark("target_timestamp", late).filter(
        (F.col("forecast_issue_time") < F.col("target_timestamp")) & (F.col("issued_at_utc") < F.col("target_timestamp")))
    seen = actual.withColumnsRenamed({"target_timestamp": "actual_ts", "price_eur_mwh": "actual_price_eur_mwh",
                                      "series_id": "actual_series"}).withWatermark("actual_ts", late)
    error = F.col("predicted_price_eur_mwh") - F.col("actual_price_eur_mwh")
    joined = issued.join(seen, F.expr("series_id = actual_series AND target_timestamp = actual_ts"))
    return joined.drop("actual_ts", "actual_series").withColumns(
        {"signed_error": error, "absolute_error": F.abs(error), "squared_error": error * error})


def stream_cooldown(df: DataFrame, root: str, keys: Sequence[str], minutes: int, *, checkpoint: str, ts: str = "run_time",
                    tie: str = "id", late: str = "1 hour") -> StreamingQuery:
    """Drop a repeat of a key within ``minutes`` of its last kept event, batch by batch.

    Every micro-batch is thinned by the batch rule (``cooldown``), which cuts a
    busy key into blocks; only the last kept time of each key goes on to the
    next batch, as a small table beside the rows. An event older than the last
    kept one counts as a repeat, one older than ``late`` before the newest event
    of the batches before is dropped, and so are the times of keys that have
    been idle for so long. Rows and state of a batch are folders of its own, so
    a repeated batch writes them again. ``read_cooldown`` reads the rows.
    """
    keys = list(keys)
    gap, slack = minutes * 60 * 1_000_000, int(pd.Timedelta(late).value // 1000)
    kinds = dict(df.dtypes)
    state_schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "last_us long, seen_us long, batch long"])

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path, fs = _path(spark, f"{root}/state")
        numbers = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path)] if fs.exists(path) else []
        newest = max((n for n in numbers if n < number), default=None)
        state = spark.createDataFrame([], state_schema) if newest is None else spark.read.schema(state_schema).parquet(
            f"{root}/state").filter(F.col("batch") == newest)
        seen = state.agg(F.max("seen_us")).first()[0]
        us = F.unix_micros(ts)
        fresh = batch if seen is None else batch.filter(us >= seen - slack)
        since = state.filter("last_us IS NOT NULL").select(*keys, (F.col("last_us") + gap).alias("_from"))
        kept = written(cooldown(fresh, keys, minutes, ts, tie, since=since))
        kept.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")
        top = max(x for x in (seen, batch.agg(F.max(us)).first()[0], 0) if x is not None)
        last = state.filter("last_us IS NOT NULL").select(*keys, "last_us").unionByName(
            kept.groupBy(*keys).agg(F.max(us).alias("last_us"))).groupBy(*keys).agg(F.max("last_us").alias("last_us"))
        alive = last.filter(F.col("last_us") + gap >= top - slack).withColumn("seen_us", F.lit(top).cast("long"))
        blank = spark.range(1).select(*[F.lit(None).cast(kinds[k]).alias(k) for k in keys], F.lit(None).cast("long").alias("last_us"),
                                      F.lit(top).cast("long").alias("seen_us"))  # keeps the newest time when no key is alive
        alive.unionByName(blank).write.mode("overwrite").parquet(f"{root}/state/batch={number}")

    return df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_cooldown(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The rows that ``stream_cooldown`` kept."""
    return spark.read.schema(schema).parquet(f"{root}/rows").select(*schema.names)
