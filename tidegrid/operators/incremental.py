"""Incremental ingestion: what to read, what to keep, what to predict."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.checks import ensure_none
from tidegrid.functions.times import HOUR, between_ts, floor_to, instant, shift
from tidegrid.operators.merge import Merge, merge_prices, merge_revisions
from tidegrid.operators.scale import salted_join
from tidegrid.operators.series import gap_report, infer_cadence

# Fixed value: how far back a source is read again for late or revised values.
OVERLAP_S = 48 * HOUR


def incremental_start(df: DataFrame, kind: str, now, history_start, keys: Sequence[str] = ("series_id",),
                      default_s: int = HOUR, overlap_s: int = OVERLAP_S, ts: str = "ts") -> DataFrame:
    """Start of the next read of each series, and whether anything is due.

    Prices start whole hours ``overlap_s`` before the last row, load and
    generation exactly ``overlap_s`` before it, other kinds one cadence after it.
    """
    end = floor_to(instant(now), HOUR)
    cadence = infer_cadence(df, keys, default_s, ts=ts)
    latest = df.groupBy(*keys).agg(F.max(ts).alias("latest_ts")).join(cadence, list(keys))
    start = {
        "price": shift(floor_to("latest_ts", HOUR), -overlap_s),
        "load": shift("latest_ts", -overlap_s),
        "generation": shift("latest_ts", -overlap_s),
    }.get(kind, shift("latest_ts", F.col("cadence_s")))
    if kind in ("price", "load", "generation"):
        start = F.greatest(start, instant(history_start))
    return latest.withColumn("start_ts", start).withColumns({
        "end_ts": end, "due": F.col("start_ts") < end})


def advanced(before, after) -> Column:
    """The watermark moved forward, or exists for the first time."""
    old, new = instant(before), instant(after)
    return F.coalesce(new.isNotNull() & (old.isNull() | (new > old)), F.lit(False))


class Increment(NamedTuple):
    merge: Merge
    gaps: DataFrame


def ingest_increment(stored: DataFrame, source: DataFrame, kind: str, now, start: str, keys: Sequence[str] = ("series_id",),
                     step_s: int = HOUR, overlap_s: int = OVERLAP_S, ts: str = "ts") -> Increment:
    """Read the due range, report its gaps, and merge it under the revision window.

    Rows after a gap are kept; nothing is filled. Only the overlap before the
    end of the range may revise stored values. Stored rows outside the range
    cannot change, so they are passed on without a join.
    """
    end = floor_to(instant(now), HOUR)
    inside = between_ts(ts, start, end)
    due, held, rest = source.filter(inside), stored.filter(inside), stored.filter(~inside)
    gaps = gap_report(due, keys, start, step_s, ts)
    window = (F.greatest(instant(start), shift(end, -overlap_s)), end)
    row_keys = [*keys, ts]
    if kind == "price":
        merged = merge_prices(held, due, row_keys, ts=ts, window=window)
    else:
        merged = merge_revisions(held, due, row_keys, ts=ts, window=window, retain=True)
    data = rest.unionByName(merged.data, allowMissingColumns=True)
    return Increment(Merge(data, merged.audit), gaps)


def trim_unpublished(df: DataFrame, keys: Sequence[str], columns: Sequence[str], ts: str = "ts",
                     check: bool = True) -> DataFrame:
    """Drop incomplete rows after the last complete one; an incomplete row before it is fatal."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    last = df.groupBy(*keys).agg(F.max(F.when(complete, F.col(ts))).alias("_last"))
    kept = salted_join(df, last, keys).filter(F.col(ts) <= F.col("_last")).drop("_last")
    if check:
        ensure_none(kept.filter(~complete), "Incomplete row inside the published range")
    return kept


def pending_targets(features: DataFrame, stored: DataFrame, keys: Sequence[str] = ("series_id",), *,
                    step_s: int = HOUR, ts: str = "ts", target: str = "target_ts") -> DataFrame:
    """Feature rows whose target is later than the last stored prediction of their series."""
    last = stored.groupBy(*keys).agg(F.max(target).alias("_last"))
    joined = salted_join(features.withColumn(target, shift(ts, step_s)), last, keys, "left")
    return joined.filter(F.col("_last").isNull() | (F.col(target) > F.col("_last"))).drop("_last")
