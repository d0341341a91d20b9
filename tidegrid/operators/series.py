"""Time-series reshaping: spines, resampling, completeness, gaps, block decoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.checks import ensure_none
from tidegrid.functions.scalars import is_finite
from tidegrid.functions.times import (
    DAY, HOUR, QUARTER, epoch, floor_to, instant, is_exact, iso_duration_seconds, shift,
)
from tidegrid.operators.scale import nearest_known, salted_join

# Seconds and expected points per hour of a source resolution.
RESOLUTION_SECONDS = {"PT15M": 900, "PT60M": 3600}
POINTS_PER_HOUR = {"PT15M": 4, "PT60M": 1}
# Fixed value: the instant from which unlabelled prices are quarter-hourly.
QUARTER_HOUR_CUTOVER = "2025-09-30 22:00:00"


# --- block-coded documents ----------------------------------------------------

def points_to_ts(points: DataFrame) -> DataFrame:
    """Position -> timestamp, from ``period_start`` and an ISO ``resolution``."""
    step = iso_duration_seconds("resolution")
    return points.withColumn("ts", shift("period_start", (F.col("position") - 1) * step))


def position_violations(points: DataFrame) -> DataFrame:
    """Points before position 1 or at or after the end of their period."""
    return points_to_ts(points).filter(
        (F.col("position") < 1) | (F.col("ts") >= F.col("period_end")) | F.col("ts").isNull()
    )


def expand_blocks(points: DataFrame) -> DataFrame:
    """A03 values hold until the next position or the period end; A01 points stand alone.

    ``points`` carries its period columns: period_id, curve_type, period_start,
    period_end, resolution, position, value. A window never leaves one period.
    """
    step = iso_duration_seconds("resolution")
    slots = F.floor((epoch("period_end") - epoch("period_start")) / step)
    following = F.lead("position").over(Window.partitionBy("period_id").orderBy("position"))
    last = F.when(F.col("curve_type") == "A03", F.coalesce(following, slots + 1) - 1).otherwise(
        F.col("position")
    )
    return (
        points.withColumn("_last", last.cast("int"))
        .withColumn("slot", F.explode(F.sequence(F.col("position"), F.col("_last"))))
        .select(
            "period_id",
            shift("period_start", (F.col("slot") - 1) * step).alias("ts"),
            "value",
            "resolution",
        )
    )


def block_violations(points: DataFrame) -> DataFrame:
    """Periods that may not be decoded, with the first rule they break.

    Points are sorted by position within their period, so that a task holds one
    sort that can spill, and no hash table of all its points.
    """
    step = iso_duration_seconds("resolution")
    span = epoch("period_end") - epoch("period_start")
    period = ["period_id", "curve_type", "period_start", "period_end", "resolution"]
    line = Window.partitionBy(*period).orderBy("position")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # equal positions are neighbours; nulls come first and never count as distinct
    fresh = F.col("position").isNotNull() & ~F.col("position").eqNullSafe(F.lag("position").over(line))
    per_period = (
        points.select(*period, "position", (~is_finite("value")).alias("_bad"))
        .withColumns({"_fresh": fresh, "_at": F.row_number().over(line)})
        .withColumns({
            "low": F.min("position").over(whole), "high": F.max("position").over(whole),
            "n": F.count("*").over(whole), "n_distinct": F.count_if("_fresh").over(whole),
            "bad": F.count_if("_bad").over(whole)})
        .filter(F.col("_at") == 1).select(*period, "low", "high", "n", "n_distinct", "bad")
    )
    reason = (
        F.when(~F.col("curve_type").isin("A01", "A03"), "curve_type")
        .when(~F.col("resolution").isin(*RESOLUTION_SECONDS), "resolution")
        .when((span <= 0) | (F.pmod(span, step) != 0)
              | (F.pmod(epoch("period_start"), step) != 0), "interval")
        .when((F.col("low") < 1) | (F.col("high") > F.floor(span / step)), "position")
        .when(F.col("n") != F.col("n_distinct"), "duplicate_position")
        .when(F.col("bad") > 0, "value")
        .when((F.col("curve_type") == "A03") & (F.col("low") != 1), "initial_coverage")
    )
    return per_period.withColumn("reason", reason).filter("reason IS NOT NULL")


def decode_diagnostics(points: DataFrame) -> DataFrame:
    """Explicit, expected and decoded slots of every period, and what that means."""
    step = iso_duration_seconds("resolution")
    expected = F.floor((epoch("period_end") - epoch("period_start")) / step).cast("long")
    is_block = F.col("curve_type") == "A03"
    return (
        points.groupBy("period_id", "curve_type", "period_start", "period_end", "resolution")
        .agg(F.count("*").alias("explicit_points"))
        .select(
            "period_id", "curve_type", "explicit_points", expected.alias("expected_slots"),
            F.when(is_block, expected).otherwise(F.col("explicit_points")).alias("decoded_slots"),
            F.when(is_block, "decoded_a03_blocks")
            .when(F.col("explicit_points") == expected, "complete_a01")
            .otherwise("upstream_missing_a01_points").alias("classification"),
        )
    )


# --- spines and resampling ----------------------------------------------------

def spine(bounds: DataFrame, keys: Sequence[str], step_s: int, ts: str = "ts") -> DataFrame:
    """Every grid time from ``first_ts`` to ``last_ts`` of each key.

    Expanded day by day, so that no single row explodes into a whole series,
    and spread over tasks between the two steps.
    """
    keys = list(keys)
    per_task = step_s * max(64, DAY // step_s)
    first, last = epoch("first_ts"), epoch("last_ts")
    chunks = bounds.filter("first_ts <= last_ts").select(
        *keys, first.alias("_first"), last.alias("_last"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((last - first) / per_task))).alias("_chunk"),
    )
    start = F.col("_first") + F.col("_chunk") * per_task
    stop = F.least(F.col("_last"), start + (per_task - step_s))
    return (
        chunks.repartition(*keys, "_chunk")
        .withColumn("_at", F.explode(F.sequence(start, stop, F.lit(step_s).cast("long"))))
        .select(*keys, F.timestamp_seconds("_at").alias(ts))
    )


def bounds_of(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def densify(df: DataFrame, keys: Sequence[str], step_s: int = HOUR, ts: str = "ts") -> DataFrame:
    """Put missing grid times back as rows of nulls, from first to last time of each key."""
    grid = spine(bounds_of(df, keys, ts), keys, step_s, ts)
    return grid.join(df, [*keys, ts], "left")


def resample_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str], step_s: int = HOUR,
                  ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys, floor_to(ts, step_s).alias(ts)).agg(
        *[F.avg(c).alias(c) for c in values]
    )


def resample_complete(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                      required: Sequence[str] | None = None, ts: str = "ts") -> DataFrame:
    """Hourly means of hours with exactly four aligned quarters and no required null."""
    required = list(values if required is None else required)
    complete = (F.col("_rows") == 4) & F.col("_aligned")
    for name in required:
        complete = complete & (F.col(f"_n_{name}") == 4)
    hourly = df.groupBy(*keys, floor_to(ts, HOUR).alias(ts)).agg(
        *[F.avg(c).alias(c) for c in values],
        F.count("*").alias("_rows"), F.min(is_exact(ts, QUARTER)).alias("_aligned"),
        *[F.count(c).alias(f"_n_{c}") for c in required],
    )
    return hourly.filter(complete).select(*keys, ts, *values)


def effective_resolution(df: DataFrame, cutover=QUARTER_HOUR_CUTOVER, ts: str = "ts",
                         resolution: str = "resolution") -> Column:
    """The declared resolution, or the one that applied at that time."""
    inferred = F.when(F.col(ts) >= instant(cutover), "PT15M").otherwise("PT60M")
    return F.coalesce(F.col(resolution), inferred) if resolution in df.columns else inferred


def hourly_prices(df: DataFrame, keys: Sequence[str], value: str = "value",
                  cutover=QUARTER_HOUR_CUTOVER, ts: str = "ts", check: bool = True) -> DataFrame:
    """Hourly prices of complete hours, four points for PT15M and one for PT60M."""
    hourly = _price_hours(df, keys, value, cutover, ts)
    if check:
        ensure_none(price_hour_violations(df, keys, cutover, ts), "Unusable price hour")
    expected = F.when(F.col("_low") == "PT15M", 4).when(F.col("_low") == "PT60M", 1)
    return hourly.filter(
        (F.col("_low") == F.col("_high")) & (F.col("_rows") == expected)
        & F.col("_aligned") & (F.col("_values") == F.col("_rows"))
    ).select(*keys, ts, value)


def price_hour_violations(df: DataFrame, keys: Sequence[str], cutover=QUARTER_HOUR_CUTOVER,
                          ts: str = "ts") -> DataFrame:
    """Hours that mix resolutions or carry an unknown one."""
    hourly = _price_hours(df, keys, None, cutover, ts)
    reason = F.when(F.col("_low") != F.col("_high"), "mixed_resolution").when(
        ~F.col("_low").isin(*RESOLUTION_SECONDS), "unsupported_resolution"
    )
    return hourly.select(*keys, ts, reason.alias("reason")).filter("reason IS NOT NULL")


def _price_hours(df, keys, value, cutover, ts):
    labelled = df.withColumn("_res", effective_resolution(df, cutover, ts))
    aligned = F.when(F.col("_res") == "PT15M", is_exact(ts, QUARTER)).otherwise(is_exact(ts, HOUR))
    values = [F.avg(value).alias(value), F.count(value).alias("_values")] if value else []
    return labelled.groupBy(*keys, floor_to(ts, HOUR).alias(ts)).agg(
        *values, F.count("*").alias("_rows"), F.min("_res").alias("_low"),
        F.max("_res").alias("_high"), F.min(aligned).alias("_aligned"),
    )


def hourly_load(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return resample_complete(df, keys, ["load_mw"], ts=ts)


def hourly_generation(df: DataFrame, keys: Sequence[str], names: Mapping[str, str],
                      optional: Sequence[str] = ("nuclear_mw",), ts: str = "ts") -> DataFrame:
    """Complete generation hours under their standard names, with total wind.

    Only source columns that exist are taken; all but ``optional`` must be
    present in all four quarters.
    """
    present = {old: new for old, new in names.items() if old in df.columns}
    renamed = df.select(*keys, ts, *[F.col(old).alias(new) for old, new in present.items()])
    values = list(present.values())
    hourly = resample_complete(renamed, keys, values, [v for v in values if v not in optional], ts)
    return wind_total(hourly)


def wind_total(df: DataFrame) -> DataFrame:
    """Offshore plus onshore wind: an absent column counts as 0, a null cell stays null."""
    parts = [F.col(c) if c in df.columns else F.lit(0.0)
             for c in ("wind_offshore_mw", "wind_onshore_mw")]
    return df.withColumn("wind_total_mw", parts[0] + parts[1])


VINTAGE_KEYS = (
    "series_id", "source", "document_type", "process_type", "document_id", "revision_number",
    "source_created_at_utc", "effective_issue_time", "acquired_at_utc", "resolution", "technology",
)


def hourly_vintages(df: DataFrame, keys: Sequence[str] = VINTAGE_KEYS) -> DataFrame:
    """Hourly mean per source vintage with ``reject_reason``; null marks a usable hour.

    Null keys form groups of their own. One aggregation yields both the usable
    rows (``accepted``) and the counted rejects (``reject_counts``).
    """
    finite = is_finite("value_mw")
    hourly = df.groupBy(*keys, floor_to("target_timestamp", HOUR).alias("target_hour")).agg(
        F.count("*").alias("_rows"), F.min(is_exact("target_timestamp", QUARTER)).alias("_quarter"),
        *[F.count_if(F.minute("target_timestamp") == m).alias(f"_at_{m}") for m in (0, 15, 30, 45)],
        F.min(is_exact("target_timestamp", HOUR)).alias("_hour"),
        F.count_if(~finite).alias("_bad"), F.avg(F.when(finite, F.col("value_mw"))).alias("value_mw"),
    )
    full = (F.col("_rows") == 4) & F.col("_quarter")
    for m in (0, 15, 30, 45):
        full = full & (F.col(f"_at_{m}") == 1)
    single = (F.col("_rows") == 1) & F.col("_hour")
    supported = F.coalesce(F.col("resolution").isin(*RESOLUTION_SECONDS), F.lit(False))
    reason = (
        F.when(~supported, "unsupported_resolution")
        .when((F.col("resolution") == "PT15M") & ~full, "incomplete_pt15m_hour")
        .when((F.col("resolution") == "PT60M") & ~single, "invalid_pt60m_hour")
        .when(F.col("_bad") > 0, "non_finite_value")
    )
    return hourly.withColumn("reject_reason", reason).drop(
        "_rows", "_quarter", "_hour", "_bad", "_at_0", "_at_15", "_at_30", "_at_45"
    )


def accepted(hourly: DataFrame) -> DataFrame:
    return (
        hourly.filter("reject_reason IS NULL").drop("reject_reason")
        .withColumnRenamed("target_hour", "target_timestamp")
    )


def reject_counts(hourly: DataFrame, keys: Sequence[str] = VINTAGE_KEYS) -> DataFrame:
    """Rejected hours by reason; an unsupported resolution counts once per vintage."""
    unsupported = F.col("reject_reason") == "unsupported_resolution"
    units = hourly.filter("reject_reason IS NOT NULL").select(
        *keys, "reject_reason", F.when(~unsupported, F.col("target_hour")).alias("_unit")
    )
    return units.distinct().groupBy("reject_reason").agg(F.count("*").alias("rejected"))


# --- continuity ---------------------------------------------------------------

def expected_slots(bounds: DataFrame, keys: Sequence[str], step_s: int, cutover=None,
                   fine_step_s: int = QUARTER, ts: str = "ts") -> DataFrame:
    """Expected times, in steps of ``step_s`` and, from ``cutover`` on, of ``fine_step_s``."""
    if cutover is None:
        return spine(bounds, keys, step_s, ts)
    change = instant(cutover)
    # The last coarse time before the change still makes one coarse step.
    first, turn = epoch("first_ts"), epoch(change)
    to_turn = F.greatest(F.ceil((turn - first) / step_s), F.lit(0))
    fine_start = F.when(F.col("first_ts") >= change, F.col("first_ts")).otherwise(
        F.timestamp_seconds(first + to_turn * step_s)
    )
    coarse = bounds.filter(F.col("first_ts") < change).withColumn(
        "last_ts", F.least("last_ts", shift(change, -1))
    )
    fine = bounds.withColumn("first_ts", fine_start).filter("first_ts <= last_ts")
    return spine(coarse, keys, step_s, ts).unionByName(spine(fine, keys, fine_step_s, ts))


def missing_slots(df: DataFrame, keys: Sequence[str], start, step_s: int, cutover=None,
                  whole_hours: bool = False, ts: str = "ts") -> DataFrame:
    """Expected times from ``start`` to the last row of each key that have no row.

    With ``whole_hours`` the quarters missing from the last hour after the
    cutover count as missing too.
    """
    seen = df.select(*keys, ts)
    last = seen.groupBy(*keys).agg(F.max(ts).alias("last_ts"))
    expected = expected_slots(
        last.withColumn("first_ts", instant(start)), keys, step_s, cutover, ts=ts
    )
    missing = expected.join(seen, [*keys, ts], "left_anti")
    if not whole_hours:
        return missing
    # The hour in which the prefix ends: the last one, unless a gap comes before it.
    first_gap = missing.groupBy(*keys).agg(F.min(ts).alias("_gap"))
    final = (
        last.filter(F.col("last_ts") >= instant(cutover)).join(first_gap, list(keys), "left")
        .withColumn("first_ts", floor_to("last_ts", HOUR))
        .filter("_gap IS NULL OR _gap >= first_ts")
        .withColumn("last_ts", shift("first_ts", HOUR - QUARTER))
    )
    tail = spine(final.drop("_gap"), keys, QUARTER, ts).join(seen, [*keys, ts], "left_anti")
    return missing.unionByName(tail).distinct()


def contiguous_prefix(df: DataFrame, keys: Sequence[str], start, step_s: int, cutover=None,
                      whole_hours: bool = False, ts: str = "ts") -> DataFrame:
    """Rows before the first missing time of their key.

    With ``whole_hours`` a partial hour at the end of the prefix is left out as
    a whole, also when a gap ends the prefix in the middle of an hour.
    """
    missing = missing_slots(df, keys, start, step_s, cutover, whole_hours, ts)
    stop = F.min(ts)
    if whole_hours:
        first = F.min(ts)
        stop = F.when(first >= instant(cutover), floor_to(first, HOUR)).otherwise(first)
    first_gap = missing.groupBy(*keys).agg(stop.alias("_stop"))
    return (
        salted_join(df, first_gap, keys, "left")
        .filter(F.col("_stop").isNull() | (F.col(ts) < F.col("_stop"))).drop("_stop")
    )


def price_hour_slots(df: DataFrame, keys: Sequence[str], start, cutover=QUARTER_HOUR_CUTOVER,
                     ts: str = "ts", check: bool = True) -> DataFrame:
    """Missing price times per hour from ``start`` to the last hour of each key.

    An hour without rows takes the resolution of the hour before it. The points
    are first reduced to one row per hour, so the carrying window holds hours.
    """
    labelled = df.withColumn("_res", effective_resolution(df, cutover, ts))
    minute = F.minute(ts)
    hourly = labelled.groupBy(*keys, floor_to(ts, HOUR).alias("hour")).agg(
        F.min("_res").alias("resolution"), F.max("_res").alias("_high"),
        F.collect_set(minute).alias("present"), F.min(is_exact(ts, QUARTER)).alias("_aligned"),
    )
    if check:
        hourly_ok = (
            (F.col("resolution") == F.col("_high")) & F.col("_aligned")
            & F.col("resolution").isin(*RESOLUTION_SECONDS)
            & ((F.col("resolution") == "PT15M") | (F.col("present") == F.array(F.lit(0))))
        )
        ensure_none(hourly.filter(~hourly_ok), "Misaligned or mixed price hour")
    last = hourly.groupBy(*keys).agg(F.max("hour").alias("last_ts"))
    grid = spine(last.withColumn("first_ts", instant(start)), keys, HOUR, "hour")
    before = F.when(instant(start) >= instant(cutover), "PT15M").otherwise("PT60M")
    offsets = F.when(
        F.col("_carried") == "PT15M", F.array(*[F.lit(m) for m in (0, 15, 30, 45)])
    ).otherwise(F.array(F.lit(0)))
    absent = F.array_except(offsets, F.coalesce(F.col("present"), F.array().cast("array<int>")))
    hours = grid.join(hourly.select(*keys, "hour", "resolution", "present"), [*keys, "hour"], "left").withColumn(
        "_at", F.floor(epoch("hour") / HOUR))
    # the label of the nearest hour before comes from buckets of hours, not from a window over a whole series
    known = nearest_known(hours, keys, "_at", "resolution", width=50_000, before="_b", after="_a")
    return (
        known.withColumn("_carried", F.coalesce(F.col("_b.v"), before))
        .withColumn("_offset", F.explode(absent))
        .select(*keys, "hour", shift("hour", F.col("_offset") * 60).alias(ts))
    )


def contiguous_price_prefix(df: DataFrame, keys: Sequence[str], start,
                            cutover=QUARTER_HOUR_CUTOVER, ts: str = "ts",
                            check: bool = True) -> DataFrame:
    """Price rows before the first hour of their key that is not complete."""
    gaps = price_hour_slots(df, keys, start, cutover, ts, check)
    first_gap = gaps.groupBy(*keys).agg(F.min("hour").alias("_stop"))
    return (
        salted_join(df, first_gap, keys, "left")
        .filter(F.col("_stop").isNull() | (F.col(ts) < F.col("_stop"))).drop("_stop")
    )


def gap_report(df: DataFrame, keys: Sequence[str], start, step_s: int, ts: str = "ts") -> DataFrame:
    """First gap, missing count, affected hours, last contiguous time and rows kept after it.

    The missing times themselves are rows of ``missing_slots``.
    """
    missing = missing_slots(df, keys, start, step_s, ts=ts)
    gaps = missing.groupBy(*keys).agg(
        F.min(ts).alias("first_gap"), F.count("*").alias("missing_count"),
        F.countDistinct(floor_to(ts, HOUR)).alias("affected_hours"),
    )
    seen = salted_join(df.select(*keys, ts), gaps.select(*keys, "first_gap"), keys, "left")
    before = F.col("first_gap").isNull() | (F.col(ts) < F.col("first_gap"))
    rows = seen.groupBy(*keys).agg(
        F.max(F.when(before, F.col(ts))).alias("last_contiguous"), F.max(ts).alias("last_ts"),
        F.count_if(F.col(ts) > F.col("first_gap")).alias("later_rows"),
    )
    return rows.join(gaps, list(keys), "left").withColumn(
        "missing_count", F.coalesce("missing_count", F.lit(0).cast("long"))
    ).withColumn("affected_hours", F.coalesce("affected_hours", F.lit(0).cast("long")))


def infer_cadence(df: DataFrame, keys: Sequence[str], default_s: int, rows: int = 200,
                  ts: str = "ts") -> DataFrame:
    """Smallest positive step, in seconds, among the newest ``rows`` rows of each key.

    Spark limits the rows per key before the shuffle, so a task gets at most
    ``rows`` rows of a key from each input partition.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(ts))
    tail = (
        df.select(*keys, ts).withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= rows)
    )
    step = epoch(F.lag(ts).over(newest)) - epoch(ts)
    return (
        tail.withColumn("_step", step)
        .groupBy(*keys)
        .agg(F.coalesce(F.min(F.when(F.col("_step") > 0, F.col("_step"))), F.lit(default_s))
             .cast("long").alias("cadence_s"))
    )


def monthly_weather(df: DataFrame, keys: Sequence[str], means: Sequence[str],
                    sums: Sequence[str], ts: str = "ts") -> DataFrame:
    """Monthly means of some columns and sums of others."""
    return df.groupBy(*keys, F.date_trunc("month", ts).alias("month_start")).agg(
        *[F.avg(c).alias(c) for c in means],
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums],
    )


# --- horizons -----------------------------------------------------------------

HORIZONS = tuple(range(1, 25))


def horizons_long(wide: DataFrame, keys: Sequence[str], horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """``target_price_{h}h`` columns to one row per horizon."""
    pairs = F.array(*[
        F.struct(F.lit(h).alias("horizon_hours"), F.col(f"target_price_{h}h").alias("target_price"))
        for h in horizons
    ])
    return wide.select(*keys, F.inline(pairs))


def pivot_horizons(long: DataFrame, keys: Sequence[str], value: str = "target_price",
                   horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """One row per key with a ``target_price_{h}h`` column for every horizon."""
    picks = [
        F.max(F.when(F.col("horizon_hours") == h, F.col(value))).alias(f"target_price_{h}h")
        for h in horizons
    ]
    return long.groupBy(*keys).agg(*picks)
