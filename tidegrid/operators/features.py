"""Leakage-safe features of an issue hour, chart samples, folds and event sequences."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.checks import DataContractError
from tidegrid.functions.scalars import number
from tidegrid.functions.times import HOUR, calendar, elapsed_seconds, shift
from tidegrid.operators.joins import renewable
from tidegrid.operators.merge import newest_per
from tidegrid.operators.scale import TimeFrame, ranked, salted_join
from tidegrid.session import written

WEEK = 168 * HOUR

# The feature contract, in order.
GENERATION = ("biomass_mw", "lignite_mw", "gas_mw", "hard_coal_mw", "hydro_mw", "nuclear_mw",
              "solar_mw", "wind_offshore_mw", "wind_onshore_mw", "wind_total_mw")
WEATHER = ("temperature_2m", "relative_humidity_2m", "wind_speed_10m", "cloud_cover",
           "shortwave_radiation")
CALENDAR = ("hour", "day_of_week", "month", "is_weekend")
PRICE_FEATURES = ("price_eur_mwh", "price_lag_1h", "price_lag_24h", "price_lag_168h",
                  "price_rolling_mean_24h", "price_rolling_std_24h")
LOAD_FEATURES = ("load_mw", "load_lag_1h", "load_lag_24h", "load_rolling_mean_24h")
DERIVED = ("renewable_generation_mw", "renewable_share")
FEATURES = CALENDAR + PRICE_FEATURES + LOAD_FEATURES + GENERATION + DERIVED + WEATHER
FALLBACK_FEATURES = CALENDAR + LOAD_FEATURES + GENERATION + DERIVED + WEATHER
TARGET = "target_price_next_hour"


def lag_hours(df: DataFrame, keys: Sequence[str], value: str, lags: Sequence[int], *,
              prefix: str | None = None, step_s: int = HOUR, ts: str = "ts",
              width_s: int | None = None) -> DataFrame:
    """Values exactly ``lags`` steps earlier; null when that time is absent."""
    frame = TimeFrame(df, keys, ts, back_s=max(lags) * step_s, width_s=width_s)
    name = prefix or value
    return frame.select(**{f"{name}_lag_{n}h": frame.value_at(value, -n * step_s) for n in lags})


def lead_hours(df: DataFrame, keys: Sequence[str], value: str, steps: int, out: str, *,
               step_s: int = HOUR, ts: str = "ts", width_s: int | None = None) -> DataFrame:
    frame = TimeFrame(df, keys, ts, back_s=0, fwd_s=steps * step_s, width_s=width_s)
    return frame.select(**{out: frame.value_at(value, steps * step_s)})


def rolling_mean(df: DataFrame, keys: Sequence[str], value: str, rows: int, out: str, *,
                 step_s: int = HOUR, ts: str = "ts", width_s: int | None = None) -> DataFrame:
    """Mean of the last ``rows`` steps; null unless all are present."""
    frame = TimeFrame(df, keys, ts, back_s=(rows - 1) * step_s, width_s=width_s)
    return frame.select(**{out: frame.trailing(F.avg, value, rows, step_s)})


def rolling_std(df: DataFrame, keys: Sequence[str], value: str, rows: int, out: str, *,
                step_s: int = HOUR, ts: str = "ts", width_s: int | None = None) -> DataFrame:
    """Sample standard deviation of the last ``rows`` steps; null unless all are present."""
    frame = TimeFrame(df, keys, ts, back_s=(rows - 1) * step_s, width_s=width_s)
    return frame.select(**{out: frame.trailing(F.stddev_samp, value, rows, step_s)})


def feature_table(silver: DataFrame, keys: Sequence[str] = ("series_id",), *, ts: str = "ts",
                  step_s: int = HOUR, with_price: bool = True, with_target: bool = True,
                  width_s: int | None = None) -> DataFrame:
    """Lags, rolls, calendar, renewables and next-step target, incomplete rows kept.

    Frames address exact times, so no spine is needed, and all of them share
    one shuffle and one sort per (series, time bucket).
    """
    frame = TimeFrame(silver, keys, ts, back_s=168 * step_s if with_price else 24 * step_s,
                      fwd_s=step_s if with_target else 0, width_s=width_s)
    columns: dict[str, Column] = {}
    if with_price:
        for n in (1, 24, 168):
            columns[f"price_lag_{n}h"] = frame.value_at("price_eur_mwh", -n * step_s)
        columns["price_rolling_mean_24h"] = frame.trailing(F.avg, "price_eur_mwh", 24, step_s)
        columns["price_rolling_std_24h"] = frame.trailing(F.stddev_samp, "price_eur_mwh", 24, step_s)
    for n in (1, 24):
        columns[f"load_lag_{n}h"] = frame.value_at("load_mw", -n * step_s)
    columns["load_rolling_mean_24h"] = frame.trailing(F.avg, "load_mw", 24, step_s)
    if with_target:
        columns[TARGET] = frame.value_at("price_eur_mwh", step_s)
    return renewable(frame.select(**columns), "nuclear_zero").withColumns(calendar(ts))


def build_gold(silver: DataFrame, keys: Sequence[str] = ("series_id",), *, ts: str = "ts",
               step_s: int = HOUR, width_s: int | None = None) -> DataFrame:
    """The 31 features and the next-hour target, complete rows only."""
    table = feature_table(silver, keys, ts=ts, step_s=step_s, width_s=width_s)
    wanted = [*FEATURES, TARGET]
    return table.select(*keys, ts, *wanted).na.drop(subset=wanted)


def issue_features(silver: DataFrame, keys: Sequence[str] = ("series_id",), *, ts: str = "ts",
                   step_s: int = HOUR) -> DataFrame:
    """The 31 issue-hour features without any label."""
    table = feature_table(silver, keys, ts=ts, step_s=step_s, with_target=False)
    return table.select(*keys, ts, *FEATURES).na.drop(subset=list(FEATURES))


def fallback_features(silver: DataFrame, keys: Sequence[str] = ("series_id",), *, ts: str = "ts",
                      step_s: int = HOUR) -> DataFrame:
    """The 25 features that do not depend on any price; the price is not even read."""
    inputs = silver.drop("price_eur_mwh")
    table = feature_table(inputs, keys, ts=ts, step_s=step_s, with_price=False, with_target=False)
    return table.select(*keys, ts, *FALLBACK_FEATURES).na.drop(subset=list(FALLBACK_FEATURES))


def exact_hourly_stat(df: DataFrame, anchors: DataFrame, keys: Sequence[str], value: str, hours: int,
                      fn, out: str, *, ts: str = "ts", anchor: str = "anchor") -> DataFrame:
    """``fn`` over the ``hours`` hours that end at each anchor; null unless all are present."""
    frame = TimeFrame(df.select(*keys, ts, value), keys, ts, back_s=(hours - 1) * HOUR)
    stats = frame.select(**{out: frame.trailing(fn, value, hours, HOUR)})
    return anchors.join(stats.select(*keys, F.col(ts).alias(anchor), out), [*keys, anchor], "left")


def price_comparison(hourly: DataFrame, keys: Sequence[str] = ("series_id",), value: str = "value",
                     ts: str = "ts") -> DataFrame:
    """Latest complete hour with the means of the 24 and 168 hours that end there."""
    latest = hourly.groupBy(*keys).agg(F.max(ts).alias("latest_ts"))
    tail = salted_join(hourly.select(*keys, ts, value), latest, keys).filter(
        F.col(ts) > shift("latest_ts", -WEEK)
    )
    day = F.when(F.col(ts) > shift("latest_ts", -24 * HOUR), F.col(value))
    return tail.groupBy(*keys, "latest_ts").agg(
        F.max(F.when(F.col(ts) == F.col("latest_ts"), F.col(value))).alias("latest_price"),
        F.when(F.count(day) == 24, F.avg(day)).alias("previous_24h_average"),
        F.when(F.count(value) == 168, F.avg(value)).alias("seven_day_average"),
    )


def issue_context(silver: DataFrame, issues: DataFrame, keys: Sequence[str] = ("series_id",),
                  ts: str = "ts") -> DataFrame:
    """Observed inputs at each issue hour, never those of a neighbouring hour."""
    shown = ("load_mw", "wind_total_mw", "solar_mw", "price_eur_mwh", *WEATHER)
    frame = TimeFrame(renewable(silver, "context"), keys, ts, back_s=167 * HOUR)
    stats = frame.select(
        price_rolling_mean_24h=frame.trailing(F.avg, "price_eur_mwh", 24, HOUR),
        price_rolling_std_24h=frame.trailing(F.stddev_samp, "price_eur_mwh", 24, HOUR),
        price_average_7d=frame.trailing(F.avg, "price_eur_mwh", 168, HOUR),
    ).select(
        *keys, F.col(ts).alias("issue"), *[number(c).alias(c) for c in shown], "renewable_share",
        "price_rolling_mean_24h", "price_rolling_std_24h", "price_average_7d",
        F.lit(True).alias("_found"),
    )
    return issues.join(stats, [*keys, "issue"], "left").withColumn(
        "available", F.coalesce("_found", F.lit(False))
    ).drop("_found")


# --- chart samples --------------------------------------------------------------

def downsample_extremes(df: DataFrame, keys: Sequence[str], fields: Sequence[str], max_points: int, *,
                        ts: str = "ts", width: int = 30 * 24 * HOUR) -> DataFrame:
    """First, last, lowest and highest rows of equal-count buckets, original values only.

    Nulls rank last in both directions, ties go to the earliest row. Buckets are
    reduced by aggregates of row structs, so no bucket is sorted or held whole.
    """
    keys = list(keys)
    per_bucket = 2 + 2 * len(fields)
    if max_points < per_bucket:
        raise DataContractError(f"max_points must be at least {per_bucket}")
    numbered = ranked(df, keys, ts, width=width, total="_total")
    size = F.greatest(F.ceil(F.col("_total") / (max_points // per_bucket)), F.lit(1))
    binned = numbered.withColumn("_bin", F.floor((F.col("rn") - 1) / size))
    row = F.struct(*df.columns, "rn").alias("row")
    picks = [F.min(F.struct(F.col("rn").alias("k"), row)), F.max(F.struct(F.col("rn").alias("k"), row))]
    rows = [p["row"] for p in picks]
    for field in fields:
        missing = F.col(field).isNull().cast("int")
        rows.append(F.min(F.struct(missing.alias("n"), F.col(field).alias("f"), F.col("rn").alias("k"), row))["row"])
        rows.append(F.min(F.struct(missing.alias("n"), (-F.col(field)).alias("f"), F.col("rn").alias("k"), row))["row"])
    chosen = binned.groupBy(*keys, "_bin").agg(F.array_distinct(F.array(*rows)).alias("_rows"))
    return chosen.select(F.inline("_rows"))


def gap_before(df: DataFrame, keys: Sequence[str], ts: str = "ts", step_s: int = HOUR) -> DataFrame:
    """Flag kept points whose elapsed time to the previous one exceeds their rank step.

    Meant for a chart sample, whose size is bounded by its number of points.
    """
    order = Window.partitionBy(*keys).orderBy("rn")
    steps = F.floor(elapsed_seconds(ts, F.lag(ts).over(order)) / step_s)
    gap = steps > F.col("rn") - F.lag("rn").over(order)
    return df.withColumn("gap_before", F.coalesce(gap, F.lit(False)))


def downsample_stride(df: DataFrame, keys: Sequence[str], max_points: int, *, ts: str = "ts",
                      width: int = 30 * 24 * HOUR) -> DataFrame:
    """Every n-th row and the last one, at most about ``max_points`` per key."""
    if max_points < 2:
        raise DataContractError("max_points must be at least 2")
    numbered = ranked(df, keys, ts, width=width, total="_total")
    step = F.when(F.col("_total") <= max_points, F.lit(1)).otherwise(
        F.ceil((F.col("_total") - 1) / (max_points - 1))
    )
    keep = (F.pmod(F.col("rn") - 1, step) == 0) | (F.col("rn") == F.col("_total"))
    return numbered.filter(keep).drop("_total")


# --- splits by row position -------------------------------------------------------

def holdout_split(df: DataFrame, keys: Sequence[str], fraction: float = 0.8, *, ts: str = "ts",
                  width: int = 30 * 24 * HOUR) -> DataFrame:
    """Role of each row: the first ``fraction`` of rows in time trains, the rest tests."""
    numbered = ranked(df, keys, ts, width=width, total="_total")
    train = F.col("rn") <= F.floor(F.col("_total") * F.lit(fraction))
    return numbered.withColumn("role", F.when(train, "train").otherwise("test")).drop("_total")


def time_series_folds(df: DataFrame, keys: Sequence[str], folds: int = 3, *, ts: str = "ts",
                      width: int = 30 * 24 * HOUR) -> DataFrame:
    """Boundaries and sizes of expanding folds with equal test blocks of n/(folds+1) rows."""
    numbered = ranked(df.select(*keys, ts), keys, ts, width=width, total="_total")
    test = F.floor(F.col("_total") / (folds + 1))
    at = F.col("rn") - 1
    facts = []
    for k in range(1, folds + 1):
        start = F.col("_total") - (folds - k + 1) * test
        train = at < start
        valid = (at >= start) & (at < start + test)
        facts.append(F.struct(
            F.lit(k).alias("fold"),
            F.min(F.when(train, F.col(ts))).alias("training_start"),
            F.max(F.when(train, F.col(ts))).alias("training_end"),
            F.min(F.when(valid, F.col(ts))).alias("validation_start"),
            F.max(F.when(valid, F.col(ts))).alias("validation_end"),
            F.count_if(train).alias("train_rows"), F.count_if(valid).alias("validation_rows"),
        ))
    return numbered.groupBy(*keys).agg(F.array(*facts).alias("_folds")).select(*keys, F.inline("_folds"))


def legacy_lags(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Row-based lags 1 and 3 and three-row means, null until three rows exist.

    Rows are numbered first; the windows then run over buckets of row numbers.
    """
    numbered = ranked(df, keys, ts, width=3650 * 24 * HOUR)
    frame = TimeFrame(numbered, keys, ts, back_s=3, width_s=100_000, position=F.col("rn"))

    def mean3(name):
        return F.when(frame.over(F.count(name), -2, 0) == 3, frame.over(F.avg(name), -2, 0))

    return frame.select(
        price_lag_1=frame.value_at("market_price", -1), price_lag_3=frame.value_at("market_price", -3),
        sales_lag_1=frame.value_at("electricity_sales", -1),
        price_rolling_3_month_avg=mean3("market_price"),
        sales_rolling_3_month_avg=mean3("electricity_sales"),
    ).withColumn("supply_demand_gap", F.col("supply_mw") - F.col("demand_mw")).drop("rn")


def coef_rank(df: DataFrame, model: str = "model_name", magnitude: str = "importance") -> DataFrame:
    """Dense rank of magnitude within a model (one row per feature)."""
    order = Window.partitionBy(model).orderBy(F.desc(magnitude))
    return df.withColumn("coefficient_magnitude_rank", F.dense_rank().over(order))


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key; ``order`` must be a total order."""
    return newest_per(df, keys, [F.col(c) for c in order])


# --- event sequences -----------------------------------------------------------------

def failure_streak(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("run_time", "id"),
                   failed: str = "FAILED", counted: Sequence[str] = ("FAILED", "SUCCESS")) -> DataFrame:
    """Failures since the latest run of another known outcome; runs without evidence are skipped."""
    position = F.struct(*order)
    known = df.filter(F.col("status").isin(*counted)).select(
        *keys, position.alias("_at"), (F.col("status") == failed).alias("_failed")
    )
    latest_ok = known.groupBy(*keys).agg(F.max(F.when(~F.col("_failed"), F.col("_at"))).alias("_ok"))
    compared = salted_join(known, latest_ok, keys)
    return compared.groupBy(*keys).agg(
        F.count_if(F.col("_failed") & (F.col("_ok").isNull() | (F.col("_at") > F.col("_ok")))).alias("failures")
    )


def active_incidents(df: DataFrame, keys: Sequence[str] = ("component", "event_type"),
                     order: Sequence[str] = ("run_time", "id"), active: str = "ACTIVE") -> DataFrame:
    return latest_per(df, keys, order).filter(F.col("status") == active)


NEVER = -(2**62)


def kept_path(at: np.ndarray, first: int, gap: int) -> np.ndarray:
    """Places of the kept events of sorted distinct times, from place ``first`` on, by doubling jumps."""
    jump = np.append(np.searchsorted(at, at + gap), len(at))
    path = np.array([first])
    while True:
        more = jump[path]
        if more[0] == len(at):
            break
        path = np.concatenate([path, more])
        jump = jump[jump]
    return path[path < len(at)]


class Steps(NamedTuple):
    """A step function: a chain that may keep events from ``t`` on keeps ``exits[i]`` last, for the first entry not before ``t``.

    Later than all entries, nothing is kept. The last event before a stretch
    that starts at ``start`` lies before it, so only times up to start + gap
    matter, and entries after the first one beyond them are left out.
    """

    start: int
    entries: np.ndarray
    exits: np.ndarray

    def last(self, t: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.entries, t)
        return np.where(at < len(self.entries), self.exits[np.minimum(at, len(self.exits) - 1)], otherwise)


def _trimmed(start: int, entries: np.ndarray, exits: np.ndarray, gap: int) -> Steps:
    to = int(np.searchsorted(entries, start + gap)) + 1
    entries, exits = entries[:to], exits[:to]
    ends = np.append(exits[1:] != exits[:-1], True)
    return Steps(start, entries[ends], exits[ends])


def steps_of(at: np.ndarray, gap: int) -> Steps:
    """The step function of a block of sorted distinct times."""
    following = np.searchsorted(at, at + gap)
    last = np.where(following < len(at), following, np.arange(len(at)))
    while True:
        further = last[last]
        if (further == last).all():
            return _trimmed(int(at[0]), at, at[last], gap)
        last = further


def chained(first: Steps, second: Steps, gap: int) -> Steps:
    """First one, then the other; associative, and no longer than the first plus the events within its gap."""
    exits = second.last(first.exits + gap, first.exits)
    later = second.entries > first.entries[-1]
    return _trimmed(first.start, np.concatenate([first.entries, second.entries[later]]), np.concatenate([exits, second.exits[later]]), gap)


def cooldown(df: DataFrame, keys: Sequence[str], minutes: int, ts: str = "ts", tie: str = "id",
             rows_per_block: int = 200_000, since: DataFrame | None = None) -> DataFrame:
    """Drop an event that follows the last *kept* event of its key within ``minutes``.

    The chain of kept events is sequential, but only through one number: the
    time of the last kept event. Every block of a key is reduced to a step
    function from the earliest time that may be kept to the last kept time;
    neighbours are chained pairwise, round by round, and the entry times of the
    blocks follow on the way back. No group holds more than one block or two
    functions, and a function has at most the events of one ``minutes``. Events
    at one instant keep the first. Blocks are runs of minutes with about
    ``rows_per_block`` instants. ``since`` (keys, _from in microseconds) names
    the first time that a key may keep, for chains that began earlier.
    """
    keys = list(keys)
    gap = minutes * 60 * 1_000_000
    if gap == 0:
        return df
    first = F.min(F.struct(F.col(tie).alias("t"), F.struct(*df.columns).alias("row")))["row"]
    instants = df.groupBy(*keys, F.unix_micros(ts).alias("_us")).agg(first.alias("_row"))
    minute = F.floor(F.col("_us") / 60_000_000)
    line = Window.partitionBy(*keys).orderBy("_minute")
    blocks = instants.groupBy(*keys, minute.alias("_minute")).agg(F.count("*").alias("_n")).withColumn(
        "_block", F.floor((F.sum("_n").over(line) - F.col("_n")) / rows_per_block)).drop("_n")
    # Read by the step functions, the marks and the result: written once.
    blocked = written(instants.withColumn("_minute", minute).join(blocks, [*keys, "_minute"]).drop("_minute"))
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    steps_schema = f"{key_schema}, _block long, _start long, _entries array<long>, _exits array<long>"

    def row_of(pdf: pd.DataFrame, block: int, f: Steps) -> pd.DataFrame:
        return pdf.iloc[[0]][keys].assign(_block=block, _start=f.start, _entries=[f.entries], _exits=[f.exits])

    def functions(pdf: pd.DataFrame) -> list[Steps]:
        return [Steps(int(s), np.asarray(e), np.asarray(x)) for s, e, x in zip(pdf["_start"], pdf["_entries"], pdf["_exits"], strict=True)]

    def of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        return row_of(pdf, int(pdf["_block"].iloc[0]), steps_of(np.sort(pdf["_us"].to_numpy()), gap))

    def of_two(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        two = functions(pdf)
        return row_of(pdf, int(pdf["_block"].iloc[0]) // 2, two[0] if len(two) == 1 else chained(*two, gap))

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        limits = pdf["_from"].to_numpy().copy()
        if len(pdf) == 2:
            kept = functions(pdf)[0].last(limits[:1], np.array([NEVER]))
            limits[1] = limits[0] if kept[0] == NEVER else kept[0] + gap
        return pdf[[*keys, "_block"]].assign(_from=limits)

    half = F.floor(F.col("_block") / 2)
    rounds = int(blocked.agg(F.max("_block")).first()[0] or 0).bit_length()
    begin = F.lit(NEVER).cast("long")
    start = blocked.select(*keys).distinct().withColumn("_block", F.lit(0).cast("long"))
    entry = start.withColumn("_from", begin) if since is None else start.join(since.select(*keys, "_from"), keys, "left").withColumn(
        "_from", F.coalesce("_from", begin))
    if rounds:
        levels = [written(blocked.select(*keys, "_block", "_us").groupBy(*keys, "_block").applyInPandas(of_block, steps_schema))]
        for _ in range(rounds - 1):
            levels.append(written(levels[-1].groupBy(*keys, half.alias("_half")).applyInPandas(of_two, steps_schema)))
        for level in reversed(levels):
            above = entry.select(*keys, F.col("_block").alias("_half"), "_from")
            entry = written(level.withColumn("_half", half).join(above, [*keys, "_half"]).groupBy(*keys, "_half").applyInPandas(
                back, f"{key_schema}, _block long, _from long"))

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_us")
        at = pdf["_us"].to_numpy()
        begin_at = int(np.searchsorted(at, pdf["_from"].iloc[0]))
        kept = kept_path(at, begin_at, gap) if begin_at < len(at) else []
        return pdf.iloc[kept][[*keys, "_block", "_us"]]

    kept = blocked.select(*keys, "_block", "_us").join(entry, [*keys, "_block"]).groupBy(
        *keys, "_block").applyInPandas(mark, f"{key_schema}, _block long, _us long")
    return blocked.join(kept, [*keys, "_block", "_us"], "left_semi").select("_row.*")


def missing_inputs(issues: DataFrame, hourly: DataFrame, keys: Sequence[str], lags: Sequence[int],
                   window: int = 24, ts: str = "ts") -> DataFrame:
    """Per issue hour the lag hours and the window hours that the source does not have."""
    needed = sorted({0, *lags, *range(window)})
    asked = issues.select(*keys, "issue").withColumn("_back", F.explode(F.array(*[F.lit(n) for n in needed])))
    asked = asked.withColumn(ts, shift("issue", -F.col("_back") * HOUR))
    absent = asked.join(hourly.select(*keys, ts), [*keys, ts], "left_anti")
    in_lags, in_window = F.col("_back").isin(0, *lags), F.col("_back") < window
    return absent.groupBy(*keys, "issue").agg(
        F.sort_array(F.collect_list(F.when(in_lags, F.col("_back")))).alias("missing_lag_hours"),
        F.sort_array(F.collect_list(F.when(in_window, F.col("_back")))).alias("missing_window_hours"),
    )
