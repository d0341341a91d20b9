"""Aggregations for coverage, summaries, profiles, operations and inventories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.times import DAY, HOUR, elapsed_seconds, epoch, instant, iso_duration_seconds, shift
from tidegrid.operators.gram import correlations
from tidegrid.operators.scale import exact_quantiles, salted_join, with_previous
from tidegrid.operators.series import spine


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "feature",
            value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def time_range(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Closed range; a missing bound leaves that side open."""
    if start is not None:
        df = df.filter(F.col(ts) >= instant(start))
    if end is not None:
        df = df.filter(F.col(ts) <= instant(end))
    return df


def coverage(df: DataFrame, keys: Sequence[str], step_s: int = HOUR, ts: str = "ts") -> DataFrame:
    """Rows, first and last time, and grid times missing in between."""
    span = F.floor((epoch(F.max(ts)) - epoch(F.min(ts))) / step_s) + 1
    return df.groupBy(*keys).agg(
        F.count(ts).alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        (span - F.count(ts)).alias("missing"),
    )


def market_summary(df: DataFrame, keys: Sequence[str] = (), start=None, end=None, ts: str = "ts") -> DataFrame:
    price = F.col("price_eur_mwh")
    return time_range(df, start, end, ts).groupBy(*keys).agg(
        F.count("*").alias("matched_rows"), F.avg("load_mw").alias("mean_load_mw"),
        F.min(price).alias("minimum_price"), F.max(price).alias("maximum_price"),
        F.avg(price).alias("average_price"),
        F.when(F.count(price) > 1, F.stddev_samp(price)).alias("sample_price_std"),
        F.max(ts).alias("latest_ts"),
    )


def generation_mix(df: DataFrame, sources: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and non-null count of every source, all in one scan."""
    facts = [F.struct(F.lit(s).alias("source"), F.avg(s).alias("average_mw"), F.count(s).alias("observations"))
             for s in sources]
    return df.groupBy(*keys).agg(F.array(*facts).alias("_mix")).select(*keys, F.inline("_mix"))


def anomaly_summary(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    return time_range(df, start, end, ts).agg(
        F.count("*").alias("events"), F.min(ts).alias("first_event"), F.max(ts).alias("last_event"),
        F.min("price_eur_mwh").alias("minimum_price"), F.max("price_eur_mwh").alias("maximum_price"),
        F.avg("load_mw").alias("average_load_mw"),
    )


PROFILE_QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def profile(long: DataFrame, keys: Sequence[str], value: str = "value", extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Count, moments, range and exact quantiles of a long (keys, value) table."""
    moments = long.groupBy(*keys).agg(
        F.count(value).alias("observations"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("minimum"), F.max(value).alias("maximum"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    quantiles = exact_quantiles(long, keys, value, PROFILE_QUANTILES)
    names = ("p05", "p25", "median", "p75", "p95")
    return moments.join(quantiles, list(keys), "left").withColumns(
        {n: F.get("quantiles", F.lit(i)) for i, n in enumerate(names)}).drop("quantiles")


def period_label(ts: Column | str, validation_start, test_start) -> Column:
    column = F.col(ts) if isinstance(ts, str) else ts
    return (F.when(column < instant(validation_start), "train")
            .when(column < instant(test_start), "validation").otherwise("test"))


def price_drift(df: DataFrame, validation_start, test_start, keys: Sequence[str] = (), value: str = "price_eur_mwh",
                ts: str = "ts") -> DataFrame:
    """Price profile by period with its span and its share of negative and high hours."""
    labelled = df.withColumn("period", period_label(ts, validation_start, test_start))
    return profile(labelled, [*keys, "period"], value, {
        "start_ts": F.min(ts), "end_ts": F.max(ts),
        "negative_price_pct": F.avg((F.col(value) < 0).cast("double")) * 100,
        "price_gte_200_pct": F.avg((F.col(value) >= 200).cast("double")) * 100,
    })


def feature_drift(df: DataFrame, columns: Sequence[str], validation_start, test_start, ts: str = "ts") -> DataFrame:
    labelled = df.withColumn("period", period_label(ts, validation_start, test_start))
    return profile(unpivot(labelled, ["period"], columns), ["period", "feature"])


def monthly_profile(df: DataFrame, validation_start, test_start, keys: Sequence[str] = (),
                    value: str = "price_eur_mwh", ts: str = "ts") -> DataFrame:
    """Monthly mean, exact median and count within each period."""
    labelled = df.withColumns({"period": period_label(ts, validation_start, test_start),
                               "month": F.date_format(ts, "yyyy-MM")})
    by = [*keys, "period", "month"]
    means = labelled.groupBy(*by).agg(F.avg(value).alias("monthly_mean"), F.count(value).alias("observations"))
    medians = exact_quantiles(labelled, by, value, [0.5])
    return means.join(medians, by, "left").withColumn("monthly_median", F.col("quantiles")[0]).drop("quantiles")


def yearly_profile(df: DataFrame, holdout, value: str = "target", target_ts: str = "target_ts",
                   keys: Sequence[str] = ()) -> DataFrame:
    """Price statistics per target year before the holdout instant."""
    past = df.filter(F.col(target_ts) < instant(holdout)).withColumn("year", F.year(target_ts))
    by = [*keys, "year"]
    stats = past.groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.count_if(F.col(value) < 0).alias("negative_price_count"),
        F.count_if(F.col(value) >= 200).alias("prices_ge_200_count"),
    )
    return stats.join(exact_quantiles(past, by, value, [0.5]), by, "left").withColumn(
        "median", F.col("quantiles")[0]).drop("quantiles")


def seasonal_median(hourly: DataFrame, now, keys: Sequence[str] = ("series_id",), value: str = "value",
                    days: int = 14, minimum: int = 7, ts: str = "ts") -> DataFrame:
    """Median by hour of day over the last ``days`` days of each series that ended before ``now``.

    Returned only for series with all 24 hours and at least ``minimum`` values
    in each. A group holds at most ``days`` values.
    """
    past = hourly.filter((F.col(ts) < F.date_trunc("hour", instant(now))) & F.col(value).isNotNull())
    latest = past.groupBy(*keys).agg(F.max(ts).alias("latest_ts"))
    tail = salted_join(past.select(*keys, ts, value), latest, keys).filter(
        F.col(ts) >= shift("latest_ts", HOUR - days * DAY))
    by_hour = tail.groupBy(*keys, "latest_ts", F.hour(ts).alias("hour")).agg(
        F.median(value).alias("median"), F.count(value).alias("samples"))
    whole = Window.partitionBy(*keys)
    gated = by_hour.withColumns({"_hours": F.count("*").over(whole), "_least": F.min("samples").over(whole)})
    return gated.filter((F.col("_hours") == 24) & (F.col("_least") >= minimum)).drop("_hours", "_least")


def forecast_summary(df: DataFrame, now, keys: Sequence[str] = ("series_id", "forecast_issue_time", "model_release"),
                     horizons: int = 24) -> DataFrame:
    """Range, mean, median, change and counts of complete forecasts of ``horizons`` rows."""
    price, h, target = F.col("predicted_price_eur_mwh"), F.col("horizon_hours"), F.col("target_timestamp")
    facts = df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count(price).alias("_n"),
        F.countDistinct(h).alias("_h"),
        F.count_if(target > instant(now)).alias("forward_looking_rows"),
        F.min(F.struct(price.alias("p"), h.alias("h"), target.alias("t"))).alias("_low"),
        F.max(F.struct(price.alias("p"), (-h).alias("h"), target.alias("t"))).alias("_high"),
        F.avg(price).alias("average"), F.median(price).alias("median"),
        F.max(F.struct(h.alias("h"), price.alias("p"))).alias("_last"),
        F.min(F.struct(h.alias("h"), price.alias("p"))).alias("_first"),
        F.count_if(price < 0).alias("negative_hours"), F.count_if(price >= 200).alias("elevated_hours"),
    ).filter((F.col("rows") == horizons) & (F.col("_n") == horizons) & (F.col("_h") == horizons))
    return facts.select(
        *keys, "rows", "forward_looking_rows", F.col("_low.p").alias("minimum"),
        F.col("_low.t").alias("minimum_time"), F.col("_high.p").alias("maximum"),
        F.col("_high.t").alias("maximum_time"), "average", "median",
        (F.col("_last.p") - F.col("_first.p")).alias("first_to_last_change"),
        "negative_hours", "elevated_hours",
    )


def max_abs_corr(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Largest absolute correlation of each column with any other, from one scan of matrix products.

    Null for a column without a correlation (constant, or the only one).
    """
    pairs = correlations(df, columns)
    sides = F.explode(F.array("a", "b")).alias("feature")
    best = pairs.select(sides, F.abs("correlation").alias("c")).groupBy("feature").agg(F.max("c").alias("max_absolute_correlation"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(best, "feature", "left")


# --- inventories ------------------------------------------------------------------

def reason_counts(df: DataFrame, reasons: str = "reasons", keys: Sequence[str] = ()) -> DataFrame:
    """How many rows carry each reason."""
    return df.select(*keys, F.explode(F.array_distinct(reasons)).alias("reason")).groupBy(
        *keys, "reason").agg(F.count("*").alias("rows"))


def vintage_inventory(df: DataFrame, keys: Sequence[str] = ("series_id", "process_type")) -> DataFrame:
    """Rows, distinct documents and revisions, and the technologies and resolutions present.

    The two lists hold values of controlled vocabularies.
    """
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.countDistinct("document_id", "revision_number").alias("revisions"),
        F.array_join(F.sort_array(F.collect_set("technology")), ",").alias("technologies"),
        F.array_join(F.sort_array(F.collect_set("resolution")), ",").alias("resolutions"),
        F.min("target_timestamp").alias("target_start"), F.max("target_timestamp").alias("target_end"),
    )


def raw_watermark(sources: Mapping[str, DataFrame], ts: str = "ts") -> DataFrame:
    """The least of the newest times of the sources that have rows."""
    newest = None
    for name, df in sources.items():
        one = df.agg(F.max(ts).alias("latest_ts")).select(F.lit(name).alias("source"), "latest_ts")
        newest = one if newest is None else newest.unionByName(one)
    return newest.agg(F.min("latest_ts").alias("watermark"))


def row_deltas(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame], ts: str = "ts") -> DataFrame:
    """New rows per source, counting rows whose timestamp can be read, never below zero."""
    def counts(tables, name):
        out = None
        for source, df in tables.items():
            readable = F.col(ts).isNotNull() if dict(df.dtypes)[ts] != "string" else F.try_to_timestamp(ts).isNotNull()
            one = df.agg(F.count_if(readable).alias(name)).select(F.lit(source).alias("source"), name)
            out = one if out is None else out.unionByName(one)
        return out

    return counts(before, "rows_before").join(counts(after, "rows_after"), "source").withColumn(
        "new_rows", F.greatest(F.col("rows_after") - F.col("rows_before"), F.lit(0)))


def vintage_coverage(df: DataFrame, keys: Sequence[str] = ("document_id", "revision_number", "technology", "resolution"),
                     listed: int = 24, target: str = "target_timestamp") -> DataFrame:
    """Expected, observed and missing target slots of every vintage group.

    Missing slots come from a spine and an anti join; only the first
    ``listed`` of a group are named, the count is of all.
    """
    keys = list(keys)
    step = iso_duration_seconds("resolution")
    group = [F.col(k) for k in keys]
    seen = df.filter(F.col(target).isNotNull()).select(*group, target).distinct()
    groups = seen.groupBy(*keys).agg(
        F.min(target).alias("first_ts"), F.max(target).alias("last_ts"), F.count("*").alias("observed_slots"))
    expected = F.floor((epoch("last_ts") - epoch("first_ts")) / step) + 1
    on_grid = F.pmod(epoch(target) - epoch("first_ts"), step) == 0
    # a group is one vintage, as fine as a document: joined by its keys as they are
    placed = seen.join(groups.select(*keys, "first_ts"), keys).groupBy(*keys).agg(
        F.count_if(on_grid).alias("_hit"))
    absent = None
    for text, seconds in (("PT15M", 900), ("PT60M", 3600)):
        part = groups.filter(F.col("resolution") == text)
        slots = spine(part.select(*keys, "first_ts", "last_ts"), keys, seconds, target)
        gap = slots.join(seen, [*keys, target], "left_anti")
        absent = gap if absent is None else absent.unionByName(gap)
    first_few = Window.partitionBy(*keys).orderBy(target)
    named = absent.withColumn("_n", F.row_number().over(first_few)).filter(F.col("_n") <= listed)
    lists = named.groupBy(*keys).agg(F.sort_array(F.collect_list(target)).alias("missing_slots"))
    return (
        groups.join(placed, keys).join(lists, keys, "left")
        .withColumn("expected_slots", expected.cast("long"))
        .withColumn("missing_count", F.col("expected_slots") - F.col("_hit"))
        .withColumn("coverage_complete", (F.col("missing_count") == 0) & (F.col("expected_slots") > 0))
        .drop("_hit")
    )


def readiness(df: DataFrame, keys: Sequence[str] = (), min_cycles: int = 14, min_days: int = 7,
              horizons: int = 24, issue: str = "issue", horizon: str = "horizon") -> DataFrame:
    """Complete cycles, distinct cycles and days, missing horizons, duplicates, status."""
    keys = list(keys)
    cells = df.groupBy(*keys, issue, horizon).agg(F.count("*").alias("_c"))
    cycles = cells.groupBy(*keys, issue).agg(
        F.sum("_c").alias("_rows"), F.count("*").alias("_distinct"),
        F.count_if(F.col(horizon).between(1, horizons)).alias("_valid"),
        F.sum(F.col("_c") - 1).alias("_dup"),
    )
    complete = (F.col("_rows") == horizons) & (F.col("_valid") == horizons) & (F.col("_distinct") == horizons)
    day = F.date_trunc("day", F.col(issue))
    wanted = F.sequence(F.lit(1), F.lit(horizons))
    present = cells.groupBy(*keys).agg(
        F.collect_set(F.when(F.col(horizon).between(1, horizons), F.col(horizon).cast("int"))).alias("_present"))
    totals = cycles.groupBy(*keys).agg(
        F.count_if(complete).alias("complete_cycles"), F.count("*").alias("distinct_cycles"),
        F.countDistinct(day).alias("distinct_days"), F.sum("_dup").alias("duplicate_rows"),
    )
    joined = totals.join(present, keys) if keys else totals.withColumn("_k", F.lit(1)).join(
        present.withColumn("_k", F.lit(1)), "_k").drop("_k")
    facts = joined.withColumn("missing_horizons", F.size(F.array_except(wanted, F.col("_present")))).drop("_present")
    return facts.withColumn("status", readiness_status(min_cycles, min_days))


def readiness_status(min_cycles: int = 14, min_days: int = 7) -> Column:
    broken = (F.col("complete_cycles") == 0) | (F.col("duplicate_rows") > 0)
    short = ((F.col("distinct_cycles") < min_cycles) | (F.col("distinct_days") < min_days)
             | (F.col("missing_horizons") > 0))
    return F.when(broken, "NOT_READY").when(short, "PARTIALLY_READY").otherwise("READY_FOR_EVALUATION")


def profile_source(df: DataFrame, keys: Sequence[str], columns: Sequence[str], ts: str = "ts",
                   width_s: int = 30 * DAY) -> DataFrame:
    """Rows, span, nulls per column, rows that share a time, and the steps between times."""
    keys = list(keys)
    per_time = df.groupBy(*keys, ts).agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in columns])
    steps = with_previous(per_time, keys, ts, width_s=width_s, out="_prev")
    gap = epoch(ts) - epoch("_prev")
    return steps.groupBy(*keys).agg(
        F.sum("_rows").alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        *[F.sum(f"_null_{c}").alias(f"nulls_{c}") for c in columns],
        F.sum(F.when(F.col("_rows") > 1, F.col("_rows")).otherwise(0)).alias("duplicate_time_rows"),
        F.countDistinct(gap).alias("distinct_steps"), F.min(gap).alias("least_step_s"),
        F.max(gap).alias("largest_step_s"),
    )


def document_inventory(points: DataFrame, keys: Sequence[str] = ("document_id", "period_id")) -> DataFrame:
    """Points, position range, repeated positions and target range of every period."""
    step = iso_duration_seconds("resolution")

    def at(position):
        return shift("period_start", (position - 1) * step)

    return points.groupBy(*keys, "period_start", "period_end", "resolution").agg(
        F.count("*").alias("point_count"), F.min("position").alias("position_min"),
        F.max("position").alias("position_max"),
        (F.count("position") - F.countDistinct("position")).alias("duplicate_positions"),
    ).withColumns({"first_target": at(F.col("position_min")), "last_target": at(F.col("position_max"))}).drop(
        "period_start", "period_end", "resolution")


# --- operations -----------------------------------------------------------------------

FAILED_STATUSES = ("FAILED", "FAILURE", "ERROR")


def quality_state(df: DataFrame, excluded: Sequence[str], excluded_prefixes: Sequence[str],
                  order: Sequence[str] = ("check_time", "id")) -> DataFrame:
    """Failed and warning counts over the latest result of every current check.

    Excluded checks are judged from the latest run; their old rows are history.
    """
    current = df.filter(~F.col("check_name").isin(*excluded))
    for prefix in excluded_prefixes:
        current = current.filter(~F.col("check_name").startswith(prefix))
    latest = current.groupBy("check_name").agg(F.max(F.struct(*order, "status"))["status"].alias("_s"))
    status = F.upper(F.coalesce("_s", F.lit("")))
    return latest.agg(F.count_if(status.isin(*FAILED_STATUSES)).alias("failed"),
                      F.count_if(status == "WARNING").alias("warnings"))


def status_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    status = F.upper(F.coalesce("status", F.lit("")))
    return df.groupBy(*keys).agg(
        F.count_if(status.isin("PASSED", "SUCCESS")).alias("passed"),
        F.count_if(status.isin(*FAILED_STATUSES)).alias("failed"),
        F.count_if(status == "WARNING").alias("warnings"))


def timing_summary(df: DataFrame, keys: Sequence[str] = (), total_stage: str = "Total pipeline",
                   forecast_stage: str = "Next24h forecast generation", newest: int = 10) -> DataFrame:
    """Latest total, mean of the newest successful totals, forecast and slowest stage of the latest run.

    The newest totals per key are limited before the shuffle.
    """
    keys = list(keys)
    join_keys = keys or ["_k"]
    source = df if keys else df.withColumn("_k", F.lit(1))
    totals = source.filter(F.col("stage_name") == total_stage)
    latest = totals.groupBy(*join_keys).agg(
        F.max(F.struct("id", "run_id", "duration_seconds")).alias("_t")).select(
        *join_keys, F.col("_t.run_id").alias("run_id"), F.col("_t.duration_seconds").alias("latest_total_seconds"))
    order = Window.partitionBy(*join_keys).orderBy(F.desc("id"))
    average = (
        totals.filter("status = 'SUCCESS'").withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= newest).groupBy(*join_keys)
        .agg(F.avg("duration_seconds").alias("recent_average_seconds"))
    )
    stages = source.join(latest, [*join_keys, "run_id"]).groupBy(*join_keys).agg(
        F.max(F.when(F.col("stage_name") == forecast_stage, F.struct("id", "duration_seconds")))
        ["duration_seconds"].alias("latest_forecast_seconds"),
        F.max(F.when(F.col("stage_name") != total_stage, F.struct("duration_seconds", "id", "stage_name")))
        ["stage_name"].alias("slowest_stage"),
    )
    out = latest.join(average, join_keys, "left").join(stages, join_keys, "left")
    return out if keys else out.drop("_k")


def advanced_quality(df: DataFrame, today, keys: Sequence[str] = ("series_id",), value: str = "market_price",
                     ts: str = "ts", sigmas: float = 3.0, checks: int = 7) -> DataFrame:
    """Outliers beyond three standard deviations, days since the last row, score of seven checks."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"),
                                  F.max(ts).alias("latest_ts"))
    joined = salted_join(df, stats, keys)
    outside = F.abs(F.col(value) - F.col("_mean")) > F.lit(sigmas) * F.col("_std")
    facts = joined.groupBy(*keys, "latest_ts").agg(
        F.count("*").alias("rows"), F.count_if((F.col("_std") > 0) & outside).alias("outliers"),
        F.count_if(F.col(value).isNull()).alias("null_values"), F.count_if(F.col(value) < 0).alias("negative_values"))
    age = F.floor(elapsed_seconds(instant(today), "latest_ts") / DAY)
    failed = ((F.col("outliers") > 0).cast("int") + (F.col("null_values") > 0).cast("int")
              + (F.col("negative_values") > 0).cast("int"))
    return facts.withColumns({
        "days_old": age, "freshness": F.when(age > 120, "WARNING").otherwise("PASSED"),
        "quality_score": (F.lit(checks) - failed) / F.lit(float(checks)) * 100,
    })


