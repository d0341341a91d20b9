"""Data-quality reports and health states, as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalars import close, is_finite, number
from tidegrid.functions.times import DAY, HOUR, elapsed_seconds, epoch, instant, is_exact, shift
from tidegrid.operators.evaluation import realized_performance
from tidegrid.operators.projection import BOUNDS, bound_violations, horizon_consistent, vocabulary_violations
from tidegrid.operators.scale import TimeFrame, salted_join, with_previous
from tidegrid.operators.stats import FAILED_STATUSES, vintage_coverage
from tidegrid.session import written

NUCLEAR_SHUTDOWN = "2023-04-15 22:00:00"  # Fixed value: nuclear output is absent from here on.
MIN_SILVER_ROWS, MIN_GOLD_ROWS = 179, 10  # Fixed values: least rows for features and for a split.


def checks_table(df: DataFrame, keys: Sequence[str], checks: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """One row per check from one aggregation: (check_name, status, failing).

    Each check is a count of failing rows and the status it gives when above zero.
    """
    facts = [
        F.struct(F.lit(name).alias("check_name"),
                 F.when(count > 0, bad).otherwise("PASSED").alias("status"), count.cast("long").alias("failing"))
        for name, (count, bad) in checks.items()]
    return df.groupBy(*keys).agg(F.array(*facts).alias("_c")).select(*keys, F.inline("_c"))


def check_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    status = "FAILED" if missing else "PASSED"
    return df.sparkSession.createDataFrame(
        [("required_columns", status, len(missing), ", ".join(missing))],
        "check_name string, status string, failing long, message string")


def check_timestamps(df: DataFrame, ts: str = "ts", keys: Sequence[str] = (), ingest_order: str | None = None,
                     width: int = 100_000) -> DataFrame:
    """Unreadable, repeated and, with an ingest sequence, out-of-order timestamps."""
    parsed = F.try_to_timestamp(ts) if dict(df.dtypes)[ts] == "string" else F.col(ts)
    per_time = df.groupBy(*keys, parsed.alias("_t")).agg(F.count("*").alias("_n"))
    report = checks_table(per_time, keys, {
        "timestamp_parseable": (F.coalesce(F.sum(F.when(F.col("_t").isNull(), F.col("_n"))), F.lit(0)), "FAILED"),
        "timestamp_unique": (F.coalesce(F.sum(F.when(F.col("_t").isNotNull(), F.col("_n") - 1)), F.lit(0)), "FAILED"),
    })
    if ingest_order is None:
        return report
    # A row is out of order when an earlier one, by ingest sequence, has a later time.
    from pyspark.sql import Window

    keys = list(keys)
    placed = df.withColumn("_b", F.floor(F.col(ingest_order) / width)).withColumn("_t", parsed)
    line = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy(*keys, "_b").agg(F.max("_t").alias("_m")).withColumn(
        "_carried", F.max("_m").over(line)).drop("_m")
    local = Window.partitionBy(*keys, "_b").orderBy(ingest_order).rowsBetween(Window.unboundedPreceding, -1)
    before = placed.withColumn("_local", F.max("_t").over(local)).join(carried, [*keys, "_b"])
    late = F.col("_t") < F.greatest("_local", "_carried")
    return report.unionByName(checks_table(before, keys, {"timestamp_order": (F.count_if(late), "FAILED")}))


def check_hourly(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", step_s: int = HOUR) -> DataFrame:
    """Grid alignment fails the check; missing grid times only warn."""
    missing = F.floor((epoch(F.max(ts)) - epoch(F.min(ts))) / step_s) + 1 - F.countDistinct(
        F.when(is_exact(ts, step_s), F.col(ts)))
    return checks_table(df, keys, {
        "exact_hours": (F.count_if(~is_exact(ts, step_s)), "FAILED"),
        "missing_hours": (missing, "WARNING"),
    })


def check_duplicates(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Whole rows that occur more than once, counted per key over all columns."""
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return checks_table(rows, keys, {"duplicate_rows": (F.sum(F.col("_n") - 1), "FAILED")})


def check_nulls(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return checks_table(df, keys, {f"null:{c}": (F.count_if(F.col(c).isNull()), "FAILED") for c in columns})


def check_numeric(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Text that is no number, and columns without any number."""
    checks = {}
    for c in columns:
        bad = F.count_if(F.col(c).isNotNull() & number(c).isNull())
        checks[f"unparseable:{c}"] = (bad, "FAILED")
        checks[f"all_null:{c}"] = (F.when(F.count(number(c)) == 0, 1).otherwise(0), "FAILED")
    return checks_table(df, keys, checks)


def check_missing_after(df: DataFrame, column: str, boundary=NUCLEAR_SHUTDOWN, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Nulls are allowed only from ``boundary`` on."""
    early = F.count_if(F.col(column).isNull() & (F.col(ts) < instant(boundary)))
    return checks_table(df, keys, {f"unexpected_null:{column}": (early, "FAILED")})


def check_rows(df: DataFrame, minimum: int, keys: Sequence[str] = (), fraction: float = 0.8) -> DataFrame:
    """Enough rows, and enough of them for a chronological split with two test rows."""
    n = F.count("*")
    train = F.floor(n * F.lit(fraction))
    return checks_table(df, keys, {
        "minimum_rows": (F.when(n < minimum, 1).otherwise(0), "FAILED"),
        "split_feasible": (F.when((train > 0) & (n - train >= 2), 0).otherwise(1), "FAILED"),
    })


def check_ranges(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Null times, nulls of the first column, and negative values of all columns."""
    checks = {f"null:{ts}": (F.count_if(F.col(ts).isNull()), "FAILED"),
              f"null:{columns[0]}": (F.count_if(F.col(columns[0]).isNull()), "FAILED")}
    checks.update({f"negative:{c}": (F.count_if(F.col(c) < 0), "FAILED") for c in columns})
    return checks_table(df, keys, checks)


# --- vintages -----------------------------------------------------------------------

def validate_vintages(df: DataFrame, keys: Sequence[str] = ("series_id", "document_id", "revision_number", "target_timestamp")) -> DataFrame:
    """Every broken rule of a forecast vintage row, one row per (vintage row, rule).

    A declared ``source_horizon_minutes`` must be finite, not negative and the
    time from creation to target; weather columns and ``horizon_hours``, where
    they are present, must lie in their ranges.
    """
    declared = "source_horizon_minutes" in df.columns
    horizon = [
        F.when(~is_finite("source_horizon_minutes") | (F.col("source_horizon_minutes") < 0), "source_horizon"),
        F.when(~F.coalesce(horizon_consistent("target_timestamp", "source_created_at_utc", "source_horizon_minutes", 60), F.lit(True)),
               "horizon_inconsistent"),
    ] if declared else []
    ranges = [bound_violations(df, keys).select(*keys, F.concat(F.lit("range:"), "column_name").alias("rule"))] if set(BOUNDS) & set(df.columns) else []
    current = F.col("collection_issue_time").isNotNull()
    allowed = vocabulary_violations(df).select(*keys).withColumn("rule", F.lit("vocabulary"))
    rules = F.array_compact(F.array(
        F.when(F.col("document_id").isNull() | F.col("revision_number").isNull() | F.col("resolution").isNull(),
               "provenance_missing"),
        F.when(~is_finite("value_mw"), "value_not_finite"),
        F.when(F.col("target_timestamp") < F.col("source_created_at_utc"), "negative_horizon"),
        F.when(current & ~is_exact("collection_issue_time"), "cycle_not_exact"),
        F.when(current & (F.col("acquired_at_utc") < F.col("source_created_at_utc")), "acquired_before_creation"),
        F.when(~F.coalesce(F.col("resolution").rlike("^PT0*[1-9][0-9]*[HMS]$"), F.lit(False)), "resolution"),
        *horizon,
    ))
    return reduce(DataFrame.unionByName, [df.select(*keys, F.explode(rules).alias("rule")), allowed, *ranges])


def check_horizons(df: DataFrame, keys: Sequence[str], horizons: int = 24, horizon: str = "horizon_hours") -> DataFrame:
    """Vintages that do not hold exactly the horizons 1..n, each once."""
    valid = F.col(horizon).between(1, horizons)
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.countDistinct(F.when(valid, F.col(horizon))).alias("valid_horizons"),
    ).filter((F.col("rows") != horizons) | (F.col("valid_horizons") != horizons))


def leakage_audit(df: DataFrame, sources: Sequence[str], features: Sequence[str], keys: Sequence[str] = (),
                  step_s: int = HOUR, horizons: int = 24) -> DataFrame:
    """Grain, time order and availability of exogenous rows, one row per check.

    Rows first collapse to their grain, so the duplicate count needs no second
    pass and a repeated key cannot pile up in one task.
    """
    keys = list(keys)
    issue, target, h = F.col("issue"), F.col("target_ts"), F.col("horizon")
    conditions = {
        "target_after_issue": target > issue,
        "horizon_derived": F.abs(elapsed_seconds(target, issue) / step_s - h) < 1e-8,
        "horizon_in_range": h.between(1, horizons),
    }
    finite = F.lit(True)
    for name in features:
        finite = finite & is_finite(name)
    conditions["features_are_finite"] = finite
    for source in sources:
        cycle, acquired = F.col(f"{source}_collection_issue_time"), F.col(f"{source}_acquired_at_utc")
        age = elapsed_seconds(acquired, cycle)
        conditions[f"{source}_not_from_later_cycle"] = cycle <= issue
        conditions[f"{source}_acquired_within_cycle"] = (age >= 0) & (age < HOUR)
    grain = df.groupBy(*keys, "issue", "target_ts", "horizon").agg(
        F.count("*").alias("_n"),
        *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"_{name}") for name, c in conditions.items()])
    checks = {"unique_row_grain": (F.sum(F.col("_n") - 1), "FAILED")}
    checks.update({name: (F.sum(f"_{name}"), "FAILED") for name in conditions})
    return checks_table(grain, keys, checks)


def issuance_audit(df: DataFrame, snapshot: Sequence[str], sources: Sequence[str], keys: Sequence[str] = ("series_id",),
                   horizons: int = 24, step_s: int = HOUR) -> DataFrame:
    """Issues whose rows are not provably available at issue time, with the broken rules."""
    issue, observed, available = F.col("issue"), F.col("issue_observed_timestamp"), F.col("observed_available_at_utc")
    calendar_ok = F.lit(True)
    for name, expected in (("target_hour", F.hour("target_ts")), ("target_day_of_week", F.weekday("target_ts")),
                           ("target_month", F.month("target_ts"))):
        if name in df.columns:
            calendar_ok = calendar_ok & (F.col(name) == expected)
    rules = {
        "observed_not_available": (shift(observed, step_s) <= available) & (available <= issue),
        "target_not_issue_plus_horizon": F.col("target_ts") == shift(issue, F.col("horizon") * step_s),
        "calendar": calendar_ok,
    }
    for s in sources:
        acquired, cycle = F.col(f"{s}_acquired_at_utc"), F.col(f"{s}_collection_issue_time")
        rules[f"{s}_acquired_late"] = (cycle <= acquired) & (acquired <= issue)
        if f"{s}_source_created_at_utc" in df.columns:
            rules[f"{s}_created_after_acquisition"] = F.col(f"{s}_source_created_at_utc") <= acquired
    facts = df.groupBy(*keys, "issue").agg(
        F.count("*").alias("_n"), F.countDistinct(F.when(F.col("horizon").between(1, horizons), F.col("horizon"))).alias("_h"),
        F.countDistinct(F.struct(*snapshot)).alias("_s"),
        *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"_{n}") for n, c in rules.items()])
    broken = F.array_compact(F.array(
        F.when((F.col("_n") != horizons) | (F.col("_h") != horizons), "incomplete_horizons"),
        F.when(F.col("_s") != 1, "several_snapshots"),
        *[F.when(F.col(f"_{n}") > 0, n) for n in rules]))
    return facts.select(*keys, "issue", F.array_join(broken, ",").alias("broken")).filter("broken <> ''")


def check_forecast(df: DataFrame, keys: Sequence[str] = ("series_id", "forecast_issue_time", "model_release"),
                   horizons: int = 24, step_s: int = HOUR) -> DataFrame:
    """Forecasts that break the contract: n rows, horizons 1..n, exact targets, finite values."""
    aligned = elapsed_seconds("target_timestamp", "forecast_issue_time") == F.col("horizon_hours") * step_s
    facts = df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.countDistinct(F.when(F.col("horizon_hours").between(1, horizons), F.col("horizon_hours"))).alias("horizons"),
        F.count_if(~F.coalesce(aligned, F.lit(False))).alias("misaligned"),
        F.count_if(~is_finite("predicted_price_eur_mwh")).alias("not_finite"))
    return facts.filter((F.col("rows") != horizons) | (F.col("horizons") != horizons)
                        | (F.col("misaligned") > 0) | (F.col("not_finite") > 0))


def recompute_audit(features: DataFrame, points: DataFrame, keys: Sequence[str] = ("series_id",), value: str = "price_eur_mwh",
                    prefix: str = "price", lags: Sequence[int] = (1, 24, 168), ts: str = "ts", rel: float = 1e-10) -> DataFrame:
    """Stored lags and rolls that differ from those recomputed from the source points."""
    frame = TimeFrame(points.select(*keys, ts, F.col(value).alias("_v")), keys, ts, back_s=max(lags) * HOUR)
    fresh = {f"{prefix}_lag_{n}h": frame.value_at("_v", -n * HOUR) for n in lags}
    fresh[f"{prefix}_rolling_mean_24h"] = frame.trailing(F.avg, "_v", 24, HOUR)
    if f"{prefix}_rolling_std_24h" in features.columns:
        fresh[f"{prefix}_rolling_std_24h"] = frame.trailing(F.stddev_samp, "_v", 24, HOUR)
    again = frame.select(**{f"_{n}": c for n, c in fresh.items()}).drop("_v")
    joined = features.join(again, [*keys, ts], "left")
    cells = F.array_compact(F.array(*[
        F.when(~F.coalesce(close(F.col(n), F.col(f"_{n}"), rel, rel), F.lit(False)),
               F.struct(F.lit(n).alias("feature"), F.col(n).alias("stored"), F.col(f"_{n}").alias("recomputed")))
        for n in fresh]))
    return joined.select(*keys, ts, F.inline(cells))


def check_pairs(pairs: DataFrame, keys: Sequence[str] = ("series_id", "model_release", "forecast_issue_time", "horizon_hours"),
                tolerance: float = 1e-7) -> DataFrame:
    """Realised pairs whose stored errors, horizon or identity are wrong."""
    error = F.col("predicted_price_eur_mwh") - F.col("actual_price_eur_mwh")

    def same(stored, value):
        bound = F.greatest(F.lit(tolerance), F.lit(tolerance) * F.greatest(F.abs(F.col(stored)), F.abs(value)))
        return F.coalesce(F.abs(F.col(stored) - value) <= bound, F.lit(False))

    rules = F.array_compact(F.array(
        F.when(~same("signed_error", error), "signed_error"),
        F.when(~same("absolute_error", F.abs(error)), "absolute_error"),
        F.when(~same("squared_error", error * error), "squared_error"),
        F.when(~horizon_consistent("target_timestamp", "forecast_issue_time", "horizon_hours"), "horizon"),
        F.when(~F.col("horizon_hours").between(1, 24), "horizon_range")))
    cells = pairs.select(*keys, F.explode(rules).alias("rule"))
    twice = pairs.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(
        *keys, F.lit("duplicate_identity").alias("rule"))
    return cells.unionByName(twice)


# --- freshness and health --------------------------------------------------------------

def freshness_label(latest: Column, now, kind: Column) -> Column:
    age = elapsed_seconds(instant(now), latest) / HOUR
    return (
        F.when(latest.isNull(), "Unavailable")
        .when(kind == "historical_weather", "Archive history")
        .when(kind.isin("silver", "gold"), "Historical dataset")
        .when(age < 0, "Future timestamp").when(age <= 3, "Fresh").when(age <= 6, "Warning").otherwise("Stale"))


def freshness(df: DataFrame, now, keys: Sequence[str] = ("source_kind",), kind: str = "source_kind", ts: str = "ts") -> DataFrame:
    """State of each source by the age of its newest row."""
    latest = df.groupBy(*keys).agg(F.max(ts).alias("latest_ts"))
    return latest.withColumn("state", freshness_label(F.col("latest_ts"), now, F.col(kind)))


SEVERITY = ("HEALTHY", "DEGRADED", "STALE", "FAILED")


def vintage_health(df: DataFrame, now, keys: Sequence[str] = ("document_type", "process_type"),
                   failures: DataFrame | None = None, cycle: str = "collection_issue_time",
                   identity: Sequence[str] = ("source", "document_type", "process_type", "document_id",
                                              "revision_number", "source_created_at_utc", "series_id",
                                              "target_timestamp", "technology"),
                   healthy_min: int = 90, stale_min: int = 180) -> DataFrame:
    """State of each vintage source from its newest cycle: age, coverage, duplicates, failures."""
    keys = list(keys)
    # read by every part below: written once, so that what leads to the rows is done and moved once
    needed = [*keys, cycle, *identity, "acquired_at_utc", "document_id", "revision_number", "technology", "resolution", "target_timestamp"]
    df = written(df.select(*dict.fromkeys(needed)))
    newest = df.groupBy(*keys).agg(F.max(cycle).alias("_cycle"))
    rows = salted_join(df, newest, keys).filter(F.col(cycle) == F.col("_cycle"))
    acquired = rows.groupBy(*keys).agg(
        F.max("acquired_at_utc").alias("latest_acquired"), F.count("*").alias("newest_rows"),
        F.max("_cycle").alias("latest_cycle"),
        F.countDistinct("document_id", "revision_number").alias("revisions"))
    group = ["document_id", "revision_number", "technology", "resolution"]
    extra = [k for k in keys if k not in group]
    slots = vintage_coverage(rows, [*extra, *group]).groupBy(*keys).agg(
        F.sum("expected_slots").alias("expected_slots"), F.sum("missing_count").alias("missing_slots"))
    repeats = df.groupBy(*identity).agg(F.count("*").alias("_n"))
    duplicates = repeats.groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("duplicates"))
    facts = acquired.join(slots, keys, "left").join(duplicates, keys, "left")
    facts = facts.join(failures, keys, "left") if failures is not None else facts.withColumn("failures", F.lit(0).cast("long"))
    facts = facts.fillna(0, ["missing_slots", "duplicates", "failures"])
    age = F.greatest(elapsed_seconds(instant(now), "latest_acquired") / 60, F.lit(0.0))
    troubled = (F.col("missing_slots") > 0) | (F.col("duplicates") > 0) | (F.col("failures") > 0)
    return facts.withColumns({
        "age_minutes": F.round(age, 3),
        "status": F.when(age > stale_min, "STALE").when((age > healthy_min) | troubled, "DEGRADED").otherwise("HEALTHY")})


def overall_status(health: DataFrame) -> DataFrame:
    """The worst state of all sources; no source at all counts as failed."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("status"))
    worst = F.coalesce(F.max(rank), F.lit(len(SEVERITY)))
    return health.agg(F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), worst.cast("int")).alias("overall_status"))


def operational_health(facts: DataFrame, now, max_forecast_age_s: int = 3 * HOUR) -> DataFrame:
    """Label and reason from one row of facts per system.

    Columns: latest_run_status, latest_success_time, oldest_core_ts (null when a
    core source is unavailable), forecast_issue_time, forecast_withheld,
    failed_checks, warning_checks, gap_count, artifacts_available.
    """
    status = F.upper(F.coalesce("latest_run_status", F.lit("")))
    success_h = elapsed_seconds(instant(now), "latest_success_time") / HOUR
    core_h = elapsed_seconds(instant(now), "oldest_core_ts") / HOUR
    forecast_age = elapsed_seconds(instant(now), "forecast_issue_time")
    fresh = F.coalesce(~F.col("forecast_withheld") & (forecast_age >= 0) & (forecast_age <= max_forecast_age_s), F.lit(False))
    old = (status != "SUCCESS") | success_h.isNull() | (success_h > 6) | (core_h > 6)
    review = (success_h > 2) | (core_h > 3) | ~fresh | (F.col("warning_checks") > 0) | (F.col("gap_count") > 0)
    reason = (
        F.when(status.isin(*FAILED_STATUSES), "latest_run_failed")
        .when(~F.col("artifacts_available") | F.col("oldest_core_ts").isNull(), "required_source_unavailable")
        .when(F.col("failed_checks") > 0, "quality_check_failed")
        .when(old, "success_or_core_data_old")
        .when(review, "condition_needs_review")
        .otherwise("current"))
    return facts.withColumn("reason", reason).withColumn(
        "label", F.when(F.col("reason") == "current", "Healthy")
        .when(F.col("reason") == "condition_needs_review", "Warning").otherwise("Degraded"))


def performance_state(pairs: DataFrame, baseline: DataFrame, now, by: Sequence[str] = ("model_release",),
                      min_pairs: int = 100, min_dates: int = 7) -> DataFrame:
    """Review recommended when the seven-day RMSE exceeds 1.5 times the test RMSE and persistence.

    ``baseline`` has (by, test_rmse, persistence_rmse).
    """
    by = list(by)
    table = realized_performance(pairs, now, by)
    facts = table.filter("scope <> 'horizon'").groupBy(*by).agg(
        F.max(F.when(F.col("scope") == "overall", F.col("pair_count"))).alias("pair_count"),
        F.max(F.when(F.col("name") == "7d", F.col("rmse"))).alias("rmse_7d"))
    dates = pairs.filter(F.col("target_timestamp") <= instant(now)).groupBy(*by).agg(
        F.countDistinct(F.date_trunc("day", "target_timestamp")).alias("target_dates"))
    joined = facts.join(dates, by).join(baseline, by, "left")
    limit = F.greatest(F.col("test_rmse") * 1.5, F.col("persistence_rmse"))
    known = F.col("test_rmse").isNotNull() & F.col("persistence_rmse").isNotNull()
    short = (F.col("pair_count") < min_pairs) | (F.col("target_dates") < min_dates) | F.col("rmse_7d").isNull()
    return joined.withColumn("state", F.when(short, "Insufficient data")
                             .when(known & (F.col("rmse_7d") > limit), "Review recommended").otherwise("Monitoring"))


def step_sizes(df: DataFrame, keys: Sequence[str], ts: str = "ts", width_s: int = 30 * DAY) -> DataFrame:
    """Every distance between consecutive distinct times, with its count."""
    times = df.select(*keys, ts).distinct()
    gap = epoch(ts) - epoch("_prev")
    return with_previous(times, keys, ts, width_s=width_s, out="_prev").filter("_prev IS NOT NULL").groupBy(
        *keys, gap.alias("step_s")).agg(F.count("*").alias("steps"))
