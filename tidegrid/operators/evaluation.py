"""Forecast errors, baselines, folds, purged splits and selection tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.checks import DataContractError, ensure_none
from tidegrid.functions.scalars import REGIMES, is_finite, price_regime
from tidegrid.functions.times import DAY, HOUR, elapsed_seconds, instant, shift
from tidegrid.operators.scale import TimeFrame, salted_join

# Elapsed steps between a target and the value that predicts it.
BASELINES = {"Persistence Baseline": 1, "Daily Seasonal Naive": 24, "Weekly Seasonal Naive": 168}
SEASONAL = ("Daily Seasonal Naive", "Weekly Seasonal Naive")


# --- error metrics ---------------------------------------------------------------

def error_moments(df: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Additive error sums of the finest groups; coarser groups add these up.

    The spread of the actual values is kept as a centred second moment, which
    stays exact where sums of squares would cancel.
    """
    y, e = F.col(actual), F.col(predicted) - F.col(actual)
    pairs = df.filter(y.isNotNull() & F.col(predicted).isNotNull())
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.abs(e)).alias("abs_sum"), F.sum(e * e).alias("sq_sum"),
        F.sum(e).alias("err_sum"), F.avg(y).alias("y_mean"), (F.var_pop(y) * F.count("*")).alias("y_m2"),
    )


def with_level(moments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Moment rows with the mean of one row of their group, which ``combine_moments`` measures from."""
    return moments.withColumn("y_level", F.min("y_mean").over(Window.partitionBy(*by)))


def combine_moments() -> list[Column]:
    """Metrics of a group of moment rows: n, mae, rmse, r2, bias.

    Means are taken from ``y_level``, so that large values do not cancel.
    """
    n = F.sum("n")
    off = F.col("y_mean") - F.col("y_level")
    mean = F.sum(F.col("n") * off) / n
    between = F.sum(F.col("n") * off * off) - n * mean * mean
    spread = F.sum("y_m2") + F.greatest(between, F.lit(0.0))
    squares = F.sum("sq_sum")
    return [
        n.alias("observations"), (F.sum("abs_sum") / n).alias("mae"), F.sqrt(squares / n).alias("rmse"),
        (1 - squares / F.nullif(spread, F.lit(0.0))).alias("r2"), (F.sum("err_sum") / n).alias("bias"),
    ]


def error_metrics(df: DataFrame, by: Sequence[str] = (), actual: str = "actual",
                  predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE, R2 against the slice's own mean, and bias (predicted minus actual)."""
    fine = error_moments(df, by, actual, predicted).withColumn("y_level", F.col("y_mean"))  # one row per group
    return fine.groupBy(*by).agg(*combine_moments())


def metrics_by_horizon(df: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted",
                       horizon: str = "horizon_hours") -> DataFrame:
    """Metrics per horizon and, as horizon 0, over all horizons.

    The facts are reduced once per horizon; the grouping sets run on that table.
    """
    fine = with_level(error_moments(df, [*by, horizon], actual, predicted), by)
    sets = [[F.col(c) for c in (*by, horizon)], [F.col(c) for c in by]]
    grouped = fine.groupingSets(sets, *[F.col(c) for c in (*by, horizon)]).agg(
        F.grouping(horizon).alias("_all"), *combine_moments())
    return grouped.withColumn(
        horizon, F.when(F.col("_all") == 1, F.lit(0)).otherwise(F.col(horizon))).drop("_all")


def extreme_metrics(df: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Errors of negative and of high (200 and above) hours; an empty regime keeps its row."""
    y, e = F.col(actual), F.col(predicted) - F.col(actual)
    facts = []
    for label, inside in (("negative_price", y < 0), ("extreme_high_price", y >= 200)):
        err = F.when(inside, e)
        facts.append(F.struct(
            F.lit(label).alias("price_regime"), F.count(err).alias("observations"),
            F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(err).alias("bias")))
    return df.groupBy(*by).agg(F.array(*facts).alias("_r")).select(*by, F.inline("_r"))


def regime_performance(df: DataFrame, by: Sequence[str] = ("model_name", "feature_group"),
                       period: str = "validation_period", all_label: str = "All Development Folds") -> DataFrame:
    """Errors by regime within each period and over all periods, all four regimes always listed."""
    fine = error_moments(df.withColumn("price_regime", price_regime("actual")), [*by, period, "price_regime"])
    keys = [*by, period, "price_regime"]
    sets = [[F.col(c) for c in keys], [F.col(c) for c in (*by, "price_regime")]]
    n = F.sum("n")
    metrics = fine.groupingSets(sets, *[F.col(c) for c in keys]).agg(
        F.grouping(period).alias("_all"), n.alias("observation_count"), (F.sum("abs_sum") / n).alias("mae"),
        F.sqrt(F.sum("sq_sum") / n).alias("rmse"), (F.sum("err_sum") / n).alias("mean_signed_error_bias"))
    metrics = metrics.withColumn(
        period, F.when(F.col("_all") == 1, F.lit(all_label)).otherwise(F.col(period).cast("string"))).drop("_all")
    spine = metrics.select(*by, period).distinct().withColumn(
        "price_regime", F.explode(F.array(*[F.lit(r) for r in REGIMES])))
    return spine.join(metrics, keys, "left").withColumn(
        "observation_count", F.coalesce("observation_count", F.lit(0).cast("long")))


def gain_pct(baseline: Column, model: Column) -> Column:
    """RMSE reduction against a baseline in percent."""
    return (baseline - model) / F.nullif(baseline, F.lit(0.0)) * 100.0


def rmse_gain(df: DataFrame, period: str = "validation_period", check: bool = True) -> DataFrame:
    """Gain of every model against persistence and the better seasonal baseline of its period."""
    if check:
        base = df.filter(F.col("model_name").isin(*BASELINES) & (F.col("rmse") <= 0))
        ensure_none(base, "Baseline RMSE must be positive")
    seasonal = F.when(F.col("model_name").isin(*SEASONAL), F.col("rmse"))
    persistence = F.when(F.col("model_name") == "Persistence Baseline", F.col("rmse"))
    whole = Window.partitionBy(period)
    own = ~F.col("model_name").isin(*BASELINES)
    return df.withColumns({
        "rmse_improvement_vs_persistence_pct": F.when(own, gain_pct(F.max(persistence).over(whole), F.col("rmse"))),
        "rmse_improvement_vs_best_seasonal_pct": F.when(own, gain_pct(F.min(seasonal).over(whole), F.col("rmse"))),
    })


def fold_aggregate(df: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """Mean errors over folds with population spread, extremes and mean gains."""
    gains = [F.avg(c).alias(f"mean_{c}") for c in df.columns if c.startswith("rmse_improvement_vs_")]
    return df.groupBy(*by).agg(
        F.count("*").alias("validation_periods"), F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse"),
        F.stddev_pop("rmse").alias("rmse_std"), F.min("rmse").alias("min_rmse"), F.max("rmse").alias("max_rmse"), *gains)


def nested_aggregate(metrics: DataFrame, extremes: DataFrame, by: Sequence[str] = ("strategy",),
                     regime: str = "extreme_high_price") -> DataFrame:
    """Fold summary of a strategy with its pooled RMSE over high-price hours.

    A group holds the folds of one strategy, so the exact median is small.
    """
    overall = metrics.filter("horizon_hours = 0").groupBy(*by).agg(
        F.countDistinct("fold_id").alias("fold_count"), F.avg("rmse").alias("mean_rmse"),
        F.median("rmse").alias("median_rmse"), F.stddev_pop("rmse").alias("rmse_std"),
        F.max("rmse").alias("worst_fold_rmse"), F.avg(F.abs("bias")).alias("mean_absolute_bias"),
        F.max(F.abs("bias")).alias("worst_absolute_bias"))
    n = F.sum("observations")
    high = extremes.filter(F.col("price_regime") == regime).groupBy(*by).agg(
        n.alias("high_price_observations"),
        F.sqrt(F.sum(F.col("observations") * F.col("rmse") * F.col("rmse")) / F.nullif(n, F.lit(0)))
        .alias("high_price_rmse"))
    return overall.join(high, list(by), "left")


def ablation_aggregate(df: DataFrame, group_order: Sequence[str], persistence_rmse: Column | float,
                       by: str = "model_name") -> DataFrame:
    """Mean errors per cumulative feature group with gains against the group before and the first one."""
    position = F.array_position(F.array(*[F.lit(g) for g in group_order]), F.col("feature_group"))
    means = df.groupBy(by, "feature_group").agg(
        F.max("feature_count").alias("feature_count"), F.count("*").alias("validation_periods"),
        F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("rmse_std"))
    line = Window.partitionBy(by).orderBy(position)
    base = persistence_rmse if isinstance(persistence_rmse, Column) else F.lit(persistence_rmse)
    return means.withColumns({
        "improvement_vs_previous_feature_group_pct": gain_pct(F.lag("mean_rmse").over(line), F.col("mean_rmse")),
        "improvement_vs_time_only_pct": gain_pct(F.first("mean_rmse").over(line), F.col("mean_rmse")),
        "improvement_vs_persistence_baseline_pct": gain_pct(base, F.col("mean_rmse")),
    })


# --- live performance -------------------------------------------------------------

WINDOWS = {"24h": DAY, "7d": 7 * DAY, "30d": 30 * DAY}


def realized_performance(pairs: DataFrame, now, by: Sequence[str] = ("model_release",), min_pairs: int = 20,
                         min_horizon_pairs: int = 5, horizons: int = 24) -> DataFrame:
    """Metrics overall, in three windows that end at ``now``, and per horizon (all of them listed).

    Windows count by target time. The pairs are reduced once by (key, horizon,
    age class); windows and horizons add up those rows. Small samples keep
    their count but no metrics.
    """
    by = list(by)
    usable = pairs.filter(
        (F.col("forecast_issue_time") < F.col("target_timestamp"))
        & (F.col("issued_at_utc") < F.col("target_timestamp"))
        & (F.col("target_timestamp") <= instant(now))
        & is_finite("signed_error") & is_finite("absolute_error") & is_finite("squared_error"))
    age = elapsed_seconds(instant(now), "target_timestamp")
    cls = (F.when(age < DAY, 1).when(age < 7 * DAY, 2).when(age < 30 * DAY, 3).otherwise(4))
    sums = usable.groupBy(*by, "horizon_hours", cls.alias("_age")).agg(
        F.count("*").alias("n"), F.sum("absolute_error").alias("a"),
        F.sum("squared_error").alias("s"), F.sum("signed_error").alias("e"))
    scopes = [F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("name"))]
    for limit, name in enumerate(WINDOWS, 1):
        scopes.append(F.when(F.col("_age") <= limit, F.struct(F.lit("window").alias("scope"), F.lit(name).alias("name"))))
    scopes.append(F.struct(F.lit("horizon").alias("scope"), F.col("horizon_hours").cast("string").alias("name")))
    totals = (
        sums.withColumn("_s", F.explode(F.array_compact(F.array(*scopes))))
        .groupBy(*by, F.col("_s.scope").alias("scope"), F.col("_s.name").alias("name"))
        .agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("s").alias("s"), F.sum("e").alias("e"))
    )
    listed = [("overall", "all"), *[("window", n) for n in WINDOWS], *[("horizon", str(h)) for h in range(1, horizons + 1)]]
    spine = sums.select(*by).distinct().withColumn("_l", F.explode(F.array(*[
        F.struct(F.lit(a).alias("scope"), F.lit(b).alias("name")) for a, b in listed]))).select(*by, "_l.*")
    out = spine.join(totals, [*by, "scope", "name"], "left")
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    enough = n >= F.when(F.col("scope") == "horizon", min_horizon_pairs).otherwise(min_pairs)
    return out.select(
        *by, "scope", "name", n.alias("pair_count"),
        F.when(enough, F.col("a") / n).alias("mae"), F.when(enough, F.sqrt(F.col("s") / n)).alias("rmse"),
        F.when(enough, F.col("e") / n).alias("bias"),
        F.when(enough, "Available").otherwise("Insufficient data").alias("status"))


def monitoring_metrics(pairs: DataFrame, by: Sequence[str] = ("model_release",), min_observations: int = 5,
                       rolling: int = 168, tie: Sequence[str] = ("series_id",)) -> DataFrame:
    """Metrics overall (horizon 0) and per horizon, also over the newest ``rolling`` pairs.

    Spark keeps only the newest rows of a group before it shuffles them.
    """
    if min_observations < 1 or rolling < min_observations:
        raise DataContractError("Monitoring sample thresholds are invalid")
    by = list(by)
    sums = pairs.groupBy(*by, "horizon_hours").agg(
        F.count("*").alias("n"), F.sum("absolute_error").alias("a"), F.sum("squared_error").alias("s"),
        F.sum("signed_error").alias("e"))

    def scoped(df):
        both = F.array(F.lit(0), F.col("horizon_hours"))
        return df.withColumn("horizon_hours", F.explode(both))

    whole = scoped(sums).groupBy(*by, "horizon_hours").agg(
        F.sum("n").alias("observations"), (F.sum("a") / F.sum("n")).alias("mae"),
        F.sqrt(F.sum("s") / F.sum("n")).alias("rmse"), (F.sum("e") / F.sum("n")).alias("bias"))
    newest = [F.desc("target_timestamp"), F.desc("forecast_issue_time"), *[F.desc(c) for c in tie]]
    columns = [*by, "horizon_hours", "absolute_error", "squared_error", "signed_error"]

    def tail(keys, scope):
        order = Window.partitionBy(*keys).orderBy(*newest)
        kept = pairs.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= rolling)
        return kept.select(*columns) if scope is None else kept.select(*columns).withColumn("horizon_hours", F.lit(scope))

    recent = tail([*by, "horizon_hours"], None).unionByName(tail(by, 0)).groupBy(*by, "horizon_hours").agg(
        F.count("*").alias("rolling_window"), F.avg("absolute_error").alias("rolling_mae"),
        F.sqrt(F.avg("squared_error")).alias("rolling_rmse"), F.avg("signed_error").alias("rolling_bias"))
    return whole.filter(F.col("observations") >= min_observations).join(recent, [*by, "horizon_hours"]).withColumn(
        "scope", F.when(F.col("horizon_hours") == 0, "overall").otherwise("horizon"))


# --- baselines and folds ------------------------------------------------------------

def baselines(df: DataFrame, keys: Sequence[str] = ("series_id",), value: str = "price_eur_mwh", *,
              step_s: int = HOUR, ts: str = "ts") -> DataFrame:
    """Actual next value and the three naive predictions of it, by exact elapsed time."""
    frame = TimeFrame(df, keys, ts, back_s=167 * step_s, fwd_s=step_s)
    return frame.select(
        target_ts=shift(ts, step_s), actual=frame.value_at(value, step_s),
        persistence=F.col(value), daily=frame.value_at(value, -23 * step_s),
        weekly=frame.value_at(value, -167 * step_s))


def baselines_long(wide: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    pairs = F.array(*[
        F.struct(F.lit(name).alias("model_name"), F.col(c).alias("predicted"))
        for name, c in zip(BASELINES, ("persistence", "daily", "weekly"))])
    return wide.select(*keys, "ts", "target_ts", "actual", F.inline(pairs))


def expanding_folds(df: DataFrame, years: Sequence[int], holdout: str, target_ts: str = "target_ts") -> DataFrame:
    """Each row once per fold it serves, as training or validation, by target time."""
    if any(f"{y + 1}-01-01" > holdout[:10] for y in years):
        raise DataContractError("Development folds cannot overlap the holdout")
    column = F.col(target_ts)
    roles = []
    for year in years:
        start, stop = f"{year}-01-01", f"{year + 1}-01-01"
        inside = (column >= instant(start)) & (column < instant(stop)) & (column < instant(holdout))
        role = F.when(column < instant(start), "train").when(inside, "validation")
        roles.append(F.when(role.isNotNull(), F.struct(F.lit(str(year)).alias("validation_period"), role.alias("role"))))
    return df.filter(column < instant(holdout)).withColumn(
        "_f", F.explode(F.array_compact(F.array(*roles)))).select(*df.columns, "_f.*")


def fold_report(folds: DataFrame, keys: Sequence[str] = (), target_ts: str = "target_ts") -> DataFrame:
    return folds.groupBy(*keys, "validation_period", "role").agg(
        F.count("*").alias("rows"), F.min(target_ts).alias("first_target"), F.max(target_ts).alias("last_target"))


def purged_split(df: DataFrame, validation_start, test_start, last_target: Column, issue: str = "issue") -> DataFrame:
    """Train, validation or test by whole issue windows; windows that cross a boundary are dropped."""
    role = (
        F.when(last_target < instant(validation_start), "train")
        .when((F.col(issue) >= instant(validation_start)) & (last_target < instant(test_start)), "validation")
        .when(F.col(issue) >= instant(test_start), "test"))
    return df.withColumn("split", role).filter("split IS NOT NULL")


def with_last_target(df: DataFrame, keys: Sequence[str], target_ts: str = "target_ts") -> DataFrame:
    """Attach the last target of each issue; an issue window holds at most 24 rows."""
    last = df.groupBy(*keys).agg(F.max(target_ts).alias("last_target"))
    return df.join(last, list(keys))


SEASONS = {"winter": 1, "spring": 4, "summer": 7, "autumn": 10}


def rolling_folds(issues: DataFrame, test_start, keys: Sequence[str] = ("series_id",), *, step_s: int = HOUR,
                  horizons: int = 24, min_train: int = 365 * 24, issue: str = "issue") -> DataFrame:
    """Four seasonal one-month folds of the latest year whose months are complete.

    An issue belongs to a month's validation when all its targets end inside
    that month; a fold trains on issues whose last target is before it. The
    issues are counted per month first; fold selection runs on that table.
    """
    keys = list(keys)
    reach = horizons * step_s
    last_target = shift(issue, reach)
    usable = issues.filter(last_target < instant(test_start))
    month = F.date_trunc("month", F.col(issue))
    same_month = F.date_trunc("month", last_target) == month
    per_month = usable.groupBy(*keys, month.alias("_m")).agg(
        F.count_if(same_month).alias("_valid"), F.count("*").alias("_rows"))
    # Training rows of a fold: issues whose last target lies in an earlier month.
    by_target = usable.groupBy(*keys, F.date_trunc("month", last_target).alias("_m")).agg(F.count("*").alias("_t"))
    months = per_month.join(by_target, [*keys, "_m"], "full_outer").fillna(0, ["_valid", "_rows", "_t"])
    line = Window.partitionBy(*keys).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    seasons = F.create_map(*[F.lit(x) for name, m in SEASONS.items() for x in (m, name)])
    end = F.add_months("_m", 1).cast("timestamp")
    expected = F.floor(elapsed_seconds(end, "_m") / step_s) - horizons
    folds = (
        months.withColumn("train_rows", F.coalesce(F.sum("_t").over(line), F.lit(0)))
        .withColumns({"season": seasons[F.month("_m")], "validation_end": end})
        .filter("season IS NOT NULL")
        .withColumn("_ok", (F.col("_valid") == expected) & (F.col("train_rows") >= min_train))
        .withColumn("_year", F.year("_m"))
    )
    years = folds.groupBy(*keys, "_year").agg(F.count_if("_ok").alias("_good")).filter("_good = 4")
    latest = years.groupBy(*keys).agg(F.max("_year").alias("_year"))
    return folds.join(latest, [*keys, "_year"]).select(
        *keys, F.concat_ws("-", F.col("_year").cast("string"), "season").alias("fold_id"), "season",
        F.col("_m").alias("validation_start"), "validation_end", "train_rows",
        F.col("_valid").alias("validation_rows"))


def strategy_weight(strategy: str, issue: str = "issue", latest: str = "_latest") -> Column:
    """Weight of a row in a training strategy, from its issue and the latest one; 0 leaves it out.

    ``full_expanding``; ``rolling_{n}y`` keeps the last n years;
    ``recency_weighted_{d}d`` halves a row's weight every d days.
    """
    if strategy in ("full_expanding", "full_history"):
        return F.lit(1.0)
    if strategy.startswith("rolling_"):
        years = int(strategy.removeprefix("rolling_").removesuffix("y"))
        return F.when(F.col(issue) >= F.col(latest) - F.make_ym_interval(F.lit(years), F.lit(0)), 1.0).otherwise(0.0)
    if strategy.startswith("recency_weighted_"):
        half_life = float(strategy.removeprefix("recency_weighted_").removesuffix("d"))
        return F.pow(F.lit(0.5), elapsed_seconds(latest, issue) / DAY / half_life)
    raise DataContractError(f"Unknown training strategy: {strategy}")


def strategy_rows(df: DataFrame, strategy: str, keys: Sequence[str] = ("series_id",), issue: str = "issue") -> DataFrame:
    """Rows and weights of a training strategy, from issue times alone."""
    weight = strategy_weight(strategy, issue)
    latest = df.groupBy(*keys).agg(F.max(issue).alias("_latest"))
    joined = salted_join(df, latest, keys)
    if strategy.startswith("rolling_"):
        joined = joined.filter(weight > 0).withColumn("weight", F.lit(1.0))
    else:
        joined = joined.withColumn("weight", weight)
    return joined.drop("_latest")


# --- seasonal forecast -----------------------------------------------------------------

def seasonal_forecast(medians: DataFrame, now, keys: Sequence[str] = ("series_id",), horizons: int = 24) -> DataFrame:
    """24 hours from the hour of ``now``, each the median of its hour of day."""
    issue = F.date_trunc("hour", instant(now))
    whole = medians.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("hour", "median"))).alias("_m"),
        F.max("latest_ts").alias("latest_ts"), F.min("samples").alias("minimum_hour_samples"))
    grid = whole.withColumn("horizon_hours", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    target = shift(issue, F.col("horizon_hours") * HOUR)
    return grid.select(
        *keys, issue.alias("forecast_issue_time"), "horizon_hours", target.alias("target_timestamp"),
        F.col("_m")[F.hour(target)]["median"].alias("predicted_price_eur_mwh"),
        "latest_ts", "minimum_hour_samples")
