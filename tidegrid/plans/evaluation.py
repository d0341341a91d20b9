"""Queries on errors, baselines, folds, splits and selection tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.times import DAY, shift
from tidegrid.operators import evaluation as ops, stats
from tidegrid.operators.joins import match_realized
from tidegrid.plans.adapters import D_SQL, F_SQL, S_SQL, actuals, days, forecasts, hours, silver
from tidegrid.plans.joins import BASE_SQL, predictions
from tidegrid.plans.registry import query
from tidegrid.plans.stats import AG9_SQL, NOW as SEASON_NOW

NOW = "2024-01-29 12:00:00"
PAIR_SQL = f"""{F_SQL}, pairs AS (SELECT f.*, a.price_eur_mwh AS actual_price_eur_mwh, predicted_price_eur_mwh - a.price_eur_mwh AS e
  FROM history f JOIN actual a ON a.series_id = f.series_id AND a.target_timestamp = f.target_timestamp
  WHERE issued_at_utc < f.target_timestamp AND f.target_timestamp + INTERVAL 1 HOUR <= TIMESTAMP '{NOW}')"""


def pairs(spark, d):
    return match_realized(forecasts(spark, d), actuals(spark, d), NOW)


def named(df):
    return df.withColumnsRenamed({"actual_price_eur_mwh": "actual", "predicted_price_eur_mwh": "predicted"})


def metrics_sql(e, y):
    return f"""count(*) AS observations, round(avg(abs({e})), 6) AS mae, round(sqrt(avg({e} * {e})), 6) AS rmse,
  round(1 - sum({e} * {e}) / nullif(var_pop({y}) * count(*), 0), 8) AS r2, round(avg({e}), 6) AS bias"""


def six(df, names=("mae", "rmse", "bias")):
    out = df.withColumns({c: F.round(c, 6) for c in names if c in df.columns})
    return out.withColumn("r2", F.round("r2", 8)) if "r2" in df.columns else out


@query("ag11_error_metrics", f"WITH {PAIR_SQL} SELECT series_id, model_release, {metrics_sql('e', 'actual_price_eur_mwh')} FROM pairs GROUP BY 1, 2")
def _(spark, d):
    return six(ops.error_metrics(named(pairs(spark, d)), ["series_id", "model_release"]))


@query("ag12_metrics_by_horizon", f"""WITH {PAIR_SQL} SELECT model_release, CAST(CASE WHEN GROUPING(horizon_hours) = 1 THEN 0 ELSE horizon_hours END AS INTEGER) AS horizon_hours,
  {metrics_sql('e', 'actual_price_eur_mwh')} FROM pairs GROUP BY GROUPING SETS ((model_release, horizon_hours), (model_release))""")
def _(spark, d):
    return six(ops.metrics_by_horizon(named(pairs(spark, d)), ["model_release"]))


@query("ag13_extreme_metrics", f"""WITH {PAIR_SQL}, r AS (SELECT *, 'negative_price' AS price_regime, actual_price_eur_mwh < 0 AS hit FROM pairs
  UNION ALL SELECT *, 'extreme_high_price', actual_price_eur_mwh >= 200 FROM pairs)
SELECT series_id, model_release, price_regime, count(*) FILTER (WHERE hit) AS observations, round(avg(abs(e)) FILTER (WHERE hit), 6) AS mae,
  round(sqrt(avg(e * e) FILTER (WHERE hit)), 6) AS rmse, round(avg(e) FILTER (WHERE hit), 6) AS bias FROM r GROUP BY 1, 2, 3""")
def _(spark, d):
    return six(ops.extreme_metrics(named(pairs(spark, d)), ["series_id", "model_release"]))


@query("ag14_regime_performance", f"""WITH {BASE_SQL}, keys AS (SELECT DISTINCT model_name, validation_period FROM pred UNION SELECT DISTINCT model_name, 'All Development Folds' FROM pred),
sp AS (SELECT *, unnest(['Negative', 'Normal', 'High', 'Extreme']) AS price_regime FROM keys),
m AS (SELECT model_name, CASE WHEN GROUPING(validation_period) = 1 THEN 'All Development Folds' ELSE validation_period END AS validation_period, price_regime, count(*) AS n,
  avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse, avg(predicted - actual) AS b
  FROM pred GROUP BY GROUPING SETS ((model_name, validation_period, price_regime), (model_name, price_regime)))
SELECT sp.model_name, 'naive' AS feature_group, sp.validation_period, sp.price_regime, coalesce(n, 0) AS observation_count, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(b, 6) AS mean_signed_error_bias
FROM sp LEFT JOIN m USING (model_name, validation_period, price_regime)""")
def _(spark, d):
    return six(ops.regime_performance(predictions(spark, d)), ("mae", "rmse", "mean_signed_error_bias"))


ERR = "sqrt(avg((predicted - actual) * (predicted - actual)))"
GAIN_SQL = f"""{BASE_SQL}, r0 AS (SELECT model_name, validation_period, avg(abs(predicted - actual)) AS mae, {ERR} AS rmse FROM pred GROUP BY 1, 2),
r1 AS (SELECT * FROM r0 UNION ALL SELECT 'half way', validation_period, min(mae), (min(rmse) + max(rmse)) / 2 FROM r0 GROUP BY 2),
base AS (SELECT validation_period, max(rmse) FILTER (WHERE model_name = 'Persistence Baseline') AS p, min(rmse) FILTER (WHERE model_name LIKE '%Naive') AS s FROM r0 GROUP BY 1),
gains AS (SELECT r1.*, CASE WHEN model_name = 'half way' THEN (p - rmse) / p * 100 END AS gp, CASE WHEN model_name = 'half way' THEN (s - rmse) / s * 100 END AS gs FROM r1 JOIN base USING (validation_period))"""


def fold_errors(spark, d):
    real = ops.error_metrics(predictions(spark, d), ["model_name", "validation_period"]).select("model_name", "validation_period", "mae", "rmse")
    mixed = real.groupBy("validation_period").agg(F.min("mae").alias("mae"), ((F.min("rmse") + F.max("rmse")) / 2).alias("rmse")).withColumn("model_name", F.lit("half way"))
    return ops.rmse_gain(real.unionByName(mixed))


@query("ag15_rmse_gain", f"WITH {GAIN_SQL} SELECT model_name, validation_period, round(rmse, 6) AS rmse, round(gp, 6) AS rmse_improvement_vs_persistence_pct, round(gs, 6) AS rmse_improvement_vs_best_seasonal_pct FROM gains")
def _(spark, d):
    gains = ("rmse_improvement_vs_persistence_pct", "rmse_improvement_vs_best_seasonal_pct")
    return six(fold_errors(spark, d).drop("mae"), ("rmse", *gains))


@query("ag16_fold_aggregate", f"""WITH {GAIN_SQL} SELECT model_name, count(*) AS validation_periods, round(avg(mae), 6) AS mean_mae, round(avg(rmse), 6) AS mean_rmse, round(stddev_pop(rmse), 6) AS rmse_std,
  round(min(rmse), 6) AS min_rmse, round(max(rmse), 6) AS max_rmse, round(avg(gp), 6) AS mean_rmse_improvement_vs_persistence_pct, round(avg(gs), 6) AS mean_rmse_improvement_vs_best_seasonal_pct FROM gains GROUP BY 1""")
def _(spark, d):
    out = ops.fold_aggregate(fold_errors(spark, d))
    return six(out, [c for c in out.columns if c not in ("model_name", "validation_periods")])


@query("ag17_nested_aggregate", f"""WITH {PAIR_SQL}, x AS (SELECT model_release AS strategy, strftime(target_timestamp, '%W') AS fold_id, actual_price_eur_mwh AS y, e FROM pairs),
m AS (SELECT strategy, fold_id, sqrt(avg(e * e)) AS rmse, avg(e) AS bias FROM x GROUP BY 1, 2),
hi AS (SELECT strategy, fold_id, count(*) FILTER (WHERE y >= 200) AS n, coalesce(sum(e * e) FILTER (WHERE y >= 200), 0) AS sq FROM x GROUP BY 1, 2)
SELECT m.strategy, count(DISTINCT m.fold_id) AS fold_count, round(avg(rmse), 6) AS mean_rmse, round(median(rmse), 6) AS median_rmse, round(stddev_pop(rmse), 6) AS rmse_std, round(max(rmse), 6) AS worst_fold_rmse,
  round(avg(abs(bias)), 6) AS mean_absolute_bias, round(max(abs(bias)), 6) AS worst_absolute_bias, CAST(sum(n) AS BIGINT) AS high_price_observations, round(sqrt(sum(sq) / nullif(sum(n), 0)), 6) AS high_price_rmse
FROM m JOIN hi ON hi.strategy = m.strategy AND hi.fold_id = m.fold_id GROUP BY 1""")
def _(spark, d):
    # Folds are calendar weeks, numbered from the first Monday of the year.
    week = F.floor((F.dayofyear("target_timestamp") - 1 + 7 - F.weekday("target_timestamp")) / 7)
    rows = named(pairs(spark, d)).withColumns({"strategy": F.col("model_release"), "fold_id": week})
    metrics = ops.metrics_by_horizon(rows, ["strategy", "fold_id"])
    extremes = ops.extreme_metrics(rows, ["strategy", "fold_id"])
    out = ops.nested_aggregate(metrics, extremes)
    return six(out, [c for c in out.columns if c not in ("strategy", "fold_count", "high_price_observations")])


GROUPS = ("Persistence Baseline", "Daily Seasonal Naive", "Weekly Seasonal Naive")


@query("ag18_ablation_aggregate", f"""WITH {BASE_SQL}, r AS (SELECT model_name AS feature_group, validation_period, avg(abs(predicted - actual)) AS mae, {ERR} AS rmse FROM pred GROUP BY 1, 2),
g AS (SELECT feature_group, CASE feature_group WHEN 'Persistence Baseline' THEN 1 WHEN 'Daily Seasonal Naive' THEN 2 ELSE 3 END AS pos, count(*) AS validation_periods, avg(mae) AS mean_mae, avg(rmse) AS mean_rmse, stddev_pop(rmse) AS rmse_std FROM r GROUP BY 1)
SELECT 'naive' AS model_name, feature_group, pos AS feature_count, validation_periods, round(mean_mae, 6) AS mean_mae, round(mean_rmse, 6) AS mean_rmse, round(rmse_std, 6) AS rmse_std,
  round((lag(mean_rmse) OVER w - mean_rmse) / lag(mean_rmse) OVER w * 100, 6) AS improvement_vs_previous_feature_group_pct,
  round((first_value(mean_rmse) OVER w - mean_rmse) / first_value(mean_rmse) OVER w * 100, 6) AS improvement_vs_time_only_pct, round((150 - mean_rmse) / 150 * 100, 6) AS improvement_vs_persistence_baseline_pct
FROM g WINDOW w AS (ORDER BY pos)""")
def _(spark, d):
    errors = ops.error_metrics(predictions(spark, d), ["model_name", "validation_period"]).withColumnRenamed("model_name", "feature_group")
    pos = F.array_position(F.array(*[F.lit(g) for g in GROUPS]), F.col("feature_group")).cast("int")
    rows = errors.withColumns({"model_name": F.lit("naive"), "feature_count": pos})
    out = ops.ablation_aggregate(rows, GROUPS, 150.0)
    return six(out, [c for c in out.columns if c.startswith(("mean", "rmse", "improvement"))])


AGE = f"epoch(TIMESTAMP '{NOW}') - epoch(target_timestamp)"
AG19_SQL = f"""{PAIR_SQL}, u AS (SELECT *, {AGE} AS age FROM pairs),
x AS (SELECT model_release, 'overall' AS scope, 'all' AS name, e FROM u UNION ALL SELECT model_release, 'window', '24h', e FROM u WHERE age < 86400
  UNION ALL SELECT model_release, 'window', '7d', e FROM u WHERE age < 604800 UNION ALL SELECT model_release, 'window', '30d', e FROM u WHERE age < 2592000
  UNION ALL SELECT model_release, 'horizon', CAST(horizon_hours AS VARCHAR), e FROM u),
perf AS (SELECT model_release, scope, name, count(*) AS pair_count, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias FROM x GROUP BY 1, 2, 3)"""


@query("ag19_realized_performance", f"""WITH {AG19_SQL} SELECT model_release, scope, name, pair_count, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bias, 6) AS bias,
  'Available' AS status FROM perf""")
def _(spark, d):
    return six(ops.realized_performance(pairs(spark, d), NOW))


@query("ag20_monitoring_metrics", f"""WITH {PAIR_SQL}, b AS (SELECT *, horizon_hours AS h FROM pairs UNION ALL SELECT *, 0 FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY model_release, h ORDER BY target_timestamp DESC, forecast_issue_time DESC, series_id DESC) AS rn FROM b)
SELECT model_release, CASE WHEN h = 0 THEN 'overall' ELSE 'horizon' END AS scope, CAST(h AS INTEGER) AS horizon_hours, count(*) AS observations, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias,
  count(*) FILTER (WHERE rn <= 168) AS rolling_window, round(avg(abs(e)) FILTER (WHERE rn <= 168), 6) AS rolling_mae, round(sqrt(avg(e * e) FILTER (WHERE rn <= 168)), 6) AS rolling_rmse, round(avg(e) FILTER (WHERE rn <= 168), 6) AS rolling_bias
FROM r GROUP BY 1, 2, 3""")
def _(spark, d):
    return six(ops.monitoring_metrics(pairs(spark, d)), ("mae", "rmse", "bias", "rolling_mae", "rolling_rmse", "rolling_bias"))


@query("ml1_baselines", f"""WITH {S_SQL} SELECT x.series_id, x.ts, x.ts + INTERVAL 1 HOUR AS target_ts, y.price_eur_mwh AS actual, x.price_eur_mwh AS persistence, d.price_eur_mwh AS daily, w.price_eur_mwh AS weekly
FROM s x LEFT JOIN s y ON y.ts = x.ts + INTERVAL 1 HOUR LEFT JOIN s d ON d.ts = x.ts - INTERVAL 23 HOUR LEFT JOIN s w ON w.ts = x.ts - INTERVAL 167 HOUR""")
def _(spark, d):
    return ops.baselines(silver(spark, d).select("series_id", "ts", "price_eur_mwh")).select(
        "series_id", "ts", "target_ts", "actual", "persistence", "daily", "weekly")


@query("ml2_expanding_folds", f"""WITH {D_SQL}, t AS (SELECT series_id, ts + INTERVAL 1 DAY AS target_ts FROM dd), f AS (SELECT unnest([1997, 1998, 1999]) AS y),
r AS (SELECT *, CASE WHEN target_ts < make_timestamp(y, 1, 1, 0, 0, 0) THEN 'train' WHEN target_ts < make_timestamp(y + 1, 1, 1, 0, 0, 0) THEN 'validation' END AS role FROM t CROSS JOIN f)
SELECT series_id, CAST(y AS VARCHAR) AS validation_period, role, count(*) AS "rows", min(target_ts) AS first_target, max(target_ts) AS last_target FROM r WHERE role IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, d):
    rows = days(spark, d).select("series_id", shift("ts", DAY).alias("target_ts"))
    return ops.fold_report(ops.expanding_folds(rows, (1997, 1998, 1999), "2000-01-01"), ["series_id"])


@query("ml3_purged_split", f"""WITH {F_SQL}, i AS (SELECT series_id, model_release, forecast_issue_time AS issue, max(target_timestamp) AS last_target, count(*) AS n FROM history GROUP BY 1, 2, 3),
sp AS (SELECT *, CASE WHEN last_target < TIMESTAMP '2024-01-15 00:00:00' THEN 'train' WHEN issue >= TIMESTAMP '2024-01-15 00:00:00' AND last_target < TIMESTAMP '2024-01-22 00:00:00' THEN 'validation'
  WHEN issue >= TIMESTAMP '2024-01-22 00:00:00' THEN 'test' END AS split FROM i)
SELECT model_release, split, CAST(sum(n) AS BIGINT) AS "rows", min(issue) AS first_issue, max(last_target) AS last_target FROM sp WHERE split IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    rows = forecasts(spark, d).withColumnsRenamed({"forecast_issue_time": "issue", "target_timestamp": "target_ts"})
    whole = ops.with_last_target(rows, ["series_id", "model_release", "issue"])
    out = ops.purged_split(whole, "2024-01-15 00:00:00", "2024-01-22 00:00:00", F.col("last_target"))
    return out.groupBy("model_release", "split").agg(F.count("*").alias("rows"), F.min("issue").alias("first_issue"), F.max("last_target").alias("last_target"))


@query("ml4_rolling_folds", f"""WITH t AS (SELECT DISTINCT o_orderdate AS issue FROM orders WHERE o_orderdate + INTERVAL 5 DAY < TIMESTAMP '2001-06-01 00:00:00'),
m AS (SELECT date_trunc('month', issue) AS m, count(*) FILTER (WHERE date_trunc('month', issue + INTERVAL 5 DAY) = date_trunc('month', issue)) AS valid FROM t GROUP BY 1),
f AS (SELECT m, valid, (SELECT count(*) FROM t WHERE date_trunc('month', issue + INTERVAL 5 DAY) < m.m) AS train, date_diff('day', m, m + INTERVAL 1 MONTH) - 5 AS expected FROM m WHERE month(m) IN (1, 4, 7, 10)),
y AS (SELECT max(yr) AS yr FROM (SELECT year(m) AS yr FROM f WHERE valid = expected AND train >= 365 GROUP BY 1 HAVING count(*) = 4))
SELECT 'all' AS series_id, CAST(year(m) AS VARCHAR) || '-' || season AS fold_id, season, m AS validation_start, m + INTERVAL 1 MONTH AS validation_end, CAST(train AS BIGINT) AS train_rows, valid AS validation_rows
FROM (SELECT *, CASE month(m) WHEN 1 THEN 'winter' WHEN 4 THEN 'spring' WHEN 7 THEN 'summer' ELSE 'autumn' END AS season FROM f) f JOIN y ON year(m) = yr""")
def _(spark, d):
    from tidegrid.plans.adapters import table

    issues = table(spark, d, "orders").select(F.lit("all").alias("series_id"), F.col("o_orderdate").alias("issue")).distinct()
    return ops.rolling_folds(issues, "2001-06-01 00:00:00", step_s=DAY, horizons=5, min_train=365)


for name, keep, weight in (
    ("full_expanding", "true", "1.0::DOUBLE"),
    ("rolling_2y", "ts >= latest - INTERVAL 2 YEAR", "1.0::DOUBLE"),
    ("recency_weighted_365d", "true", "pow(0.5, (epoch(latest) - epoch(ts)) / 86400 / 365.0)"),
):
    @query(f"ml5_strategy_{name}", f"""WITH {D_SQL}, x AS (SELECT *, max(ts) OVER (PARTITION BY series_id) AS latest FROM dd)
SELECT series_id, ts, round({weight}, 10) AS weight FROM x WHERE {keep}""")
    def _(spark, d, name=name):
        return ops.strategy_rows(days(spark, d).select("series_id", "ts"), name, issue="ts").withColumn("weight", F.round("weight", 10))


@query("ml15_seasonal_forecast", f"""WITH {AG9_SQL}, k AS (SELECT unnest(range(1, 25)) AS horizon_hours), ok AS (SELECT DISTINCT series_id, latest_ts, least FROM good WHERE hs = 24 AND least >= 7)
SELECT ok.series_id, date_trunc('hour', TIMESTAMP '{SEASON_NOW}') AS forecast_issue_time, CAST(horizon_hours AS INTEGER) AS horizon_hours,
  date_trunc('hour', TIMESTAMP '{SEASON_NOW}') + horizon_hours * INTERVAL 1 HOUR AS target_timestamp, round(good.median, 7) AS predicted_price_eur_mwh, ok.latest_ts, ok.least AS minimum_hour_samples
FROM ok CROSS JOIN k JOIN good ON good.series_id = ok.series_id AND good.hour = hour(date_trunc('hour', TIMESTAMP '{SEASON_NOW}') + horizon_hours * INTERVAL 1 HOUR)""")
def _(spark, d):
    out = ops.seasonal_forecast(stats.seasonal_median(hours(spark, d), SEASON_NOW), SEASON_NOW)
    return out.withColumn("predicted_price_eur_mwh", F.round("predicted_price_eur_mwh", 7))


