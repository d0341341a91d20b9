"""Queries on issue-hour features, chart samples, folds and event sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.times import DAY, HOUR, shift
from tidegrid.operators import features as ops
from tidegrid.operators.series import hourly_prices
from tidegrid.plans.adapters import (
    D_SQL, H_SQL, R_SQL, S_SQL, days, hours, runs, silver, table,
)
from tidegrid.plans.registry import query
from tidegrid.plans.series import CUTOVER, QP_SQL, price_points

W = "OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL {0} PRECEDING AND INTERVAL {1} PRECEDING)"


def at(column, back):
    return f"max({column}) " + W.format(back, back)


def roll(fn, column, n, unit="HOUR"):
    frame = W.format(f"{n - 1} {unit}", f"0 {unit}")
    return f"CASE WHEN count({column}) {frame} = {n} THEN {fn}({column}) {frame} END"


GREEN = "(solar_mw + wind_total_mw + biomass_mw + hydro_mw)"
TABLE_SQL = f"""{S_SQL}, t0 AS (SELECT * REPLACE (coalesce(nuclear_mw, 0) AS nuclear_mw) FROM s),
feat AS (SELECT *, CAST(hour(ts) AS INTEGER) AS hour, CAST((dayofweek(ts) + 6) % 7 AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS month,
  CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
  {at('price_eur_mwh', '1 HOUR')} AS price_lag_1h, {at('price_eur_mwh', '24 HOUR')} AS price_lag_24h, {at('price_eur_mwh', '168 HOUR')} AS price_lag_168h,
  {at('load_mw', '1 HOUR')} AS load_lag_1h, {at('load_mw', '24 HOUR')} AS load_lag_24h,
  round({roll('avg', 'price_eur_mwh', 24)}, 9) AS price_rolling_mean_24h, round({roll('stddev_samp', 'price_eur_mwh', 24)}, 6) AS price_rolling_std_24h,
  round({roll('avg', 'load_mw', 24)}, 7) AS load_rolling_mean_24h, round({GREEN}, 6) AS renewable_generation_mw,
  round({GREEN} / ({GREEN} + lignite_mw + gas_mw + hard_coal_mw + nuclear_mw), 9) AS renewable_share,
  max(price_eur_mwh) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR FOLLOWING AND INTERVAL 1 HOUR FOLLOWING) AS target_price_next_hour
  FROM t0)"""
ROUNDED = {"price_rolling_mean_24h": 9, "price_rolling_std_24h": 6, "load_rolling_mean_24h": 7,
           "renewable_generation_mw": 6, "renewable_share": 9}


def rounded(df):
    return df.withColumns({c: F.round(c, n) for c, n in ROUNDED.items() if c in df.columns})


ALL = ", ".join((*ops.FEATURES, ops.TARGET))


@query("wn5_feature_table", f"WITH {TABLE_SQL} SELECT series_id, ts, {ALL} FROM feat")
def hourly_features(spark, d):
    return rounded(ops.feature_table(silver(spark, d)).select("series_id", "ts", *ops.FEATURES, ops.TARGET))


def not_null(names):
    return " AND ".join(f"{n} IS NOT NULL" for n in names)


@query("wn5_build_gold", f"WITH {TABLE_SQL} SELECT series_id, ts, {ALL} FROM feat WHERE {not_null((*ops.FEATURES, ops.TARGET))}")
def _(spark, d):
    return rounded(ops.build_gold(silver(spark, d)))


@query("wn6_issue_features", f"WITH {TABLE_SQL} SELECT series_id, ts, {', '.join(ops.FEATURES)} FROM feat WHERE {not_null(ops.FEATURES)}")
def _(spark, d):
    return rounded(ops.issue_features(silver(spark, d)))


@query("wn7_fallback_features", f"WITH {TABLE_SQL} SELECT series_id, ts, {', '.join(ops.FALLBACK_FEATURES)} FROM feat WHERE {not_null(ops.FALLBACK_FEATURES)}")
def _(spark, d):
    return rounded(ops.fallback_features(silver(spark, d)))


@query("wn1_lag_hours", f"WITH {H_SQL} SELECT *, {at('value', '1 HOUR')} AS value_lag_1h, {at('value', '24 HOUR')} AS value_lag_24h, {at('value', '168 HOUR')} AS value_lag_168h FROM h")
def _(spark, d):
    return ops.lag_hours(hours(spark, d), ["series_id"], "value", (1, 24, 168))


@query("wn2_rolling_mean", f"WITH {D_SQL} SELECT series_id, ts, price_eur_mwh, round({roll('avg', 'price_eur_mwh', 24, 'DAY')}, 9) AS mean_24 FROM dd")
def _(spark, d):
    out = ops.rolling_mean(days(spark, d).select("series_id", "ts", "price_eur_mwh"), ["series_id"], "price_eur_mwh", 24, "mean_24", step_s=DAY)
    return out.withColumn("mean_24", F.round("mean_24", 9))


@query("wn3_rolling_std", f"WITH {D_SQL} SELECT series_id, ts, price_eur_mwh, round({roll('stddev_samp', 'price_eur_mwh', 24, 'DAY')}, 6) AS std_24 FROM dd")
def _(spark, d):
    out = ops.rolling_std(days(spark, d).select("series_id", "ts", "price_eur_mwh"), ["series_id"], "price_eur_mwh", 24, "std_24", step_s=DAY)
    return out.withColumn("std_24", F.round("std_24", 6))


@query("wn4_lead_hours", f"WITH {H_SQL} SELECT h.*, n.value AS next_value FROM h LEFT JOIN h n ON n.series_id = h.series_id AND n.ts = h.ts + INTERVAL 1 HOUR")
def _(spark, d):
    return ops.lead_hours(hours(spark, d), ["series_id"], "value", 1, "next_value")


@query("wn8_exact_hourly_stat", f"""WITH {S_SQL}, a AS (SELECT DISTINCT 'all' AS series_id, date_trunc('hour', ts) + INTERVAL 12 HOUR AS anchor FROM events WHERE event_type = 'error'),
t AS (SELECT series_id, ts AS anchor, round({roll('stddev_samp', 'price_eur_mwh', 24)}, 6) AS std_24h FROM s)
SELECT a.series_id, a.anchor, std_24h FROM a LEFT JOIN t ON t.series_id = a.series_id AND t.anchor = a.anchor""")
def _(spark, d):
    anchors = table(spark, d, "events").filter("event_type = 'error'").select(
        F.lit("all").alias("series_id"), shift(F.date_trunc("hour", "ts"), 12 * HOUR).alias("anchor")).distinct()
    out = ops.exact_hourly_stat(silver(spark, d), anchors, ["series_id"], "price_eur_mwh", 24, F.stddev_samp, "std_24h")
    return out.withColumn("std_24h", F.round("std_24h", 6))


@query("wn9_price_comparison", f"""WITH {QP_SQL}, l AS (
  SELECT *, coalesce(resolution, CASE WHEN ts >= TIMESTAMP '{CUTOVER}' THEN 'PT15M' ELSE 'PT60M' END) AS res FROM qp),
ph AS (SELECT series_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM l GROUP BY 1, 2
  HAVING min(res) = max(res) AND count(value) = CASE min(res) WHEN 'PT15M' THEN 4 ELSE 1 END),
x AS (SELECT series_id, max(ts) AS latest_ts FROM ph GROUP BY 1)
SELECT series_id, latest_ts, round(max(value) FILTER (WHERE ts = latest_ts), 9) AS latest_price,
  round(CASE WHEN count(*) FILTER (WHERE ts > latest_ts - INTERVAL 24 HOUR) = 24 THEN avg(value) FILTER (WHERE ts > latest_ts - INTERVAL 24 HOUR) END, 9) AS previous_24h_average,
  round(CASE WHEN count(*) = 168 THEN avg(value) END, 9) AS seven_day_average
FROM ph JOIN x USING (series_id) WHERE ts > latest_ts - INTERVAL 168 HOUR GROUP BY 1, 2""")
def _(spark, d):
    out = ops.price_comparison(hourly_prices(price_points(spark, d), ["series_id"], "value", CUTOVER))
    return out.withColumns({c: F.round(c, 9) for c in ("latest_price", "previous_24h_average", "seven_day_average")})


@query("wn9_price_comparison_series", f"""WITH {H_SQL}, x AS (SELECT series_id, max(ts) AS latest_ts FROM h GROUP BY 1)
SELECT series_id, latest_ts, max(value) FILTER (WHERE ts = latest_ts) AS latest_price,
  round(CASE WHEN count(*) FILTER (WHERE ts > latest_ts - INTERVAL 24 HOUR) = 24 THEN avg(value) FILTER (WHERE ts > latest_ts - INTERVAL 24 HOUR) END, 9) AS previous_24h_average,
  round(CASE WHEN count(*) = 168 THEN avg(value) END, 9) AS seven_day_average
FROM h JOIN x USING (series_id) WHERE ts > latest_ts - INTERVAL 168 HOUR GROUP BY 1, 2""")
def _(spark, d):
    out = ops.price_comparison(hours(spark, d))
    return out.withColumns({c: F.round(c, 9) for c in ("previous_24h_average", "seven_day_average")})


@query("wn10_issue_context", f"""WITH {S_SQL}, i AS (SELECT DISTINCT 'all' AS series_id, date_trunc('hour', ts) + INTERVAL 5 HOUR AS issue FROM events),
t AS (SELECT series_id, ts AS issue, price_eur_mwh, load_mw, round({GREEN} / ({GREEN} + lignite_mw + gas_mw + hard_coal_mw + coalesce(nuclear_mw, 0)), 9) AS renewable_share,
  round({roll('avg', 'price_eur_mwh', 24)}, 9) AS price_rolling_mean_24h, round({roll('stddev_samp', 'price_eur_mwh', 24)}, 6) AS price_rolling_std_24h,
  round({roll('avg', 'price_eur_mwh', 168)}, 9) AS price_average_7d FROM s)
SELECT i.series_id, i.issue, t.issue IS NOT NULL AS available, price_eur_mwh, load_mw, renewable_share, price_rolling_mean_24h, price_rolling_std_24h, price_average_7d
FROM i LEFT JOIN t ON t.issue = i.issue""")
def _(spark, d):
    issues = table(spark, d, "events").select(
        F.lit("all").alias("series_id"), shift(F.date_trunc("hour", "ts"), 5 * HOUR).alias("issue")).distinct()
    out = ops.issue_context(silver(spark, d), issues)
    return rounded(out).withColumn("price_average_7d", F.round("price_average_7d", 9)).select(
        "series_id", "issue", "available", "price_eur_mwh", "load_mw", "renewable_share", "price_rolling_mean_24h",
        "price_rolling_std_24h", "price_average_7d")


WN11_SQL = f"""{D_SQL}, x AS (SELECT series_id, ts, CASE WHEN orders % 4 = 0 THEN NULL ELSE price_eur_mwh END AS price, total FROM dd),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM x),
b AS (SELECT *, (rn - 1) // greatest(ceil(n / 33.0), 1)::BIGINT AS bin FROM r),
e AS (SELECT *, row_number() OVER (PARTITION BY series_id, bin ORDER BY price IS NULL, price, ts) AS p1,
  row_number() OVER (PARTITION BY series_id, bin ORDER BY price IS NULL, price DESC, ts) AS p2,
  row_number() OVER (PARTITION BY series_id, bin ORDER BY total IS NULL, total, ts) AS q1,
  row_number() OVER (PARTITION BY series_id, bin ORDER BY total IS NULL, total DESC, ts) AS q2,
  min(rn) OVER (PARTITION BY series_id, bin) AS lo, max(rn) OVER (PARTITION BY series_id, bin) AS hi FROM b),
kept AS (SELECT series_id, ts, price, total, rn FROM e WHERE p1 = 1 OR p2 = 1 OR q1 = 1 OR q2 = 1 OR rn = lo OR rn = hi)"""


def sampled(spark, d):
    base = days(spark, d).select("series_id", "ts", F.when(F.col("orders") % 4 != 0, F.col("price_eur_mwh")).alias("price"), "total")
    return ops.downsample_extremes(base, ["series_id"], ["price", "total"], 200, width=90 * DAY)


@query("wn11_downsample_extremes", f"WITH {WN11_SQL} SELECT series_id, ts, price, total, rn FROM kept")
def _(spark, d):
    return sampled(spark, d)


@query("wn13_gap_before", f"""WITH {WN11_SQL} SELECT series_id, ts, coalesce((epoch(ts) - epoch(lag(ts) OVER w)) // 86400 > rn - lag(rn) OVER w, false) AS gap_before
FROM kept WINDOW w AS (PARTITION BY series_id ORDER BY rn)""")
def _(spark, d):
    return ops.gap_before(sampled(spark, d), ["series_id"], step_s=DAY).select("series_id", "ts", "gap_before")


@query("wn12_latest_per", f"""WITH {R_SQL} SELECT component, event_type, id, run_time, duration_seconds FROM (
  SELECT *, row_number() OVER (PARTITION BY component, event_type ORDER BY run_time DESC, id DESC) AS rn FROM runs) WHERE rn = 1""")
def _(spark, d):
    return ops.latest_per(runs(spark, d), ["component", "event_type"], ["run_time", "id"]).select(
        "component", "event_type", "id", "run_time", "duration_seconds")


@query("wn14_downsample_stride", f"""WITH {H_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM h)
SELECT series_id, ts, value, rn FROM r WHERE (rn - 1) % CASE WHEN n <= 100 THEN 1 ELSE ceil((n - 1) / 99.0)::BIGINT END = 0 OR rn = n""")
def _(spark, d):
    return ops.downsample_stride(hours(spark, d), ["series_id"], 100)


@query("wn15_coef_rank", """WITH c AS (SELECT l_returnflag AS model_name, l_linenumber AS feature, round(avg(l_extendedprice), 4) AS importance FROM lineitem GROUP BY 1, 2)
SELECT *, CAST(dense_rank() OVER (PARTITION BY model_name ORDER BY importance DESC) AS INTEGER) AS coefficient_magnitude_rank FROM c""")
def _(spark, d):
    means = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model_name"), F.col("l_linenumber").alias("feature")).agg(
        F.round(F.avg("l_extendedprice"), 4).alias("importance"))
    return ops.coef_rank(means)


@query("wn16_failure_streak", f"""WITH {R_SQL}, ok AS (SELECT component, max(id) AS last_ok FROM runs WHERE status = 'SUCCESS' GROUP BY 1)
SELECT component, count(*) FILTER (WHERE status = 'FAILED' AND (last_ok IS NULL OR id > last_ok)) AS failures
FROM runs LEFT JOIN ok USING (component) WHERE status IN ('FAILED', 'SUCCESS') GROUP BY 1""")
def _(spark, d):
    return ops.failure_streak(runs(spark, d), ["component"], ["id"])


@query("wn17_cooldown", """WITH RECURSIVE ev AS (
  SELECT event_id AS id, ts AS run_time, 'c' || CAST(user_id % 7 AS VARCHAR) AS component FROM events),
kept AS (
  SELECT component, min(run_time) AS run_time FROM ev GROUP BY 1
  UNION ALL
  SELECT k.component, (SELECT min(e.run_time) FROM ev e WHERE e.component = k.component AND e.run_time >= k.run_time + INTERVAL 60 MINUTE)
  FROM kept k WHERE k.run_time IS NOT NULL)
SELECT ev.component, ev.run_time, min(ev.id) AS id FROM ev JOIN kept USING (component, run_time) GROUP BY 1, 2""")
def _(spark, d):
    return ops.cooldown(runs(spark, d).select("component", "run_time", "id"), ["component"], 60, "run_time")


@query("wn18_active_incidents", f"""WITH {R_SQL} SELECT component, event_type, id FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 'ACTIVE' ELSE 'RESOLVED' END AS state,
  row_number() OVER (PARTITION BY component, event_type ORDER BY run_time DESC, id DESC) AS rn FROM runs) WHERE rn = 1 AND state = 'ACTIVE'""")
def _(spark, d):
    rows = runs(spark, d).withColumn("status", F.when(F.col("id") % 2 == 0, "ACTIVE").otherwise("RESOLVED"))
    return ops.active_incidents(rows).select("component", "event_type", "id")


@query("wn19_legacy_lags", f"""WITH {D_SQL}, m AS (SELECT series_id, ts, price_eur_mwh AS market_price, total AS electricity_sales, total AS demand_mw, total * 1.05 AS supply_mw FROM dd)
SELECT series_id, ts, lag(market_price, 1) OVER w AS price_lag_1, lag(market_price, 3) OVER w AS price_lag_3, lag(electricity_sales, 1) OVER w AS sales_lag_1,
  round(CASE WHEN count(market_price) OVER w3 = 3 THEN avg(market_price) OVER w3 END, 9) AS price_rolling_3_month_avg,
  round(CASE WHEN count(electricity_sales) OVER w3 = 3 THEN avg(electricity_sales) OVER w3 END, 4) AS sales_rolling_3_month_avg, round(supply_mw - demand_mw, 5) AS supply_demand_gap
FROM m WINDOW w AS (PARTITION BY series_id ORDER BY ts), w3 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    base = days(spark, d).select("series_id", "ts", F.col("price_eur_mwh").alias("market_price"), F.col("total").alias("electricity_sales"),
                                 F.col("total").alias("demand_mw"), (F.col("total") * 1.05).alias("supply_mw"))
    out = ops.legacy_lags(base, ["series_id"])
    return out.select("series_id", "ts", "price_lag_1", "price_lag_3", "sales_lag_1", F.round("price_rolling_3_month_avg", 9).alias("price_rolling_3_month_avg"),
                      F.round("sales_rolling_3_month_avg", 4).alias("sales_rolling_3_month_avg"), F.round("supply_demand_gap", 5).alias("supply_demand_gap"))


@query("wn20_holdout_split", f"""WITH {D_SQL}, r AS (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM dd)
SELECT series_id, ts, rn, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS role FROM r""")
def _(spark, d):
    return ops.holdout_split(days(spark, d).select("series_id", "ts"), ["series_id"], width=90 * DAY)


@query("wn21_time_series_folds", f"""WITH {D_SQL}, r AS (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM dd),
f AS (SELECT *, n // 4 AS test, n - (3 - k + 1) * (n // 4) AS start FROM r CROSS JOIN (SELECT unnest([1, 2, 3]) AS k))
SELECT series_id, k AS fold, min(ts) FILTER (WHERE i < start) AS training_start, max(ts) FILTER (WHERE i < start) AS training_end,
  min(ts) FILTER (WHERE i >= start AND i < start + test) AS validation_start, max(ts) FILTER (WHERE i >= start AND i < start + test) AS validation_end,
  count(*) FILTER (WHERE i < start) AS train_rows, count(*) FILTER (WHERE i >= start AND i < start + test) AS validation_rows FROM f GROUP BY 1, 2""")
def _(spark, d):
    return ops.time_series_folds(days(spark, d), ["series_id"], 3, width=90 * DAY)


@query("wn22_missing_inputs", f"""WITH {H_SQL}, i AS (SELECT DISTINCT series_id, ts + INTERVAL 1 HOUR AS issue FROM h),
n AS (SELECT unnest([0, 1, 24, 168]) AS b UNION SELECT unnest(range(24))),
m AS (SELECT i.series_id, issue, b FROM i CROSS JOIN n LEFT JOIN h ON h.series_id = i.series_id AND h.ts = issue - b * INTERVAL 1 HOUR WHERE h.ts IS NULL)
SELECT series_id, issue, coalesce(string_agg(CASE WHEN b IN (0, 1, 24, 168) THEN CAST(b AS VARCHAR) END, ',' ORDER BY b), '') AS missing_lag_hours,
  coalesce(string_agg(CASE WHEN b < 24 THEN CAST(b AS VARCHAR) END, ',' ORDER BY b), '') AS missing_window_hours FROM m GROUP BY 1, 2""")
def _(spark, d):
    base = hours(spark, d)
    issues = base.select("series_id", shift("ts", HOUR).alias("issue")).distinct()
    out = ops.missing_inputs(issues, base, ["series_id"], (1, 24, 168))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("missing_lag_hours", "missing_window_hours")})

