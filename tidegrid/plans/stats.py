"""Queries on coverage, summaries, profiles, operations and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.times import DAY, shift
from tidegrid.operators import quality, stats as ops
from tidegrid.operators.models import isolation_forest

from tidegrid.plans.adapters import (
    D_SQL, F_SQL, H_SQL, Q_SQL, R_SQL, S_SQL, V_SQL, days, forecasts, hours, quarters, runs, silver, table, vintages,
)
from tidegrid.plans.joins import EXO_SQL, REQ_SQL, exogenous, requests
from tidegrid.plans.registry import query
from tidegrid.plans.series import P_SQL, period_points


@query("ag1_coverage", f"""WITH {Q_SQL} SELECT series_id, count(ts) AS "rows", min(ts) AS first_ts, max(ts) AS last_ts,
  CAST((epoch(max(ts)) - epoch(min(ts))) / 900 + 1 - count(ts) AS BIGINT) AS missing FROM q GROUP BY 1""")
def _(spark, d):
    return ops.coverage(quarters(spark, d), ["series_id"], 900)


FROM_TS, TO_TS = "2024-01-04 00:00:00", "2024-01-27 12:00:00"


@query("ag2_market_summary", f"""WITH {S_SQL} SELECT count(*) AS matched_rows, round(avg(load_mw), 6) AS mean_load_mw, min(price_eur_mwh) AS minimum_price,
  max(price_eur_mwh) AS maximum_price, round(avg(price_eur_mwh), 8) AS average_price, round(stddev_samp(price_eur_mwh), 6) AS sample_price_std, max(ts) AS latest_ts
FROM s WHERE ts BETWEEN TIMESTAMP '{FROM_TS}' AND TIMESTAMP '{TO_TS}'""")
def _(spark, d):
    out = ops.market_summary(silver(spark, d), (), FROM_TS, TO_TS)
    return out.withColumns({"mean_load_mw": F.round("mean_load_mw", 6), "average_price": F.round("average_price", 8),
                            "sample_price_std": F.round("sample_price_std", 6)})


SOURCES = ("biomass_mw", "lignite_mw", "gas_mw", "hard_coal_mw", "hydro_mw", "nuclear_mw", "solar_mw", "wind_total_mw")


@query("ag3_generation_mix", f"WITH {S_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS source, round(avg({c}), 6) AS average_mw, count({c}) AS observations FROM s" for c in SOURCES))
def _(spark, d):
    return ops.generation_mix(silver(spark, d), SOURCES).withColumn("average_mw", F.round("average_mw", 6))


@query("ag4_anomaly_summary", f"""WITH {S_SQL} SELECT count(*) AS events, min(ts) AS first_event, max(ts) AS last_event, min(price_eur_mwh) AS minimum_price,
  max(price_eur_mwh) AS maximum_price, round(avg(load_mw), 6) AS average_load_mw FROM s WHERE abs(price_eur_mwh) > 100""")
def _(spark, d):
    return ops.anomaly_summary(silver(spark, d).filter("abs(price_eur_mwh) > 100")).withColumn("average_load_mw", F.round("average_load_mw", 6))


@query("ag4_marked_anomalies")
def _(spark, d):
    """The summary of the rows that the isolation forest marks."""
    marked = isolation_forest(silver(spark, d).select("series_id", "ts", "price_eur_mwh", "load_mw"), ["price_eur_mwh", "load_mw"], 0.01,
                              key=["series_id", "ts"]).filter("is_anomaly")
    return ops.anomaly_summary(marked)


PROFILE = """count(value) AS observations, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS minimum, max(value) AS maximum,
  round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS median,
  round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95"""
PROFILE_ROUND = ("mean", "std", "p05", "p25", "median", "p75", "p95")


def rounded(df, names=PROFILE_ROUND, n=6):
    return df.withColumns({c: F.round(c, n) for c in names})


@query("ag5_profile", "WITH u AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    + f") SELECT feature, {PROFILE} FROM u GROUP BY 1")
def _(spark, d):
    long = ops.unpivot(table(spark, d, "lineitem"), [], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(ops.profile(long, ["feature"]))


V0, T0 = "1999-01-01", "2000-07-01"
PERIOD = f"CASE WHEN ts < TIMESTAMP '{V0} 00:00:00' THEN 'train' WHEN ts < TIMESTAMP '{T0} 00:00:00' THEN 'validation' ELSE 'test' END"


@query("ag6_price_drift", f"""WITH {D_SQL}, x AS (SELECT *, {PERIOD} AS period, price_eur_mwh AS value FROM dd)
SELECT period, {PROFILE}, min(ts) AS start_ts, max(ts) AS end_ts, round(avg(CASE WHEN value < 0 THEN 1.0 ELSE 0 END) * 100, 6) AS negative_price_pct,
  round(avg(CASE WHEN value >= 200 THEN 1.0 ELSE 0 END) * 100, 6) AS price_gte_200_pct FROM x GROUP BY 1""")
def _(spark, d):
    out = ops.price_drift(days(spark, d), V0, T0)
    return rounded(out, (*PROFILE_ROUND, "negative_price_pct", "price_gte_200_pct"))


@query("ag6_feature_drift", f"""WITH {D_SQL}, x AS (SELECT {PERIOD} AS period, 'price_eur_mwh' AS feature, price_eur_mwh AS value FROM dd
  UNION ALL SELECT {PERIOD}, 'total', total FROM dd) SELECT period, feature, {PROFILE} FROM x GROUP BY 1, 2""")
def _(spark, d):
    return rounded(ops.feature_drift(days(spark, d), ["price_eur_mwh", "total"], V0, T0))


@query("ag7_monthly_profile", f"""WITH {D_SQL} SELECT {PERIOD} AS period, strftime(ts, '%Y-%m') AS month, round(avg(price_eur_mwh), 6) AS monthly_mean,
  round(median(price_eur_mwh), 6) AS monthly_median, count(*) AS observations FROM dd GROUP BY 1, 2""")
def _(spark, d):
    return rounded(ops.monthly_profile(days(spark, d), V0, T0), ("monthly_mean", "monthly_median"))


@query("ag8_yearly_profile", f"""WITH {D_SQL}, t AS (SELECT series_id, ts + INTERVAL 1 DAY AS target_ts, price_eur_mwh AS target FROM dd)
SELECT series_id, CAST(year(target_ts) AS INTEGER) AS year, count(*) AS count, round(avg(target), 6) AS mean, round(median(target), 6) AS median, round(stddev_samp(target), 6) AS std,
  min(target) AS min, max(target) AS max, count(*) FILTER (WHERE target < 0) AS negative_price_count, count(*) FILTER (WHERE target >= 200) AS prices_ge_200_count
FROM t WHERE target_ts < TIMESTAMP '2001-01-01 00:00:00' GROUP BY 1, 2""")
def _(spark, d):
    rows = days(spark, d).select("series_id", shift("ts", DAY).alias("target_ts"), F.col("price_eur_mwh").alias("target"))
    return rounded(ops.yearly_profile(rows, "2001-01-01", keys=["series_id"]), ("mean", "median", "std"))


NOW = "2024-01-28 06:20:00"
AG9_SQL = f"""{H_SQL}, past AS (SELECT * FROM h WHERE ts < date_trunc('hour', TIMESTAMP '{NOW}')),
lt AS (SELECT series_id, max(ts) AS latest_ts FROM past GROUP BY 1),
m AS (SELECT p.series_id, latest_ts, hour(ts) AS hour, median(value) AS median, count(*) AS samples FROM past p JOIN lt USING (series_id)
  WHERE ts >= latest_ts + INTERVAL 1 HOUR - INTERVAL 14 DAY GROUP BY 1, 2, 3),
good AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS hs, min(samples) OVER (PARTITION BY series_id) AS least FROM m)"""


@query("ag9_seasonal_median", f"""WITH {AG9_SQL} SELECT series_id, latest_ts, CAST(hour AS INTEGER) AS hour, round(median, 7) AS median, samples FROM good WHERE hs = 24 AND least >= 7""")
def _(spark, d):
    return ops.seasonal_median(hours(spark, d), NOW).withColumn("median", F.round("median", 7))


@query("ag10_forecast_summary", f"""WITH {F_SQL} SELECT series_id, forecast_issue_time, model_release, count(*) AS "rows",
  count(*) FILTER (WHERE target_timestamp > TIMESTAMP '{NOW}') AS forward_looking_rows, min(predicted_price_eur_mwh) AS minimum,
  arg_min(target_timestamp, (predicted_price_eur_mwh, horizon_hours)) AS minimum_time, max(predicted_price_eur_mwh) AS maximum,
  arg_min(target_timestamp, (-predicted_price_eur_mwh, horizon_hours)) AS maximum_time, round(avg(predicted_price_eur_mwh), 8) AS average,
  round(median(predicted_price_eur_mwh), 7) AS median,
  round(max(predicted_price_eur_mwh) FILTER (WHERE horizon_hours = 24) - max(predicted_price_eur_mwh) FILTER (WHERE horizon_hours = 1), 6) AS first_to_last_change,
  count(*) FILTER (WHERE predicted_price_eur_mwh < 0) AS negative_hours, count(*) FILTER (WHERE predicted_price_eur_mwh >= 200) AS elevated_hours
FROM history GROUP BY 1, 2, 3 HAVING count(*) = 24""")
def _(spark, d):
    out = ops.forecast_summary(forecasts(spark, d), NOW)
    return out.withColumns({"average": F.round("average", 8), "median": F.round("median", 7),
                            "first_to_last_change": F.round("first_to_last_change", 6)})


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("ag24_max_abs_corr", " UNION ALL ".join(
    f"SELECT '{a}' AS feature, round(greatest(" + ", ".join(f"abs(corr({a}, {b}))" for b in NUMERIC if b != a) + "), 9) AS max_absolute_correlation FROM lineitem" for a in NUMERIC))
def _(spark, d):
    return ops.max_abs_corr(table(spark, d, "lineitem"), NUMERIC).withColumn("max_absolute_correlation", F.round("max_absolute_correlation", 9))


@query("ag21_reason_counts", f"""WITH {EXO_SQL}, r AS (
  SELECT 'missing_issue_features' AS reason FROM exo WHERE orders IS NULL UNION ALL SELECT 'missing_target_price' FROM exo WHERE target_price IS NULL
  UNION ALL SELECT 'missing_load_forecast' FROM exo WHERE load IS NULL UNION ALL SELECT 'missing_generation_forecast' FROM exo WHERE generation IS NULL
  UNION ALL SELECT 'missing_solar_forecast' FROM exo WHERE solar IS NULL UNION ALL SELECT 'missing_wind_offshore_forecast' FROM exo WHERE off IS NULL
  UNION ALL SELECT 'missing_wind_onshore_forecast' FROM exo WHERE onsh IS NULL UNION ALL SELECT 'missing_weather_forecast' FROM exo WHERE temperature_2m IS NULL)
SELECT reason, count(*) AS "rows" FROM r GROUP BY 1""")
def _(spark, d):
    return ops.reason_counts(exogenous(spark, d))


@query("ag22_vintage_inventory", f"""WITH {V_SQL} SELECT series_id, process_type, count(*) AS "rows", count(DISTINCT (document_id, revision_number)) AS revisions,
  string_agg(DISTINCT technology, ',' ORDER BY technology) AS technologies, string_agg(DISTINCT resolution, ',' ORDER BY resolution) AS resolutions,
  min(target_timestamp) AS target_start, max(target_timestamp) AS target_end FROM v GROUP BY 1, 2""")
def _(spark, d):
    return ops.vintage_inventory(vintages(spark, d))


@query("ag23_raw_watermark", "SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS watermark")
def _(spark, d):
    return ops.raw_watermark({
        "orders": table(spark, d, "orders").select(F.col("o_orderdate").alias("ts")),
        "lines": table(spark, d, "lineitem").select(F.col("l_shipdate").alias("ts")),
        "none": table(spark, d, "orders").select(F.col("o_orderdate").alias("ts")).filter(F.lit(False))})


@query("ag25_quality_state", f"""WITH {R_SQL}, q AS (SELECT component || ':' || event_type AS check_name, run_time AS check_time, id,
  CASE WHEN id % 3 = 0 THEN 'warning' WHEN id % 3 = 1 THEN 'FAILED' ELSE 'PASSED' END AS status FROM runs),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY check_name ORDER BY check_time DESC, id DESC) AS rn FROM q WHERE NOT starts_with(check_name, 'c6:') AND check_name <> 'c5:view') WHERE rn = 1)
SELECT count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'warning') AS warnings FROM l""")
def _(spark, d):
    k = F.col("id") % 3
    rows = runs(spark, d).select(
        F.concat_ws(":", "component", "event_type").alias("check_name"), F.col("run_time").alias("check_time"), "id",
        F.when(k == 0, "warning").when(k == 1, "FAILED").otherwise("PASSED").alias("status"))
    return ops.quality_state(rows, excluded=("c5:view",), excluded_prefixes=("c6:",))


@query("ag25_status_counts", f"""WITH {R_SQL} SELECT component, count(*) FILTER (WHERE status = 'SUCCESS') AS passed,
  count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'WARNING') AS warnings FROM runs GROUP BY 1""")
def _(spark, d):
    return ops.status_counts(runs(spark, d), ["component"])


STAGE_SQL = f"""{R_SQL}, st AS (SELECT id, component, id // 40 AS run_id, duration_seconds, status,
  CASE event_type WHEN 'view' THEN 'Total pipeline' WHEN 'click' THEN 'Next24h forecast generation' ELSE event_type END AS stage_name FROM runs),
tot AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY id DESC) AS rn FROM st WHERE stage_name = 'Total pipeline'),
ok AS (SELECT component, avg(duration_seconds) AS a FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY id DESC) AS k FROM st WHERE stage_name = 'Total pipeline' AND status = 'SUCCESS') WHERE k <= 10 GROUP BY 1),
cur AS (SELECT st.* FROM st JOIN tot ON tot.component = st.component AND tot.run_id = st.run_id AND tot.rn = 1)"""


@query("ag26_timing_summary", f"""WITH {STAGE_SQL} SELECT t.component, t.run_id, t.duration_seconds AS latest_total_seconds, round(ok.a, 6) AS recent_average_seconds,
  (SELECT arg_max(duration_seconds, id) FROM cur c WHERE c.component = t.component AND stage_name = 'Next24h forecast generation') AS latest_forecast_seconds,
  (SELECT arg_max(stage_name, (duration_seconds, id)) FROM cur c WHERE c.component = t.component AND stage_name <> 'Total pipeline') AS slowest_stage
FROM tot t LEFT JOIN ok ON ok.component = t.component WHERE t.rn = 1""")
def _(spark, d):
    kind = F.col("event_type")
    stages = runs(spark, d).select(
        "id", "component", F.floor(F.col("id") / 40).alias("run_id"), "duration_seconds", "status",
        F.when(kind == "view", "Total pipeline").when(kind == "click", "Next24h forecast generation").otherwise(kind).alias("stage_name"))
    return ops.timing_summary(stages, ["component"]).withColumn("recent_average_seconds", F.round("recent_average_seconds", 6))


@query("ag27_advanced_quality", f"""WITH {D_SQL}, x AS (SELECT series_id, ts, CASE WHEN orders % 9 = 0 THEN NULL ELSE price_eur_mwh END AS p FROM dd),
m AS (SELECT series_id, avg(p) AS a, stddev_samp(p) AS sd, max(ts) AS latest_ts FROM x GROUP BY 1),
f AS (SELECT x.series_id, latest_ts, count(*) AS n, count(*) FILTER (WHERE abs(p - a) > 3 * sd) AS outliers, count(*) FILTER (WHERE p IS NULL) AS null_values, count(*) FILTER (WHERE p < 0) AS negative_values
  FROM x JOIN m USING (series_id) GROUP BY 1, 2)
SELECT series_id, latest_ts, n AS "rows", outliers, null_values, negative_values, date_diff('day', latest_ts, TIMESTAMP '2001-12-15 12:00:00') AS days_old,
  CASE WHEN date_diff('day', latest_ts, TIMESTAMP '2001-12-15 12:00:00') > 120 THEN 'WARNING' ELSE 'PASSED' END AS freshness,
  round((7 - (outliers > 0)::INT - (null_values > 0)::INT - (negative_values > 0)::INT) / 7.0::DOUBLE * 100, 6) AS quality_score FROM f""")
def _(spark, d):
    rows = days(spark, d).select("series_id", "ts", F.when(F.col("orders") % 9 != 0, F.col("price_eur_mwh")).alias("market_price"))
    return ops.advanced_quality(rows, "2001-12-15 12:00:00").withColumn("quality_score", F.round("quality_score", 6))


@query("ag28_row_deltas", """SELECT 'orders' AS source, (SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00') AS rows_before, (SELECT count(*) FROM orders) AS rows_after,
  (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01 00:00:00') AS new_rows
UNION ALL SELECT 'events', (SELECT count(*) FROM events), (SELECT count(*) FROM events WHERE event_type <> 'view'), 0""")
def _(spark, d):
    orders = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"))
    events = table(spark, d, "events")
    return ops.row_deltas({"orders": orders.filter("ts < '2000-01-01'"), "events": events},
                          {"orders": orders, "events": events.filter("event_type <> 'view'")}).withColumn("new_rows", F.col("new_rows").cast("long"))


COV_SQL = f"""{H_SQL}, x AS (SELECT series_id AS technology, CAST(day(ts) AS VARCHAR) AS document_id, '1' AS revision_number, 'PT60M' AS resolution, ts AS target_timestamp FROM h),
g AS (SELECT technology, document_id, min(target_timestamp) AS first_ts, max(target_timestamp) AS last_ts, count(*) AS observed_slots FROM x GROUP BY 1, 2),
e AS (SELECT technology, document_id, unnest(generate_series(first_ts, last_ts, INTERVAL 1 HOUR)) AS target_timestamp FROM g),
miss AS (SELECT e.technology, e.document_id, count(*) AS missing_count, string_agg(strftime(target_timestamp, '%H'), ',' ORDER BY target_timestamp) AS missing_slots
  FROM e ANTI JOIN x USING (technology, document_id, target_timestamp) GROUP BY 1, 2)"""


@query("ag29_vintage_coverage", f"""WITH {COV_SQL} SELECT g.technology, g.document_id, first_ts, last_ts, observed_slots,
  CAST((epoch(last_ts) - epoch(first_ts)) / 3600 + 1 AS BIGINT) AS expected_slots, coalesce(missing_count, 0) AS missing_count,
  missing_count IS NULL AS coverage_complete, coalesce(missing_slots, '') AS missing_slots FROM g LEFT JOIN miss USING (technology, document_id)""")
def _(spark, d):
    rows = hours(spark, d).select(
        F.col("series_id").alias("technology"), F.dayofmonth("ts").cast("string").alias("document_id"), F.lit("1").alias("revision_number"),
        F.lit("PT60M").alias("resolution"), F.col("ts").alias("target_timestamp"))
    out = ops.vintage_coverage(rows).drop("revision_number", "resolution")
    hours_text = F.transform("missing_slots", lambda t: F.date_format(t, "HH"))
    return out.withColumn("missing_slots", F.coalesce(F.array_join(hours_text, ","), F.lit("")))


@query("ag30_readiness", f"""WITH {REQ_SQL}, x AS (SELECT * FROM grid WHERE NOT (day(issue) = 13 AND horizon = 9) UNION ALL SELECT * FROM grid WHERE horizon = 3 AND day(issue) = 14),
cyc AS (SELECT series_id, issue, count(*) AS n, count(DISTINCT horizon) AS h FROM x GROUP BY 1, 2)
SELECT series_id, count(*) FILTER (WHERE n = 24 AND h = 24) AS complete_cycles, count(*) AS distinct_cycles, count(DISTINCT date_trunc('day', issue)) AS distinct_days,
  CAST(sum(n - h) AS BIGINT) AS duplicate_rows, 0 AS missing_horizons, 'NOT_READY' AS status FROM cyc GROUP BY 1""")
def _(spark, d):
    grid = requests(spark, d)
    day = F.dayofmonth("issue")
    rows = grid.filter(~((day == 13) & (F.col("horizon") == 9))).unionByName(grid.filter((F.col("horizon") == 3) & (day == 14)))
    return ops.readiness(rows, ["series_id"])


@query("ag31_profile_source", f"""WITH {D_SQL}, x AS (SELECT o_orderdate AS ts, o_custkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders),
t AS (SELECT ts, count(*) AS n, count(*) FILTER (WHERE price IS NULL) AS np FROM x GROUP BY 1),
g AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts)) AS step FROM t)
SELECT 'orders' AS source, CAST(sum(n) AS BIGINT) AS "rows", min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(np) AS BIGINT) AS nulls_price, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicate_time_rows,
  count(DISTINCT step) AS distinct_steps, CAST(min(step) AS BIGINT) AS least_step_s, CAST(max(step) AS BIGINT) AS largest_step_s FROM g""")
def _(spark, d):
    rows = table(spark, d, "orders").select(
        F.lit("orders").alias("source"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("price"))
    return ops.profile_source(rows, ["source"], ["price"])


@query("ag31_step_sizes", f"""WITH {D_SQL}, s AS (SELECT series_id, CAST(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) AS BIGINT) AS step_s FROM dd)
SELECT series_id, step_s, count(*) AS steps FROM s WHERE step_s IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return quality.step_sizes(days(spark, d), ["series_id"])


@query("ag32_document_inventory", f"""WITH {P_SQL}, x AS (SELECT period_id, period_start, position FROM points UNION ALL SELECT period_id, period_start, position FROM points WHERE position = 2)
SELECT period_id, count(*) AS point_count, min(position) AS position_min, max(position) AS position_max, count(position) - count(DISTINCT position) AS duplicate_positions,
  min(period_start + (position - 1) * INTERVAL 1 HOUR) AS first_target, max(period_start + (position - 1) * INTERVAL 1 HOUR) AS last_target FROM x GROUP BY 1""")
def _(spark, d):
    points = period_points(spark, d)
    return ops.document_inventory(points.unionByName(points.filter("position = 2")), ["period_id"])
