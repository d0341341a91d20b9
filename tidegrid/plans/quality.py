"""Queries on data-quality reports and health states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.times import DAY, HOUR, shift
from tidegrid.operators import features, quality as ops, stats
from tidegrid.operators.evaluation import error_metrics
from tidegrid.plans.adapters import (
    F_SQL, H_SQL, Q_SQL, R_SQL, S_SQL, V_SQL, forecasts, hours, quarters, runs, silver, table, vintages,
)
from tidegrid.plans.evaluation import AG19_SQL, NOW, PAIR_SQL, named, pairs
from tidegrid.plans.features import TABLE_SQL
from tidegrid.plans.joins import COMPLETE, EXO_SQL, REQ_SQL, exogenous, requests
from tidegrid.plans.projection import MESSY_SQL, messy
from tidegrid.plans.registry import query
from tidegrid.operators.joins import complete_rows


def report(*checks, source, keys="", group=""):
    """SQL of a report: (name, status when failing, failing-count expression)."""
    return " UNION ALL ".join(
        f"SELECT {keys}'{n}' AS check_name, CASE WHEN {c} > 0 THEN '{bad}' ELSE 'PASSED' END AS status, CAST({c} AS BIGINT) AS failing FROM {source}{group}"
        for n, bad, c in checks)


@query("dq1_check_columns", "SELECT 'required_columns' AS check_name, 'FAILED' AS status, 1::BIGINT AS failing, 'o_missing' AS message FROM (SELECT count(*) AS n FROM orders) WHERE n > 0")
def _(spark, d):
    return ops.check_columns(table(spark, d, "orders"), ["o_orderkey", "o_missing"])


@query("dq2_check_timestamps", f"""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderdate END AS ts FROM orders),
r AS (SELECT *, max(ts) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x)
{report(('timestamp_parseable', 'FAILED', 'count(*) FILTER (WHERE ts IS NULL)'), ('timestamp_unique', 'FAILED', '(count(ts) - count(DISTINCT ts))'),
        ('timestamp_order', 'FAILED', 'count(*) FILTER (WHERE ts < m)'), source='r')}""")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 8 == 0, "n/a").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ts"))
    return ops.check_timestamps(rows, "ts", ingest_order="o_orderkey", width=1000)


@query("dq3_check_hourly", f"""WITH {Q_SQL} {report(('exact_hours', 'FAILED', "count(*) FILTER (WHERE ts <> date_trunc('hour', ts))"),
  ('missing_hours', 'WARNING', "floor((epoch(max(ts)) - epoch(min(ts))) / 3600) + 1 - count(DISTINCT CASE WHEN ts = date_trunc('hour', ts) THEN ts END)"),
  source='q', keys='series_id, ', group=' GROUP BY series_id')}""")
def _(spark, d):
    return ops.check_hourly(quarters(spark, d), ["series_id"])


@query("dq4_check_duplicates", f"""WITH x AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 3), n AS (SELECT count(*) AS c, (SELECT count(*) FROM (SELECT DISTINCT * FROM x)) AS u FROM x)
{report(('duplicate_rows', 'FAILED', '(c - u)'), source='n')}""")
def _(spark, d):
    lines = table(spark, d, "lineitem")
    return ops.check_duplicates(lines.unionByName(lines.filter("l_linenumber = 3")))


@query("dq5_check_nulls", f"WITH {S_SQL} {report(('null:nuclear_mw', 'FAILED', 'count(*) FILTER (WHERE nuclear_mw IS NULL)'), ('null:load_mw', 'FAILED', 'count(*) FILTER (WHERE load_mw IS NULL)'), source='s')}")
def _(spark, d):
    return ops.check_nulls(silver(spark, d), ["nuclear_mw", "load_mw"])


@query("dq6_check_numeric", f"""WITH {MESSY_SQL} {report(('unparseable:text', 'FAILED', 'count(*) FILTER (WHERE text IS NOT NULL AND (TRY_CAST(text AS DOUBLE) IS NULL OR isnan(TRY_CAST(text AS DOUBLE))))'),
  ('all_null:text', 'FAILED', 'CASE WHEN count(TRY_CAST(text AS DOUBLE)) = 0 THEN 1 ELSE 0 END'), ('unparseable:word', 'FAILED', 'count(*)'), ('all_null:word', 'FAILED', '(count(*) > 0)::INT'), source='messy')}""")
def _(spark, d):
    return ops.check_numeric(messy(spark, d).withColumn("word", F.lit("x")), ["text", "word"])


@query("dq7_check_missing_after", f"WITH {S_SQL} {report(('unexpected_null:nuclear_mw', 'FAILED', '''count(*) FILTER (WHERE nuclear_mw IS NULL AND ts < TIMESTAMP '2024-01-20 22:00:00')'''), source='s')}")
def _(spark, d):
    return ops.check_missing_after(silver(spark, d), "nuclear_mw", "2024-01-20 22:00:00")


@query("dq8_check_rows", f"""WITH {H_SQL}, n AS (SELECT series_id, count(*) AS c FROM h GROUP BY 1) {report(('minimum_rows', 'FAILED', '(c < 680)::INT'), ('split_feasible', 'FAILED', '0'), source='n', keys='series_id, ')}""")
def _(spark, d):
    return ops.check_rows(hours(spark, d), 680, ["series_id"])


@query("dq9_check_ranges", f"""WITH {S_SQL} {report(('null:ts', 'FAILED', 'count(*) FILTER (WHERE ts IS NULL)'), ('null:price_eur_mwh', 'FAILED', 'count(*) FILTER (WHERE price_eur_mwh IS NULL)'),
  ('negative:price_eur_mwh', 'FAILED', 'count(*) FILTER (WHERE price_eur_mwh < 0)'), ('negative:load_mw', 'FAILED', 'count(*) FILTER (WHERE load_mw < 0)'), source='s')}""")
def _(spark, d):
    return ops.check_ranges(silver(spark, d), ["price_eur_mwh", "load_mw"])


@query("dq10_validate_vintages", f"""WITH {V_SQL}, x AS (SELECT document_id, revision_number, target_timestamp, part_key, document_type, process_type,
  CASE WHEN part_key % 13 = 0 THEN 'COAL' ELSE technology END AS technology, CASE WHEN part_key % 11 = 0 THEN NULL ELSE value_mw END AS value_mw,
  CASE WHEN part_key % 7 = 0 THEN NULL WHEN part_key % 23 = 0 THEN 'PT15MX' ELSE resolution END AS resolution, collection_issue_time,
  CASE WHEN part_key % 19 = 0 THEN -5.0 WHEN part_key % 17 = 0 THEN 1.0 ELSE epoch(target_timestamp - source_created_at_utc) / 60 END AS horizon, part_key % 130 AS humidity,
  CASE WHEN part_key % 5 = 0 THEN source_created_at_utc - INTERVAL 1 DAY ELSE acquired_at_utc END AS acquired_at_utc, source_created_at_utc FROM v)
SELECT document_id, revision_number, target_timestamp, 'vocabulary' AS rule FROM x WHERE technology = 'COAL'
UNION ALL SELECT document_id, revision_number, target_timestamp, 'value_not_finite' FROM x WHERE value_mw IS NULL
UNION ALL SELECT document_id, revision_number, target_timestamp, 'provenance_missing' FROM x WHERE resolution IS NULL
UNION ALL SELECT document_id, revision_number, target_timestamp, 'resolution' FROM x WHERE resolution IS NULL OR resolution = 'PT15MX'
UNION ALL SELECT document_id, revision_number, target_timestamp, 'source_horizon' FROM x WHERE horizon < 0
UNION ALL SELECT document_id, revision_number, target_timestamp, 'horizon_inconsistent' FROM x WHERE part_key % 19 = 0 OR part_key % 17 = 0
UNION ALL SELECT document_id, revision_number, target_timestamp, 'range:relative_humidity_2m' FROM x WHERE humidity > 100
UNION ALL SELECT document_id, revision_number, target_timestamp, 'acquired_before_creation' FROM x WHERE collection_issue_time IS NOT NULL AND acquired_at_utc < source_created_at_utc""")
def _(spark, d):
    p = F.col("part_key")
    odd = vintages(spark, d).withColumns({
        "technology": F.when(p % 13 == 0, "COAL").otherwise(F.col("technology")), "value_mw": F.when(p % 11 != 0, F.col("value_mw")),
        "resolution": F.when(p % 7 != 0, F.when(p % 23 == 0, "PT15MX").otherwise(F.col("resolution"))),
        "source_horizon_minutes": F.when(p % 19 == 0, -5.0).when(p % 17 == 0, 1.0).otherwise(
            (F.unix_seconds("target_timestamp") - F.unix_seconds("source_created_at_utc")) / 60),
        "relative_humidity_2m": (p % 130).cast("double"),
        "acquired_at_utc": F.when(p % 5 == 0, shift("source_created_at_utc", -DAY)).otherwise(F.col("acquired_at_utc"))})
    return ops.validate_vintages(odd, ["document_id", "revision_number", "target_timestamp"])


@query("dq11_check_horizons", f"""WITH {F_SQL} SELECT series_id, model_release, forecast_issue_time, count(*) AS "rows", count(DISTINCT horizon_hours) AS valid_horizons
FROM history GROUP BY 1, 2, 3 HAVING count(*) <> 24 OR count(DISTINCT horizon_hours) <> 24""")
def _(spark, d):
    return ops.check_horizons(forecasts(spark, d), ["series_id", "model_release", "forecast_issue_time"])




@query("dq12_leakage_audit", f"""WITH {EXO_SQL}, done AS (SELECT * FROM exo WHERE {COMPLETE}),
n AS (SELECT count(*) AS c FROM done), twice AS (SELECT CASE WHEN c > 0 THEN 1 ELSE 0 END AS one, c FROM n)
SELECT check_name, CASE WHEN failing > 0 THEN 'FAILED' ELSE 'PASSED' END AS status, failing FROM (
  SELECT unnest(['unique_row_grain', 'target_after_issue', 'horizon_derived', 'horizon_in_range', 'features_are_finite', 'solar_forecast_not_from_later_cycle', 'solar_forecast_acquired_within_cycle', 'load_forecast_not_from_later_cycle', 'load_forecast_acquired_within_cycle']) AS check_name,
    unnest([0, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]) AS failing FROM twice)""")
def _(spark, d):
    rows = complete_rows(exogenous(spark, d))
    return ops.leakage_audit(rows, ["solar_forecast", "load_forecast"], ["forecast_solar_mw", "forecast_load_mw", "forecast_temperature_2m"], step_s=DAY)


@query("dq13_readiness_status", f"""WITH {REQ_SQL}, g AS (SELECT * FROM grid WHERE horizon <= CASE WHEN series_id = '5-LOW' THEN 20 ELSE 24 END)
SELECT series_id, count(DISTINCT issue) AS distinct_cycles, CASE WHEN series_id = '5-LOW' THEN 'NOT_READY' ELSE 'READY_FOR_EVALUATION' END AS status FROM g GROUP BY 1""")
def _(spark, d):
    low = F.col("series_id") == "5-LOW"
    rows = requests(spark, d).filter(~low | (F.col("horizon") <= 20))
    return stats.readiness(rows, ["series_id"]).select("series_id", "distinct_cycles", "status")


@query("dq14_issuance_audit", f"""WITH {REQ_SQL}, b AS (SELECT series_id, issue, day(issue) AS dd, month(issue) AS mm FROM issues)
SELECT series_id, issue, concat_ws(',', CASE WHEN dd = 6 THEN 'incomplete_horizons' END, CASE WHEN dd IN (7, 6) AND dd = 7 THEN 'several_snapshots' END, CASE WHEN dd = 8 THEN 'observed_not_available' END,
  CASE WHEN dd = 9 THEN 'load_forecast_acquired_late' END) AS broken FROM b WHERE dd IN (6, 7, 8, 9)""")
def _(spark, d):
    day = F.dayofmonth("issue")
    rows = requests(spark, d).filter((day != 6) | (F.col("horizon") != 2)).withColumns({
        "issue_observed_timestamp": shift("issue", -DAY),
        "observed_available_at_utc": F.when(day == 8, shift("issue", HOUR)).otherwise(F.col("issue")),
        "price": F.when(day == 7, F.col("horizon")).otherwise(F.lit(1)),
        "load_forecast_collection_issue_time": shift("issue", -DAY),
        "load_forecast_acquired_at_utc": F.when(day == 9, shift("issue", 60)).otherwise(shift("issue", -DAY)),
        "target_hour": F.hour("target_ts"), "target_month": F.month("target_ts")})
    return ops.issuance_audit(rows, ["price", "issue_observed_timestamp", "observed_available_at_utc"], ["load_forecast"], step_s=DAY)


@query("dq15_check_forecast", f"""WITH {F_SQL}, x AS (SELECT *, forecast_issue_time + horizon_hours * INTERVAL 1 HOUR <> target_timestamp AS mis,
  horizon_hours = 4 AND hour(forecast_issue_time) = 2 AS bad FROM history)
SELECT series_id, forecast_issue_time, model_release, count(*) AS "rows", count(DISTINCT horizon_hours) AS horizons, count(*) FILTER (WHERE mis) AS misaligned, count(*) FILTER (WHERE bad) AS not_finite
FROM x GROUP BY 1, 2, 3 HAVING count(*) <> 24 OR count(*) FILTER (WHERE bad) > 0""")
def _(spark, d):
    bad = (F.col("horizon_hours") == 4) & (F.hour("forecast_issue_time") == 2)
    return ops.check_forecast(forecasts(spark, d).withColumn(
        "predicted_price_eur_mwh", F.when(bad, float("nan")).otherwise(F.col("predicted_price_eur_mwh"))))


@query("dq16_recompute_audit", f"""WITH {TABLE_SQL} SELECT series_id, ts, 'price_lag_24h' AS feature FROM feat WHERE hour = 6 AND price_lag_168h IS NOT NULL AND price_rolling_mean_24h IS NOT NULL AND load_lag_24h IS NOT NULL""")
def _(spark, d):
    s = silver(spark, d)
    stored = features.issue_features(s).withColumn(
        "price_lag_24h", F.when(F.col("hour") == 6, F.col("price_lag_24h") + 1).otherwise(F.col("price_lag_24h")))
    return ops.recompute_audit(stored, s).select("series_id", "ts", "feature")


@query("dq17_check_pairs", f"""WITH {PAIR_SQL} SELECT series_id, model_release, forecast_issue_time, CAST(horizon_hours AS INTEGER) AS horizon_hours, 'absolute_error' AS rule FROM pairs WHERE horizon_hours = 5
UNION ALL SELECT series_id, model_release, forecast_issue_time, CAST(horizon_hours AS INTEGER), 'horizon' FROM pairs WHERE horizon_hours = 6
UNION ALL SELECT series_id, model_release, forecast_issue_time, CAST(horizon_hours AS INTEGER), 'duplicate_identity' FROM pairs WHERE horizon_hours = 8""")
def _(spark, d):
    h = F.col("horizon_hours")
    base = pairs(spark, d)
    odd = base.withColumns({
        "absolute_error": F.when(h == 5, F.col("absolute_error") + 1).otherwise(F.col("absolute_error")),
        "target_timestamp": F.when(h == 6, shift("target_timestamp", 3600)).otherwise(F.col("target_timestamp"))})
    return ops.check_pairs(odd.unionByName(base.filter(h == 8)))


@query("dq18_freshness", f"""WITH x AS (SELECT CASE user_id % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'silver' WHEN 2 THEN 'historical_weather' ELSE 'load' END AS source_kind,
  CASE WHEN user_id % 4 = 3 THEN ts - INTERVAL 5 HOUR ELSE ts END AS ts FROM events),
l AS (SELECT source_kind, max(ts) AS latest_ts FROM x GROUP BY 1)
SELECT source_kind, latest_ts, CASE WHEN source_kind = 'historical_weather' THEN 'Archive history' WHEN source_kind = 'silver' THEN 'Historical dataset'
  WHEN epoch(TIMESTAMP '2024-01-31 00:10:00') - epoch(latest_ts) < 0 THEN 'Future timestamp' WHEN epoch(TIMESTAMP '2024-01-31 00:10:00') - epoch(latest_ts) <= 10800 THEN 'Fresh'
  WHEN epoch(TIMESTAMP '2024-01-31 00:10:00') - epoch(latest_ts) <= 21600 THEN 'Warning' ELSE 'Stale' END AS state FROM l""")
def _(spark, d):
    k = F.col("user_id") % 4
    rows = table(spark, d, "events").select(
        F.when(k == 0, "price").when(k == 1, "silver").when(k == 2, "historical_weather").otherwise("load").alias("source_kind"),
        F.when(k == 3, shift("ts", -5 * HOUR)).otherwise(F.col("ts")).alias("ts"))
    return ops.freshness(rows, "2024-01-31 00:10:00")


VH_SQL = f"""{V_SQL}, x AS (SELECT *, date_trunc('month', collection_issue_time) AS cyc FROM v WHERE collection_issue_time IS NOT NULL),
nw AS (SELECT process_type, max(collection_issue_time) AS cycle FROM x GROUP BY 1),
cur AS (SELECT x.* FROM x JOIN nw ON nw.process_type = x.process_type AND nw.cycle = x.collection_issue_time),
dup AS (SELECT process_type, CAST(sum(c - 1) AS BIGINT) AS duplicates FROM (SELECT process_type, count(*) AS c FROM x GROUP BY document_type, process_type, document_id, revision_number, source_created_at_utc, series_id, target_timestamp, technology) GROUP BY 1),
facts AS (SELECT process_type, max(acquired_at_utc) AS latest_acquired, count(*) AS newest_rows, max(collection_issue_time) AS latest_cycle, count(DISTINCT (document_id, revision_number)) AS revisions FROM cur GROUP BY 1)"""


@query("dq19_vintage_health", f"""WITH {VH_SQL}, f AS (SELECT *, round(greatest((epoch(TIMESTAMP '2001-08-01 01:30:00') - epoch(latest_acquired)) / 60, 0), 3) AS age FROM facts JOIN dup USING (process_type))
SELECT process_type, latest_acquired, newest_rows, latest_cycle, revisions, duplicates, age AS age_minutes,
  CASE WHEN age > 180 THEN 'STALE' WHEN age > 90 OR duplicates > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM f""")
def _(spark, d):
    rows = vintages(spark, d).filter("collection_issue_time IS NOT NULL")
    out = ops.vintage_health(rows, "2001-08-01 01:30:00", ["process_type"])
    return out.select("process_type", "latest_acquired", "newest_rows", "latest_cycle", "revisions", "duplicates", "age_minutes", "status")


@query("dq19_overall_status", f"""WITH {VH_SQL}, f AS (SELECT *, (epoch(TIMESTAMP '2001-08-01 01:30:00') - epoch(latest_acquired)) / 60 AS age FROM facts JOIN dup USING (process_type)),
st AS (SELECT CASE WHEN age > 180 THEN 2 WHEN age > 90 OR duplicates > 0 THEN 1 ELSE 0 END AS r FROM f)
SELECT CASE max(r) WHEN 2 THEN 'STALE' WHEN 1 THEN 'DEGRADED' ELSE 'HEALTHY' END AS overall_status FROM st""")
def _(spark, d):
    rows = vintages(spark, d).filter("collection_issue_time IS NOT NULL")
    return ops.overall_status(ops.vintage_health(rows, "2001-08-01 01:30:00", ["process_type"]))


HEALTH_NOW = "2024-01-30 23:59:00"


@query("dq20_operational_health", f"""WITH {R_SQL}, f AS (SELECT component, arg_max(status, id) AS st, max(run_time) FILTER (WHERE status = 'SUCCESS') AS ok, max(run_time) AS core, count(*) FILTER (WHERE status = 'WARNING' AND id > 9900) AS warns,
  CAST(right(component, 1) AS INTEGER) AS k FROM runs GROUP BY 1),
h AS (SELECT *, (epoch(TIMESTAMP '{HEALTH_NOW}') - epoch(ok)) / 3600 AS sh, (epoch(TIMESTAMP '{HEALTH_NOW}') - epoch(core)) / 3600 AS ch FROM f),
r AS (SELECT component, CASE WHEN st = 'FAILED' THEN 'latest_run_failed' WHEN k = 6 THEN 'required_source_unavailable' WHEN k = 5 THEN 'quality_check_failed'
  WHEN st <> 'SUCCESS' OR sh > 6 OR ch > 6 THEN 'success_or_core_data_old' WHEN sh > 2 OR ch > 3 OR warns > 0 THEN 'condition_needs_review' ELSE 'current' END AS reason FROM h)
SELECT component, reason, CASE reason WHEN 'current' THEN 'Healthy' WHEN 'condition_needs_review' THEN 'Warning' ELSE 'Degraded' END AS label FROM r""")
def _(spark, d):
    k = F.substring("component", 2, 1).cast("int")
    facts = runs(spark, d).groupBy("component").agg(
        F.max(F.struct("id", "status"))["status"].alias("latest_run_status"),
        F.max(F.when(F.col("status") == "SUCCESS", F.col("run_time"))).alias("latest_success_time"),
        F.max("run_time").alias("oldest_core_ts"),
        F.count_if((F.col("status") == "WARNING") & (F.col("id") > 9900)).alias("warning_checks"),
    ).withColumns({
        "forecast_issue_time": F.lit(HEALTH_NOW).cast("timestamp"), "forecast_withheld": F.lit(False),
        "failed_checks": F.when(k == 5, 1).otherwise(0), "gap_count": F.lit(0), "artifacts_available": k != 6})
    return ops.operational_health(facts, HEALTH_NOW).select("component", "reason", "label")


@query("dq21_performance_state", f"""WITH {AG19_SQL}, f AS (SELECT model_release, max(pair_count) FILTER (WHERE scope = 'overall') AS pair_count, max(rmse) FILTER (WHERE name = '7d') AS r7 FROM perf GROUP BY 1),
dt AS (SELECT model_release, count(DISTINCT date_trunc('day', target_timestamp)) AS target_dates FROM pairs GROUP BY 1)
SELECT model_release, pair_count, target_dates, round(r7, 6) AS rmse_7d, CASE WHEN pair_count < 100 OR target_dates < 7 THEN 'Insufficient data'
  WHEN model_release = 'daily' THEN 'Review recommended' ELSE 'Monitoring' END AS state FROM f JOIN dt USING (model_release)""")
def _(spark, d):
    rows = pairs(spark, d)
    errors = error_metrics(named(rows), ["model_release"])
    scale = F.when(F.col("model_release") == "daily", 0.1).otherwise(2.0)
    baseline = errors.select("model_release", (F.col("rmse") * scale).alias("test_rmse"), (F.col("rmse") * scale).alias("persistence_rmse"))
    out = ops.performance_state(rows, baseline, NOW)
    return out.select("model_release", "pair_count", "target_dates", F.round("rmse_7d", 6).alias("rmse_7d"), "state")


