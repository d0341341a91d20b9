"""Queries on joins, as-of selection and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.times import DAY, HOUR, shift
from tidegrid.operators import joins as ops
from tidegrid.operators.evaluation import baselines, baselines_long, expanding_folds, regime_performance
from tidegrid.operators.series import hourly_generation, hourly_load, hourly_prices
from tidegrid.plans.adapters import (
    D_SQL, F_SQL, H_SQL, K, M_SQL, Q_SQL, S_SQL, V_SQL, actuals, days, forecasts, hours, quarters, silver,
    on_grid, stored_and_incoming, table, vintages,
)
from tidegrid.plans.registry import query
from tidegrid.plans.series import CUTOVER, G_SQL, NAMES, QG_ONLY, QP_SQL, gappy, generation, price_points

SIL_SQL = f"""{QP_SQL}, {QG_ONLY}, {G_SQL},
l AS (SELECT *, coalesce(resolution, CASE WHEN ts >= TIMESTAMP '{CUTOVER}' THEN 'PT15M' ELSE 'PT60M' END) AS res FROM qp),
p1 AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS value FROM l GROUP BY 1
  HAVING min(res) = max(res) AND count(value) = CASE min(res) WHEN 'PT15M' THEN 4 ELSE 1 END),
l1 AS (SELECT date_trunc('hour', ts) AS ts, avg(load_mw) AS load_mw FROM qg GROUP BY 1 HAVING count(*) = 4 AND count(load_mw) = 4),
g1 AS (SELECT date_trunc('hour', ts) AS ts, avg("Solar") AS solar_mw FROM g GROUP BY 1 HAVING count(*) = 4),
w1 AS (SELECT date_trunc('hour', ts) AS ts, avg(user_id) AS temperature_2m FROM events GROUP BY 1)"""


@query("jn1_build_silver", f"""WITH {SIL_SQL}
SELECT 'all' AS series_id, ts, round(value, 9) AS value, round(load_mw, 7) AS load_mw, round(solar_mw, 7) AS solar_mw,
  round(temperature_2m, 9) AS temperature_2m FROM p1 JOIN l1 USING (ts) JOIN g1 USING (ts) JOIN w1 USING (ts)""")
def _(spark, d):
    keys = ["series_id"]
    weather = table(spark, d, "events").groupBy(
        F.lit("all").alias("series_id"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("user_id").alias("temperature_2m"))
    out = ops.build_silver(
        hourly_prices(price_points(spark, d), keys, "value", CUTOVER),
        hourly_load(gappy(spark, d).select("series_id", "ts", "load_mw"), keys),
        hourly_generation(generation(spark, d), keys, NAMES).select("series_id", "ts", "solar_mw"), weather)
    return out.select("series_id", "ts", F.round("value", 9).alias("value"), F.round("load_mw", 7).alias("load_mw"),
                      F.round("solar_mw", 7).alias("solar_mw"), F.round("temperature_2m", 9).alias("temperature_2m"))


@query("jn2_join_monthly", f"""WITH {D_SQL}, m AS (
  SELECT series_id, date_trunc('month', ts) AS month_start, round(sum(total), 2) AS month_total FROM dd
  WHERE month(ts) % 5 <> 0 GROUP BY 1, 2)
SELECT dd.series_id, ts, price_eur_mwh, date_trunc('month', ts) AS month_start, month_total
FROM dd LEFT JOIN m ON m.series_id = dd.series_id AND m.month_start = date_trunc('month', ts)""")
def _(spark, d):
    base = days(spark, d).select("series_id", "ts", "price_eur_mwh", "total")
    monthly = base.filter(F.month("ts") % 5 != 0).groupBy("series_id", F.date_trunc("month", "ts").alias("month_start")).agg(
        F.round(F.sum("total"), 2).alias("month_total"))
    return ops.join_monthly(base.drop("total"), monthly, ["series_id"])


@query("jn3_value_at_offset", f"""WITH {H_SQL} SELECT h.series_id, h.ts, h.value, b.value AS value_24h_before
FROM h LEFT JOIN h b ON b.series_id = h.series_id AND b.ts = h.ts - INTERVAL 24 HOUR""")
def _(spark, d):
    return ops.value_at_offset(hours(spark, d), ["series_id"], "value", 24 * HOUR, "value_24h_before")


@query("jn4_attach_targets", f"""WITH {H_SQL}, k AS (SELECT unnest(range(1, 25)) AS horizon)
SELECT h.series_id, h.ts AS issue, CAST(horizon AS INTEGER) AS horizon, h.ts + horizon * INTERVAL 1 HOUR AS target_ts, t.value AS target_value
FROM h CROSS JOIN k LEFT JOIN h t ON t.series_id = h.series_id AND t.ts = h.ts + horizon * INTERVAL 1 HOUR""")
def _(spark, d):
    base = hours(spark, d)
    return ops.attach_targets(base.select("series_id", "ts"), base, ["series_id"], "value")


REQ_SQL = f"""{V_SQL}, c AS (
  SELECT *, coalesce(collection_issue_time, date_trunc('hour', acquired_at_utc)) AS cycle FROM v),
cv AS (SELECT * FROM c WHERE acquired_at_utc >= cycle AND acquired_at_utc < cycle + INTERVAL 1 HOUR),
issues AS (SELECT DISTINCT series_id, collection_issue_time AS issue FROM v WHERE collection_issue_time IS NOT NULL),
grid AS (SELECT series_id, issue, horizon, issue + horizon * INTERVAL 1 DAY AS target_ts
  FROM issues CROSS JOIN (SELECT unnest(range(1, 25)) AS horizon))"""
NEWEST = """cycle DESC, source_created_at_utc DESC, TRY_CAST(revision_number AS DOUBLE) DESC, acquired_at_utc DESC,
    document_id DESC, value_mw DESC, part_key DESC"""
TIES = ("value_mw", "part_key")


def requests(spark, d):
    cycles = ops.distinct_cycles([vintages(spark, d)], "collection_issue_time", ["series_id"])
    return ops.request_grid(cycles, 24, DAY)


def asked(spark, d):
    kinds = F.array(*[F.lit(t) for t in ("SOLAR", "WIND_OFFSHORE", "WIND_ONSHORE")])
    return requests(spark, d).withColumn("technology", F.explode(kinds))


def usable(spark, d):
    return ops.within_cycle(vintages(spark, d))


@query("jn5_asof_latest", f"""WITH {REQ_SQL}
SELECT series_id, technology, issue, CAST(horizon AS INTEGER) AS horizon, target_ts, document_id, revision_number, value_mw FROM (
  SELECT g.series_id, cv.technology, issue, horizon, target_ts, document_id, revision_number, value_mw, row_number() OVER (
    PARTITION BY g.series_id, cv.technology, issue, horizon ORDER BY {NEWEST}) AS rn
  FROM grid g JOIN cv ON cv.series_id = g.series_id AND cv.target_timestamp = g.target_ts AND cv.cycle <= g.issue) WHERE rn = 1""")
def _(spark, d):
    out = ops.asof_latest(asked(spark, d), usable(spark, d), ["series_id", "technology"], ops.vintage_order(TIES),
                          ["document_id", "revision_number", "value_mw"], step_s=DAY)
    return out.filter("value_mw IS NOT NULL")


@query("jn6_asof_prefer", f"""WITH {REQ_SQL}
SELECT series_id, technology, issue, CAST(horizon AS INTEGER) AS horizon, target_ts, process_type, document_id, value_mw FROM (
  SELECT g.series_id, cv.technology, issue, horizon, target_ts, process_type, document_id, value_mw, row_number() OVER (
    PARTITION BY g.series_id, cv.technology, issue, horizon ORDER BY CASE process_type WHEN 'A40' THEN 0 ELSE 1 END, {NEWEST}) AS rn
  FROM grid g JOIN cv ON cv.series_id = g.series_id AND cv.target_timestamp = g.target_ts AND cv.cycle <= g.issue) WHERE rn = 1""")
def _(spark, d):
    out = ops.asof_prefer(asked(spark, d), usable(spark, d), ["series_id", "technology"], ops.vintage_order(TIES),
                          ["process_type", "document_id", "value_mw"], step_s=DAY)
    return out.filter("value_mw IS NOT NULL")


def sky(spark, d):
    return vintages(spark, d).filter("process_type = 'A01' AND collection_issue_time IS NOT NULL").select(
        "series_id", "collection_issue_time", "acquired_at_utc", "target_timestamp", F.lit("P").alias("provider"),
        F.concat_ws("-", "document_id", F.col("part_key").cast("string")).alias("model"),
        F.col("part_key").cast("double").alias("temperature_2m"))


@query("jn7_exact_cycle", f"""WITH {REQ_SQL}, w AS (
  SELECT *, document_id || '-' || CAST(part_key AS VARCHAR) AS model FROM v WHERE process_type = 'A01' AND collection_issue_time IS NOT NULL)
SELECT series_id, issue, CAST(horizon AS INTEGER) AS horizon, target_ts, temperature_2m, model FROM (
  SELECT g.*, CAST(part_key AS DOUBLE) AS temperature_2m, model, row_number() OVER (
    PARTITION BY g.series_id, issue, horizon ORDER BY acquired_at_utc DESC, model DESC, part_key DESC) AS rn
  FROM grid g JOIN w ON w.series_id = g.series_id AND w.collection_issue_time = g.issue AND w.target_timestamp = g.target_ts) WHERE rn = 1""")
def _(spark, d):
    out = ops.exact_cycle(requests(spark, d), sky(spark, d), ["series_id"], ["temperature_2m", "model"])
    return out.filter("model IS NOT NULL")


@query("jn8_request_grid", f"WITH {REQ_SQL} SELECT series_id, issue, CAST(horizon AS INTEGER) AS horizon, target_ts FROM grid")
def _(spark, d):
    return requests(spark, d)


# The exogenous frame runs on one series, on which all parts meet often. Lines are dealt to the five technologies;
# those in quarters come as four points, of which one is missing for some.
KINDS = ("TOTAL_LOAD", "TOTAL_GENERATION", "SOLAR", "WIND_OFFSHORE", "WIND_ONSHORE")
KIND_SQL = "CASE part_key % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
EXO_SQL = REQ_SQL.replace("o_orderpriority AS series_id", "'all' AS series_id") + f""",
f1 AS (SELECT o_orderdate AS ts, count(*) AS orders, round(avg(o_totalprice) * {K}) / 1024 AS price FROM orders GROUP BY 1),
pts AS (SELECT cv.* REPLACE ({KIND_SQL} AS technology, CASE WHEN part_key % 5 < 2 THEN 'A01' ELSE process_type END AS process_type,
    round(value_mw * 1024) / 1024 + q AS value_mw, target_timestamp + q * INTERVAL 15 MINUTE AS target_timestamp)
  FROM cv JOIN (SELECT unnest([0, 1, 2, 3]) AS q) ON q = 0 OR (resolution = 'PT15M' AND NOT (q = 3 AND part_key % 11 = 0))),
hv AS (SELECT technology, process_type, document_id, revision_number, source_created_at_utc, cycle, acquired_at_utc, resolution,
    date_trunc('hour', target_timestamp) AS target_timestamp, avg(value_mw) AS value_mw
  FROM pts GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9 HAVING count(*) = CASE resolution WHEN 'PT15M' THEN 4 ELSE 1 END),
pick AS (SELECT * FROM (SELECT g.issue, g.horizon, hv.technology, hv.process_type, hv.value_mw, row_number() OVER (
    PARTITION BY g.issue, g.horizon, hv.technology ORDER BY CASE process_type WHEN 'A40' THEN 0 ELSE 1 END,
    cycle DESC, source_created_at_utc DESC, TRY_CAST(revision_number AS DOUBLE) DESC, acquired_at_utc DESC, document_id DESC, value_mw DESC, process_type DESC) AS rn
  FROM grid g JOIN hv ON hv.target_timestamp = g.target_ts AND hv.cycle <= g.issue) WHERE rn = 1),
tech AS (SELECT issue, horizon, {", ".join(f"max(value_mw) FILTER (WHERE technology = '{k}') AS {n}" for k, n in zip(KINDS, ("load", "generation", "solar", "off", "onsh"), strict=True))},
    max(process_type) FILTER (WHERE technology = 'SOLAR') AS solar_process FROM pick GROUP BY 1, 2),
w AS (SELECT *, document_id || '-' || CAST(part_key AS VARCHAR) AS model FROM v WHERE process_type = 'A01' AND collection_issue_time IS NOT NULL
  AND acquired_at_utc >= collection_issue_time AND acquired_at_utc < collection_issue_time + INTERVAL 1 HOUR),
sky AS (SELECT issue, horizon, temperature_2m FROM (SELECT g.issue, g.horizon, CAST(part_key AS DOUBLE) AS temperature_2m, row_number() OVER (
    PARTITION BY g.issue, g.horizon ORDER BY acquired_at_utc DESC, model DESC, part_key DESC) AS rn
  FROM grid g JOIN w ON w.collection_issue_time = g.issue AND w.target_timestamp = g.target_ts) WHERE rn = 1),
exo AS (SELECT g.issue, CAST(g.horizon AS INTEGER) AS horizon, g.target_ts, fi.orders, ft.price AS target_price, load, generation, solar, off, onsh, solar_process, temperature_2m
  FROM grid g LEFT JOIN tech ON tech.issue = g.issue AND tech.horizon = g.horizon LEFT JOIN sky ON sky.issue = g.issue AND sky.horizon = g.horizon
  LEFT JOIN f1 fi ON fi.ts = g.issue LEFT JOIN f1 ft ON ft.ts = g.target_ts)"""
PARTS = ("load", "generation", "solar", "off", "onsh")
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in ("orders", "target_price", *PARTS, "temperature_2m"))


def _points(df):
    """Source rows of the five technologies, in quarters where the resolution says so."""
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("part_key") % 5).cast("int"))
    documents = F.create_map(*[F.lit(x) for k in KINDS for x in (k, ops.TECHNOLOGIES[k][1])])
    quarters = F.when(F.col("resolution") != "PT15M", F.array(F.lit(0))).when(
        F.col("part_key") % 11 == 0, F.array(*[F.lit(q) for q in range(3)])).otherwise(F.array(*[F.lit(q) for q in range(4)]))
    rows = df.withColumns({"technology": kind, "document_type": documents[kind], "q": F.explode(quarters),
                           "process_type": F.when(F.col("part_key") % 5 < 2, "A01").otherwise(F.col("process_type"))})
    return rows.withColumns({"value_mw": on_grid(F.col("value_mw")) + F.col("q"), "target_timestamp": shift("target_timestamp", F.col("q") * 900)})


def exogenous(spark, d):
    whole = F.lit("all").alias("series_id")

    def one(df):
        return df.withColumn("series_id", F.lit("all"))

    base = table(spark, d, "orders").groupBy(whole, F.col("o_orderdate").alias("ts")).agg(
        F.count("*").alias("orders"), (F.round(F.avg("o_totalprice") * K, 0) / 1024).alias("price"))
    cycles = ops.distinct_cycles([one(vintages(spark, d))], "collection_issue_time", ["series_id"])
    return ops.build_exogenous(cycles, base.select("series_id", "ts", "orders"), base.select("series_id", "ts", "price"),
                               _points(one(vintages(spark, d))), one(sky(spark, d)), ["temperature_2m"], step_s=DAY)


@query("jn9_exogenous_frame", f"""WITH {EXO_SQL}
SELECT issue, horizon, target_ts, orders, target_price, load AS forecast_load_mw, generation AS forecast_total_generation_mw, solar AS forecast_solar_mw,
  solar_process AS solar_forecast_process_type, round(off + onsh, 4) AS forecast_wind_total_mw, temperature_2m AS forecast_temperature_2m,
  CAST((dayofweek(target_ts) + 6) % 7 AS INTEGER) AS target_day_of_week FROM exo WHERE {COMPLETE}""")
def _(spark, d):
    return ops.complete_rows(exogenous(spark, d)).select(
        "issue", "horizon", "target_ts", "orders", "target_price", "forecast_load_mw", "forecast_total_generation_mw", "forecast_solar_mw",
        "solar_forecast_process_type", F.round("forecast_wind_total_mw", 4).alias("forecast_wind_total_mw"), "forecast_temperature_2m", "target_day_of_week")


@query("jn10_match_realized", f"""WITH {F_SQL}
SELECT f.series_id, model_release, forecast_issue_time, CAST(horizon_hours AS INTEGER) AS horizon_hours, issued_at_utc, f.target_timestamp,
  predicted_price_eur_mwh, a.price_eur_mwh AS actual_price_eur_mwh, round(predicted_price_eur_mwh - a.price_eur_mwh, 6) AS signed_error
FROM history f JOIN actual a ON a.series_id = f.series_id AND a.target_timestamp = f.target_timestamp
WHERE forecast_issue_time < f.target_timestamp AND issued_at_utc < f.target_timestamp
  AND f.target_timestamp + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-25 12:00:00'""")
def _(spark, d):
    out = ops.match_realized(forecasts(spark, d), actuals(spark, d), "2024-01-25 12:00:00", check=True)
    return out.drop("absolute_error", "squared_error").withColumn("signed_error", F.round("signed_error", 6))


@query("jn10_match_violations", f"""WITH {F_SQL}
SELECT 'prediction_not_finite' AS reason FROM history WHERE horizon_hours = 5
UNION ALL SELECT 'target_alignment' FROM history WHERE horizon_hours = 7""")
def _(spark, d):
    h = F.col("horizon_hours")
    odd = forecasts(spark, d).withColumns({
        "predicted_price_eur_mwh": F.when(h == 5, float("nan")).otherwise(F.col("predicted_price_eur_mwh")),
        "target_timestamp": F.when(h == 7, shift("target_timestamp", 60)).otherwise(F.col("target_timestamp"))})
    return ops.match_violations(odd, actuals(spark, d))


@query("jn11_weekly_asof", f"""WITH {H_SQL}, rev AS (
  SELECT series_id, ts, ts + INTERVAL 70 MINUTE AS available_at_utc, value FROM h
  UNION ALL SELECT series_id, ts, ts + INTERVAL 150 HOUR, value + 1 FROM h),
req AS (SELECT series_id, ts AS issue, horizon, ts + horizon * INTERVAL 1 HOUR AS target_ts FROM h CROSS JOIN (SELECT unnest(range(1, 25)) AS horizon))
SELECT series_id, issue, CAST(horizon AS INTEGER) AS horizon, target_ts, weekly_value FROM (
  SELECT req.*, rev.value AS weekly_value, row_number() OVER (PARTITION BY req.series_id, issue, horizon ORDER BY available_at_utc DESC) AS rn
  FROM req JOIN rev ON rev.series_id = req.series_id AND rev.ts = req.target_ts - INTERVAL 168 HOUR AND available_at_utc <= issue) WHERE rn = 1""")
def _(spark, d):
    base = hours(spark, d)
    first = base.select("series_id", "ts", shift("ts", 70 * 60).alias("available_at_utc"), "value")
    later = base.select("series_id", "ts", shift("ts", 150 * HOUR).alias("available_at_utc"), (F.col("value") + 1).alias("value"))
    req = ops.request_grid(base.select("series_id", F.col("ts").alias("issue")))
    return ops.weekly_asof(req, first.unionByName(later)).filter("weekly_value IS NOT NULL")


@query("jn12_overlap_conflicts", f"""WITH {M_SQL}, j AS (
  SELECT s.series_id, s.ts, s.price AS p0, i.price AS p1, s.total AS t0, i.total AS t1 FROM stored s JOIN incoming i USING (series_id, ts))
SELECT series_id, ts, 'price' AS "column" FROM j WHERE (p0 IS NULL) <> (p1 IS NULL) OR abs(p0 - p1) > 1e-12 + 1e-9 * abs(p1)
UNION ALL SELECT series_id, ts, 'total' FROM j WHERE abs(t0 - t1) > 1e-12 + 1e-9 * abs(t1)""")
def _(spark, d):
    return ops.overlap_conflicts(*stored_and_incoming(spark, d), ["series_id", "ts"]).select("series_id", "ts", "column")


@query("jn13_overlapping_periods", """WITH p AS (
  SELECT o_custkey AS cust, o_orderkey AS period_id, o_orderdate AS start_ts, o_orderdate + o_orderkey % 40 * INTERVAL 1 DAY AS end_ts FROM orders),
m AS (SELECT *, max(end_ts) OVER (PARTITION BY cust ORDER BY start_ts, period_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_end FROM p)
SELECT * FROM m WHERE previous_end > start_ts""")
def _(spark, d):
    periods = table(spark, d, "orders").select(
        F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("period_id"), F.col("o_orderdate").alias("start_ts"),
        shift("o_orderdate", F.col("o_orderkey") % 40 * DAY).alias("end_ts"))
    return ops.overlapping_periods(periods, ["cust"])


@query("jn14_missing_keys", "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def _(spark, d):
    seen = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return ops.missing_keys(table(spark, d, "customer").select("c_custkey"), seen, ["c_custkey"])


@query("jn15_new_rows", f"WITH {M_SQL} SELECT * FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.series_id = i.series_id AND s.ts = i.ts)")
def _(spark, d):
    return ops.new_rows(*stored_and_incoming(spark, d), ["series_id", "ts"])


@query("jn16_verify_receipts", f"""WITH {F_SQL}, receipts AS (
  SELECT *, issued_at_utc - (horizon_hours * 20 - 60) * INTERVAL 1 SECOND AS completed_at FROM history WHERE horizon_hours % 3 <> 0)
SELECT h.series_id, h.model_release, h.forecast_issue_time, CAST(h.horizon_hours AS INTEGER) AS horizon_hours, count(*) AS receipts
FROM history h JOIN receipts r ON r.series_id = h.series_id AND r.model_release = h.model_release AND r.forecast_issue_time = h.forecast_issue_time
  AND r.horizon_hours = h.horizon_hours AND r.predicted_price_eur_mwh = h.predicted_price_eur_mwh
WHERE completed_at <= h.issued_at_utc AND h.issued_at_utc <= completed_at + INTERVAL 5 MINUTE GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    history = forecasts(spark, d)
    receipts = history.filter("horizon_hours % 3 <> 0").withColumn(
        "completed_at", shift("issued_at_utc", 60 - F.col("horizon_hours") * 20))
    return ops.verify_receipts(history, receipts).select(
        "series_id", "model_release", "forecast_issue_time", "horizon_hours", "receipts")


NOW = "2024-01-29 07:30:00"
W = "PARTITION BY series_id ORDER BY ts RANGE BETWEEN"
JN17_SQL = f"""{S_SQL},
p AS (SELECT *, max(price_eur_mwh) OVER ({W} INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS price_lag_1h,
   max(price_eur_mwh) OVER ({W} INTERVAL 24 HOUR PRECEDING AND INTERVAL 24 HOUR PRECEDING) AS price_lag_24h,
   max(price_eur_mwh) OVER ({W} INTERVAL 168 HOUR PRECEDING AND INTERVAL 168 HOUR PRECEDING) AS price_lag_168h,
   count(price_eur_mwh) OVER ({W} INTERVAL 23 HOUR PRECEDING AND CURRENT ROW) AS n,
   avg(price_eur_mwh) OVER ({W} INTERVAL 23 HOUR PRECEDING AND CURRENT ROW) AS price_rolling_mean_24h,
   stddev_samp(price_eur_mwh) OVER ({W} INTERVAL 23 HOUR PRECEDING AND CURRENT ROW) AS price_rolling_std_24h,
   max(load_mw) OVER ({W} INTERVAL 24 HOUR PRECEDING AND INTERVAL 24 HOUR PRECEDING) AS load_lag_24h,
   avg(load_mw) OVER ({W} INTERVAL 23 HOUR PRECEDING AND CURRENT ROW) AS load_rolling_mean_24h FROM s)"""


@query("jn17_issue_features", f"""WITH {JN17_SQL}
SELECT series_id, ts, price_eur_mwh, price_lag_1h, price_lag_24h, price_lag_168h, round(price_rolling_mean_24h, 9) AS price_rolling_mean_24h,
  round(price_rolling_std_24h, 6) AS price_rolling_std_24h, load_lag_24h, round(load_rolling_mean_24h, 7) AS load_rolling_mean_24h,
  coalesce(nuclear_mw, 0) AS nuclear_mw, temperature_2m, CAST(hour(ts) AS INTEGER) AS hour
FROM p WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 3 HOUR AND ts < date_trunc('hour', TIMESTAMP '{NOW}') AND n = 24
  AND price_lag_168h IS NOT NULL ORDER BY ts DESC LIMIT 1""")
def _(spark, d):
    s = silver(spark, d)
    gen = ("biomass_mw", "lignite_mw", "gas_mw", "hard_coal_mw", "hydro_mw", "nuclear_mw", "solar_mw",
           "wind_offshore_mw", "wind_onshore_mw", "wind_total_mw")
    out = ops.issue_features(s.select("series_id", "ts", "price_eur_mwh"), s.select("series_id", "ts", "load_mw"),
                             s.select("series_id", "ts", *gen), s.select("series_id", "ts", "temperature_2m"), NOW)
    return out.select("series_id", "ts", "price_eur_mwh", "price_lag_1h", "price_lag_24h", "price_lag_168h",
                      F.round("price_rolling_mean_24h", 9).alias("price_rolling_mean_24h"),
                      F.round("price_rolling_std_24h", 6).alias("price_rolling_std_24h"), "load_lag_24h",
                      F.round("load_rolling_mean_24h", 7).alias("load_rolling_mean_24h"), "nuclear_mw", "temperature_2m", "hour")


# Regime errors of the naive predictions, and an "untuned" reference with larger errors.
BASE_SQL = f"""{D_SQL}, b AS (
  SELECT x.series_id, x.ts + INTERVAL 1 DAY AS target_ts, y.price_eur_mwh AS actual, m.model_name,
    CASE m.model_name WHEN 'Persistence Baseline' THEN x.price_eur_mwh WHEN 'Daily Seasonal Naive' THEN d24.price_eur_mwh ELSE w.price_eur_mwh END AS predicted
  FROM dd x JOIN dd y ON y.series_id = x.series_id AND y.ts = x.ts + INTERVAL 1 DAY
  LEFT JOIN dd d24 ON d24.series_id = x.series_id AND d24.ts = x.ts - INTERVAL 23 DAY
  LEFT JOIN dd w ON w.series_id = x.series_id AND w.ts = x.ts - INTERVAL 167 DAY
  CROSS JOIN (SELECT unnest(['Persistence Baseline', 'Daily Seasonal Naive', 'Weekly Seasonal Naive']) AS model_name) m),
pred AS (SELECT series_id, model_name, CAST(year(target_ts) AS VARCHAR) AS validation_period, target_ts, actual, predicted,
   CASE WHEN actual < 0 THEN 'Negative' WHEN actual < 100 THEN 'Normal' WHEN actual < 200 THEN 'High' ELSE 'Extreme' END AS price_regime
  FROM b WHERE predicted IS NOT NULL AND year(target_ts) BETWEEN 1997 AND 1999)"""


def predictions(spark, d):
    wide = baselines(days(spark, d), step_s=DAY).filter("actual IS NOT NULL")
    long = baselines_long(wide).filter("predicted IS NOT NULL")
    folds = expanding_folds(long, (1997, 1998, 1999), "2000-01-01").filter("role = 'validation'")
    return folds.withColumn("feature_group", F.lit("naive"))


@query("jn18_join_reference", f"""WITH {BASE_SQL}, r AS (
  SELECT model_name, validation_period, price_regime, sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse FROM pred GROUP BY 1, 2, 3)
SELECT model_name, validation_period, price_regime, round(rmse, 6) AS rmse, round(rmse * 2 + 1, 6) AS untuned_reference_rmse,
  round((rmse * 2 + 1 - rmse) / (rmse * 2 + 1) * 100, 6) AS rmse_improvement_vs_untuned_pct FROM r""")
def _(spark, d):
    regimes = regime_performance(predictions(spark, d)).filter(
        "validation_period <> 'All Development Folds' AND rmse IS NOT NULL").select(
        "model_name", "validation_period", "price_regime", "rmse")
    out = ops.join_reference(regimes, regimes.withColumn("rmse", F.col("rmse") * 2 + 1))
    return out.withColumns({c: F.round(c, 6) for c in ("rmse", "untuned_reference_rmse", "rmse_improvement_vs_untuned_pct")})


@query("jn19_issuance_evidence", f"""WITH {F_SQL}, st AS (
  SELECT series_id, model_release, forecast_issue_time, horizon_hours, target_timestamp, forecast_issue_time + INTERVAL 5 MINUTE AS issued_at_utc,
    CASE WHEN hour(forecast_issue_time) = 3 AND horizon_hours = 9 THEN predicted_price_eur_mwh + 1 ELSE predicted_price_eur_mwh END AS p
  FROM history WHERE hour(forecast_issue_time) <> 5),
j AS (SELECT h.series_id, h.model_release, h.forecast_issue_time, st.issued_at_utc,
    coalesce(st.p = h.predicted_price_eur_mwh AND st.issued_at_utc < h.target_timestamp, false) AS same
  FROM history h LEFT JOIN st ON st.series_id = h.series_id AND st.model_release = h.model_release
    AND st.forecast_issue_time = h.forecast_issue_time AND st.horizon_hours = h.horizon_hours),
f AS (SELECT series_id, model_release, forecast_issue_time, count(*) FILTER (WHERE same) AS matched, min(issued_at_utc) FILTER (WHERE same) AS issued FROM j GROUP BY 1, 2, 3)
SELECT series_id, model_release, forecast_issue_time, matched, CASE WHEN matched = 24 THEN 'available' WHEN matched = 0 THEN 'missing'
  ELSE 'no_matching_complete_issue' END AS evidence, CASE WHEN matched = 24 THEN issued END AS issued_at_utc FROM f""")
def _(spark, d):
    history = forecasts(spark, d)
    hour = F.hour("forecast_issue_time")
    stored = history.filter(hour != 5).withColumns({
        "issued_at_utc": shift("forecast_issue_time", 300),
        "predicted_price_eur_mwh": F.when((hour == 3) & (F.col("horizon_hours") == 9), F.col("predicted_price_eur_mwh") + 1)
        .otherwise(F.col("predicted_price_eur_mwh"))})
    return ops.issuance_evidence(stored, history)


@query("jn20_compare_coverage", f"""WITH {Q_SQL}, st AS (SELECT series_id, ts, value FROM q WHERE ts < TIMESTAMP '2024-01-20 05:10:00'),
src AS (SELECT series_id, ts, CASE WHEN points = 1 THEN NULL ELSE value END AS value FROM q WHERE hour(ts) <> 4),
target AS (SELECT DISTINCT series_id, ts + INTERVAL 15 MINUTE AS ts FROM q),
latest AS (SELECT series_id, max(ts) AS hi FROM st GROUP BY 1)
SELECT t.series_id, t.ts, CASE WHEN src.ts IS NULL THEN 'ABSENT' WHEN src.value IS NULL THEN 'INCOMPLETE' ELSE 'PRESENT' END AS source_state,
  CASE WHEN st.ts IS NULL THEN 'ABSENT' ELSE 'PRESENT' END AS stored_state,
  t.ts >= hi - INTERVAL 48 HOUR AND t.ts < TIMESTAMP '2024-01-20 06:00:00' AS overlap_revisits
FROM target t LEFT JOIN src ON src.series_id = t.series_id AND src.ts = t.ts LEFT JOIN st ON st.series_id = t.series_id AND st.ts = t.ts
JOIN latest ON latest.series_id = t.series_id""")
def _(spark, d):
    q = quarters(spark, d)
    stored = q.filter(F.col("ts") < F.lit("2024-01-20 05:10:00").cast("timestamp"))
    source = q.filter(F.hour("ts") != 4).withColumn("value", F.when(F.col("points") != 1, F.col("value")))
    targets = q.select("series_id", shift("ts", 900).alias("ts")).distinct()
    return ops.compare_coverage(targets, source, stored, ["series_id"], "value", "2024-01-20 06:20:00")


@query("st4_distinct_cycles", """SELECT DISTINCT o_orderdate AS issue FROM orders UNION SELECT DISTINCT l_shipdate FROM lineitem""")
def _(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderdate").alias("cycle"))
    return ops.distinct_cycles([orders, table(spark, d, "lineitem").select(F.col("l_shipdate").alias("cycle"))], "cycle")


@query("st6_difference", "SELECT DISTINCT l_shipdate AS day FROM lineitem EXCEPT SELECT o_orderdate FROM orders")
def _(spark, d):
    return ops.difference(table(spark, d, "lineitem").select(F.col("l_shipdate").alias("day")),
                          table(spark, d, "orders").select(F.col("o_orderdate").alias("day")))
