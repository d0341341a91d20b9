"""Queries on time-series reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegrid.functions.times import DAY, HOUR, QUARTER
from tidegrid.operators import series as ops
from tidegrid.plans.adapters import (
    D_SQL, H_SQL, Q_SQL, QA_SQL, V_SQL, days, hours, quarters, quarters_all, table, vintages,
)
from tidegrid.plans.registry import query

# Orders as periods of eight hours, their line numbers as positions.
P_SQL = """line AS (
  SELECT l_orderkey AS period_id, l_linenumber AS position, max(l_extendedprice) AS value
  FROM lineitem GROUP BY 1, 2),
head AS (SELECT period_id, min(position) AS low FROM line GROUP BY 1),
points AS (
  SELECT line.period_id, CASE WHEN o_orderstatus = 'F' AND low = 1 THEN 'A03' ELSE 'A01' END AS curve_type,
    o_orderdate AS period_start, o_orderdate + INTERVAL 8 HOUR AS period_end, 'PT60M' AS resolution,
    position, value
  FROM line JOIN head USING (period_id) JOIN orders ON o_orderkey = line.period_id)"""


def period_points(spark, d):
    line = table(spark, d, "lineitem").filter("l_orderkey IS NOT NULL").groupBy(
        F.col("l_orderkey").alias("period_id"), F.col("l_linenumber").alias("position")
    ).agg(F.max("l_extendedprice").alias("value"))
    # a window over the few positions of a period, in the sort that the join needs, instead of a join with its own groups
    line = line.withColumn("low", F.min("position").over(Window.partitionBy("period_id")))
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "period_id")
    return line.join(orders, "period_id").select(
        "period_id",
        F.when((F.col("o_orderstatus") == "F") & (F.col("low") == 1), "A03").otherwise("A01").alias("curve_type"),
        F.col("o_orderdate").alias("period_start"),
        (F.col("o_orderdate") + F.expr("INTERVAL 8 HOUR")).alias("period_end"),
        F.lit("PT60M").alias("resolution"), "position", "value",
    )


@query("ts1_expand_blocks", f"""WITH {P_SQL}, nxt AS (
  SELECT *, lead(position) OVER (PARTITION BY period_id ORDER BY position) AS following FROM points),
slots AS (
  SELECT period_id, period_start, value, resolution,
    unnest(range(position, CASE WHEN curve_type = 'A03' THEN coalesce(following, 9) ELSE position + 1 END)) AS slot
  FROM nxt)
SELECT period_id, period_start + (slot - 1) * INTERVAL 1 HOUR AS ts, value, resolution FROM slots""")
def _(spark, d):
    return ops.expand_blocks(period_points(spark, d))


@query("ts2_points_to_ts", f"""WITH {P_SQL}
SELECT period_id, position, value, period_start + (position - 1) * INTERVAL 1 HOUR AS ts FROM points""")
def _(spark, d):
    return ops.points_to_ts(period_points(spark, d)).select("period_id", "position", "value", "ts")


@query("ts2_position_violations", f"""WITH {P_SQL}, short AS (
  SELECT *, period_start + (position % 5 + 2) * INTERVAL 1 HOUR AS stop FROM points)
SELECT period_id, position FROM short
WHERE position < 1 OR period_start + (position - 1) * INTERVAL 1 HOUR >= stop""")
def _(spark, d):
    points = period_points(spark, d).withColumn(
        "period_end", F.expr("period_start + make_interval(0, 0, 0, 0, position % 5 + 2)"))
    return ops.position_violations(points).select("period_id", "position")


@query("ts1_block_violations", f"""WITH {P_SQL}, bad AS (
  SELECT period_id, CASE WHEN period_id % 3 = 0 THEN 'A03' ELSE curve_type END AS curve_type,
    position, value FROM points),
facts AS (SELECT period_id, curve_type, min(position) AS low FROM bad GROUP BY 1, 2)
SELECT period_id, 'initial_coverage' AS reason FROM facts WHERE curve_type = 'A03' AND low <> 1""")
def _(spark, d):
    points = period_points(spark, d).withColumn(
        "curve_type", F.when(F.col("period_id") % 3 == 0, "A03").otherwise(F.col("curve_type")))
    return ops.block_violations(points).select("period_id", "reason")


@query("ts3_decode_diagnostics", f"""WITH {P_SQL}
SELECT period_id, curve_type, count(*) AS explicit_points, CAST(8 AS BIGINT) AS expected_slots,
  CASE WHEN curve_type = 'A03' THEN 8 ELSE count(*) END AS decoded_slots,
  CASE WHEN curve_type = 'A03' THEN 'decoded_a03_blocks' WHEN count(*) = 8 THEN 'complete_a01'
       ELSE 'upstream_missing_a01_points' END AS classification
FROM points GROUP BY 1, 2""")
def _(spark, d):
    return ops.decode_diagnostics(period_points(spark, d))


@query("ts4_densify", f"""WITH {D_SQL}, b AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM dd GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM b)
SELECT grid.series_id, grid.ts, price_eur_mwh, orders FROM grid LEFT JOIN dd ON dd.series_id = grid.series_id AND dd.ts = grid.ts""")
def _(spark, d):
    return ops.densify(days(spark, d).drop("total"), ["series_id"], DAY)


@query("ts4_densify_hours", f"""WITH {H_SQL}, b AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM h GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM b)
SELECT grid.series_id, grid.ts, value FROM grid LEFT JOIN h ON h.series_id = grid.series_id AND h.ts = grid.ts""")
def _(spark, d):
    return ops.densify(hours(spark, d), ["series_id"], HOUR)


@query("ts5_resample_mean", f"""WITH {Q_SQL}
SELECT series_id, date_trunc('hour', ts) AS ts, round(avg(value), 9) AS value FROM q GROUP BY 1, 2""")
def _(spark, d):
    return ops.resample_mean(quarters(spark, d), ["series_id"], ["value"]).withColumn("value", F.round("value", 9))


QG_ONLY = """qg AS (SELECT series_id, ts, value, CASE WHEN minute(ts) = 45 AND day(ts) % 7 = 0 THEN NULL ELSE load_mw END AS load_mw FROM qa)"""
QG_SQL = f"{QA_SQL}, {QG_ONLY}"


def gappy(spark, d):
    hole = (F.minute("ts") == 45) & (F.dayofmonth("ts") % 7 == 0)
    return quarters_all(spark, d).select("series_id", "ts", "value", F.when(~hole, F.col("load_mw")).alias("load_mw"))


@query("ts6_resample_complete", f"""WITH {QG_SQL}
SELECT series_id, date_trunc('hour', ts) AS ts, round(avg(value), 9) AS value, round(avg(load_mw), 7) AS load_mw
FROM qg GROUP BY 1, 2 HAVING count(*) = 4 AND count(load_mw) = 4""")
def _(spark, d):
    out = ops.resample_complete(gappy(spark, d), ["series_id"], ["value", "load_mw"], ["load_mw"])
    return out.withColumns({"value": F.round("value", 9), "load_mw": F.round("load_mw", 7)})


# Prices whose resolution changes at a cutover; before it only full hours exist.
QP_SQL = f"""{QA_SQL}, qp AS (
  SELECT series_id, ts, value, CASE WHEN day(ts) % 4 = 0 THEN NULL ELSE resolution END AS resolution
  FROM qa WHERE resolution = 'PT15M' OR minute(ts) = 0)"""


def price_points(spark, d):
    return quarters_all(spark, d).filter("resolution = 'PT15M' OR minute(ts) = 0").select(
        "series_id", "ts", "value", F.when(F.dayofmonth("ts") % 4 != 0, F.col("resolution")).alias("resolution"))


CUTOVER = "2024-01-16 00:00:00"


@query("ts7_hourly_prices", f"""WITH {QP_SQL}, l AS (
  SELECT *, coalesce(resolution, CASE WHEN ts >= TIMESTAMP '{CUTOVER}' THEN 'PT15M' ELSE 'PT60M' END) AS res FROM qp)
SELECT series_id, date_trunc('hour', ts) AS ts, round(avg(value), 9) AS value FROM l GROUP BY 1, 2
HAVING min(res) = max(res) AND count(value) = CASE min(res) WHEN 'PT15M' THEN 4 ELSE 1 END""")
def _(spark, d):
    out = ops.hourly_prices(price_points(spark, d), ["series_id"], "value", CUTOVER)
    return out.withColumn("value", F.round("value", 9))


@query("ts7_price_hour_violations", f"""WITH {QA_SQL}, l AS (
  SELECT series_id, ts, CASE WHEN day(ts) = 20 AND minute(ts) = 30 THEN 'PT60M'
    WHEN day(ts) = 21 THEN 'PT30M' ELSE resolution END AS res FROM qa)
SELECT series_id, date_trunc('hour', ts) AS ts,
  CASE WHEN min(res) <> max(res) THEN 'mixed_resolution' ELSE 'unsupported_resolution' END AS reason
FROM l GROUP BY 1, 2 HAVING min(res) <> max(res) OR min(res) NOT IN ('PT15M', 'PT60M')""")
def _(spark, d):
    day = F.dayofmonth("ts")
    points = quarters_all(spark, d).withColumn(
        "resolution", F.when((day == 20) & (F.minute("ts") == 30), "PT60M").when(day == 21, "PT30M")
        .otherwise(F.col("resolution")))
    return ops.price_hour_violations(points, ["series_id"], CUTOVER)


@query("ts8_hourly_load", f"""WITH {QG_SQL}
SELECT series_id, date_trunc('hour', ts) AS ts, round(avg(load_mw), 7) AS load_mw
FROM qg GROUP BY 1, 2 HAVING count(*) = 4 AND count(load_mw) = 4""")
def _(spark, d):
    out = ops.hourly_load(gappy(spark, d).select("series_id", "ts", "load_mw"), ["series_id"])
    return out.withColumn("load_mw", F.round("load_mw", 7))


G_SQL = """g AS (
  SELECT 'all' AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts,
    round(sum(value) FILTER (WHERE event_type = 'error'), 4) AS "Nuclear",
    round(sum(value), 4) AS "Solar", round(max(value), 4) AS "Wind Offshore", round(min(value), 4) AS "Wind Onshore"
  FROM events GROUP BY 1, 2)"""
NAMES = {"Nuclear": "nuclear_mw", "Solar": "solar_mw", "Wind Offshore": "wind_offshore_mw", "Wind Onshore": "wind_onshore_mw",
         "Biomass": "biomass_mw"}


def generation(spark, d):
    from tidegrid.functions.times import floor_to

    nuclear = F.sum(F.when(F.col("event_type") == "error", F.col("value")))
    return table(spark, d, "events").groupBy(floor_to("ts", QUARTER).alias("ts")).agg(
        F.round(nuclear, 4).alias("Nuclear"), F.round(F.sum("value"), 4).alias("Solar"),
        F.round(F.max("value"), 4).alias("Wind Offshore"), F.round(F.min("value"), 4).alias("Wind Onshore"),
    ).withColumn("series_id", F.lit("all"))


@query("ts8_hourly_generation", f"""WITH {G_SQL}
SELECT series_id, date_trunc('hour', ts) AS ts, round(avg("Nuclear"), 6) AS nuclear_mw, round(avg("Solar"), 6) AS solar_mw,
  round(avg("Wind Offshore"), 6) AS wind_offshore_mw, round(avg("Wind Onshore"), 6) AS wind_onshore_mw,
  round(avg("Wind Offshore") + avg("Wind Onshore"), 6) AS wind_total_mw
FROM g GROUP BY 1, 2 HAVING count(*) = 4""")
def _(spark, d):
    out = ops.hourly_generation(generation(spark, d), ["series_id"], NAMES)
    return out.select("series_id", "ts", *[F.round(c, 6).alias(c) for c in out.columns if c.endswith("_mw")])


VK = "series_id, document_id, revision_number, process_type, technology, resolution, acquired_at_utc"
VINTAGE = ("series_id", "document_id", "revision_number", "process_type", "technology", "resolution", "acquired_at_utc")
TS9_SQL = f"""{V_SQL}, hv AS (
  SELECT {VK}, date_trunc('hour', target_timestamp) AS target_hour,
    CASE WHEN resolution = 'PT15M' AND NOT (count(*) = 4 AND count(DISTINCT target_timestamp) = 4) THEN 'incomplete_pt15m_hour'
         WHEN resolution = 'PT60M' AND count(*) <> 1 THEN 'invalid_pt60m_hour' END AS reject_reason,
    round(avg(value_mw), 4) AS value_mw
  FROM v GROUP BY {VK}, date_trunc('hour', target_timestamp))"""


def vintage_hours(spark, d):
    return ops.hourly_vintages(vintages(spark, d), VINTAGE)


@query("ts9_hourly_vintages", f"""WITH {TS9_SQL} SELECT {VK}, target_hour AS target_timestamp, value_mw
FROM hv WHERE reject_reason IS NULL""")
def _(spark, d):
    return ops.accepted(vintage_hours(spark, d)).withColumn("value_mw", F.round("value_mw", 4))


@query("ts9_reject_counts", f"""WITH {TS9_SQL} SELECT reject_reason, count(*) AS rejected FROM hv
WHERE reject_reason IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return ops.reject_counts(vintage_hours(spark, d), VINTAGE)


START = "1995-01-01 00:00:00"
MISS_SQL = f"""{D_SQL}, last AS (SELECT series_id, max(ts) AS hi FROM dd GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(TIMESTAMP '{START}', hi, INTERVAL 1 DAY)) AS ts FROM last),
miss AS (SELECT * FROM grid ANTI JOIN dd USING (series_id, ts))"""


@query("ts10_missing_slots", f"WITH {MISS_SQL} SELECT series_id, ts FROM miss")
def _(spark, d):
    return ops.missing_slots(days(spark, d), ["series_id"], START, DAY)


@query("ts10_contiguous_prefix", f"""WITH {MISS_SQL}, stop AS (SELECT series_id, min(ts) AS cut FROM miss GROUP BY 1)
SELECT dd.series_id, dd.ts, price_eur_mwh FROM dd LEFT JOIN stop USING (series_id) WHERE cut IS NULL OR dd.ts < cut""")
def _(spark, d):
    return ops.contiguous_prefix(days(spark, d), ["series_id"], START, DAY).select("series_id", "ts", "price_eur_mwh")


EV_START = "2024-01-01 00:00:00"


@query("ts10_contiguous_prefix_cutover", f"""WITH {QP_SQL}, last AS (SELECT max(ts) AS hi FROM qp),
grid AS (SELECT unnest(generate_series(TIMESTAMP '{EV_START}', TIMESTAMP '2024-01-15 23:00:00', INTERVAL 1 HOUR)) AS ts
  UNION ALL SELECT unnest(generate_series(TIMESTAMP '{CUTOVER}', hi, INTERVAL 15 MINUTE)) FROM last),
miss AS (SELECT ts FROM grid ANTI JOIN qp USING (ts)),
stop AS (SELECT CASE WHEN min(ts) >= TIMESTAMP '{CUTOVER}' THEN date_trunc('hour', min(ts)) ELSE min(ts) END AS cut FROM miss)
SELECT series_id, ts, value FROM qp, stop WHERE cut IS NULL OR ts < cut""")
def _(spark, d):
    points = price_points(spark, d).select("series_id", "ts", "value")
    return ops.contiguous_prefix(points, ["series_id"], EV_START, HOUR, CUTOVER, whole_hours=True)


TS11_SQL = f"""{QP_SQL}, l AS (
  SELECT *, coalesce(resolution, CASE WHEN ts >= TIMESTAMP '{CUTOVER}' THEN 'PT15M' ELSE 'PT60M' END) AS res FROM qp),
hh AS (SELECT date_trunc('hour', ts) AS hour, min(res) AS res FROM l GROUP BY 1),
grid AS (SELECT unnest(generate_series(TIMESTAMP '{EV_START}', max(hour), INTERVAL 1 HOUR)) AS hour FROM hh),
carried AS (SELECT grid.hour, coalesce(last_value(res IGNORE NULLS) OVER (ORDER BY grid.hour), 'PT60M') AS res
  FROM grid LEFT JOIN hh ON hh.hour = grid.hour),
want AS (SELECT hour, unnest(CASE res WHEN 'PT15M' THEN [0, 15, 30, 45] ELSE [0] END) AS m FROM carried),
gaps AS (SELECT 'all' AS series_id, hour, hour + m * INTERVAL 1 MINUTE AS ts FROM want
  ANTI JOIN qp ON qp.ts = want.hour + want.m * INTERVAL 1 MINUTE)"""


@query("ts11_price_hour_slots", f"WITH {TS11_SQL} SELECT series_id, hour, ts FROM gaps")
def _(spark, d):
    return ops.price_hour_slots(price_points(spark, d), ["series_id"], EV_START, CUTOVER)


@query("ts11_contiguous_price_prefix", f"""WITH {TS11_SQL} SELECT series_id, ts, value, resolution FROM qp
WHERE ts < coalesce((SELECT min(hour) FROM gaps), TIMESTAMP '2100-01-01')""")
def _(spark, d):
    return ops.contiguous_price_prefix(price_points(spark, d), ["series_id"], EV_START, CUTOVER)


@query("ts12_gap_report", f"""WITH {MISS_SQL}, g AS (
  SELECT series_id, min(ts) AS first_gap, count(*) AS missing_count, count(DISTINCT date_trunc('hour', ts)) AS affected_hours
  FROM miss GROUP BY 1)
SELECT dd.series_id, max(dd.ts) FILTER (WHERE first_gap IS NULL OR dd.ts < first_gap) AS last_contiguous, max(dd.ts) AS last_ts,
  count(*) FILTER (WHERE dd.ts > first_gap) AS later_rows, first_gap,
  coalesce(max(missing_count), 0) AS missing_count, coalesce(max(affected_hours), 0) AS affected_hours
FROM dd LEFT JOIN g USING (series_id) GROUP BY dd.series_id, first_gap""")
def _(spark, d):
    return ops.gap_report(days(spark, d), ["series_id"], START, DAY)


@query("ts13_infer_cadence", f"""WITH {Q_SQL}, t AS (
  SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM q),
s AS (SELECT series_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) AS step FROM t WHERE rn <= 200)
SELECT series_id, CAST(coalesce(min(step) FILTER (WHERE step > 0), 900) AS BIGINT) AS cadence_s FROM s GROUP BY 1""")
def _(spark, d):
    return ops.infer_cadence(quarters(spark, d), ["series_id"], QUARTER)


@query("ts14_monthly_weather", f"""WITH {D_SQL}
SELECT series_id, date_trunc('month', ts) AS month_start, round(avg(price_eur_mwh), 9) AS price_eur_mwh, round(sum(total), 2) AS total
FROM dd GROUP BY 1, 2""")
def _(spark, d):
    out = ops.monthly_weather(days(spark, d), ["series_id"], ["price_eur_mwh"], ["total"])
    return out.withColumns({"price_eur_mwh": F.round("price_eur_mwh", 9), "total": F.round("total", 2)})


LONG_SQL = f"""{H_SQL}, k AS (SELECT unnest(range(1, 25)) AS horizon_hours),
long AS (SELECT h.series_id, h.ts, k.horizon_hours, t.value AS target_price FROM h CROSS JOIN k
  LEFT JOIN h t ON t.series_id = h.series_id AND t.ts = h.ts + k.horizon_hours * INTERVAL 1 HOUR)"""
PIVOT = ", ".join(f"max(target_price) FILTER (WHERE horizon_hours = {h}) AS target_price_{h}h" for h in ops.HORIZONS)


def long_targets(spark, d):
    from tidegrid.operators.joins import attach_targets

    base = hours(spark, d)
    out = attach_targets(base.select("series_id", "ts"), base, ["series_id"], "value")
    return out.select("series_id", F.col("issue").alias("ts"), F.col("horizon").alias("horizon_hours"),
                      F.col("target_value").alias("target_price"))


@query("ts15_pivot_horizons", f"WITH {LONG_SQL} SELECT series_id, ts, {PIVOT} FROM long GROUP BY 1, 2")
def _(spark, d):
    return ops.pivot_horizons(long_targets(spark, d), ["series_id", "ts"])


@query("ts15_horizons_long", f"WITH {LONG_SQL} SELECT series_id, ts, CAST(horizon_hours AS INTEGER) AS horizon_hours, target_price FROM long")
def _(spark, d):
    wide = ops.pivot_horizons(long_targets(spark, d), ["series_id", "ts"])
    return ops.horizons_long(wide, ["series_id", "ts"])


