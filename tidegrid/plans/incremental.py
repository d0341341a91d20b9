"""Queries on incremental ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.times import QUARTER
from tidegrid.operators import incremental as ops
from tidegrid.plans.adapters import H_SQL, Q_SQL, S_SQL, hours, quarters, silver
from tidegrid.plans.registry import query

NOW = "2024-01-28 12:40:00"
HISTORY = "2024-01-01 00:00:00"

for kind, start in (("price", "greatest(date_trunc('hour', latest_ts) - INTERVAL 48 HOUR, TIMESTAMP '2024-01-01 00:00:00')"),
                    ("load", "greatest(latest_ts - INTERVAL 48 HOUR, TIMESTAMP '2024-01-01 00:00:00')"),
                    ("weather", "latest_ts + cadence_s * INTERVAL 1 SECOND")):
    @query(f"in1_incremental_start_{kind}", f"""WITH {Q_SQL}, st AS (SELECT series_id, ts FROM q WHERE ts < TIMESTAMP '2024-01-26 07:20:00'),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM st),
c AS (SELECT series_id, CAST(min(step) AS BIGINT) AS cadence_s FROM (SELECT series_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) AS step FROM r WHERE rn <= 200) WHERE step > 0 GROUP BY 1),
l AS (SELECT series_id, max(ts) AS latest_ts FROM st GROUP BY 1)
SELECT series_id, latest_ts, cadence_s, {start} AS start_ts, TIMESTAMP '2024-01-28 12:00:00' AS end_ts, {start} < TIMESTAMP '2024-01-28 12:00:00' AS due FROM l JOIN c USING (series_id)""")
    def _(spark, d, kind=kind):
        stored = quarters(spark, d).filter("ts < '2024-01-26 07:20:00'").select("series_id", "ts")
        return ops.incremental_start(stored, kind, NOW, HISTORY, default_s=QUARTER)


# A stored table up to the 25th, and a source that revised one value a day.
ING_SQL = f"""{H_SQL}, st AS (SELECT series_id, ts, CASE WHEN hour(ts) = 5 THEN NULL ELSE value END AS value FROM h WHERE ts < TIMESTAMP '2024-01-27 00:00:00'),
due AS (SELECT series_id, ts, CASE WHEN hour(ts) = 9 THEN value + 1 ELSE value END AS value FROM h WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND ts < TIMESTAMP '2024-01-28 12:00:00')"""
ING_START = "2024-01-24 00:00:00"


def increment(spark, d):
    base = hours(spark, d)
    stored = base.filter("ts < '2024-01-27'").withColumn("value", F.when(F.hour("ts") != 5, F.col("value")))
    source = base.withColumn("value", F.col("value") + F.when(F.hour("ts") == 9, 1).otherwise(0))
    return ops.ingest_increment(stored, source, "load", NOW, ING_START)


@query("in2_ingest_increment", f"""WITH {ING_SQL} SELECT coalesce(st.series_id, due.series_id) AS series_id, coalesce(st.ts, due.ts) AS ts,
  CASE WHEN st.ts IS NULL OR st.value IS NULL THEN due.value WHEN due.value IS NOT NULL AND due.ts >= TIMESTAMP '2024-01-26 12:00:00' THEN due.value ELSE st.value END AS value
FROM st FULL JOIN due ON due.series_id = st.series_id AND due.ts = st.ts""")
def _(spark, d):
    return increment(spark, d).merge.data


@query("in2_ingest_audit", f"""WITH {ING_SQL}, j AS (SELECT coalesce(st.ts, due.ts) AS ts, st.ts IS NOT NULL AS had, due.ts IS NOT NULL AS got, st.value AS a, due.value AS b FROM st FULL JOIN due ON due.series_id = st.series_id AND due.ts = st.ts),
o AS (SELECT *, CASE WHEN had AND got AND a IS NULL AND b IS NOT NULL THEN 'repaired' WHEN had AND got AND abs(a - b) > 1e-12 + 1e-9 * abs(b) THEN CASE WHEN ts >= TIMESTAMP '2024-01-26 12:00:00' THEN 'revised' ELSE 'protected' END END AS k FROM j)
SELECT count(*) FILTER (WHERE NOT had) AS new_rows, 'value' AS column_name, count(*) FILTER (WHERE k = 'repaired') AS repaired, count(*) FILTER (WHERE k = 'revised') AS revised,
  count(*) FILTER (WHERE k = 'protected') AS protected, min(ts) FILTER (WHERE k = 'protected') AS first_protected, max(ts) FILTER (WHERE k = 'protected') AS last_protected FROM o""")
def _(spark, d):
    return increment(spark, d).merge.audit


@query("in2_ingest_gaps", f"""WITH {ING_SQL}, lim AS (SELECT series_id, max(ts) AS hi FROM due GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(TIMESTAMP '{ING_START}', hi, INTERVAL 1 HOUR)) AS ts FROM lim), miss AS (SELECT * FROM grid ANTI JOIN due USING (series_id, ts)),
g AS (SELECT series_id, min(ts) AS first_gap, count(*) AS n FROM miss GROUP BY 1)
SELECT due.series_id, max(ts) FILTER (WHERE first_gap IS NULL OR ts < first_gap) AS last_contiguous, max(ts) AS last_ts, count(*) FILTER (WHERE ts > first_gap) AS later_rows, first_gap,
  coalesce(max(n), 0) AS missing_count, coalesce(max(n), 0) AS affected_hours FROM due LEFT JOIN g USING (series_id) GROUP BY 1, 5""")
def _(spark, d):
    return increment(spark, d).gaps


@query("in3_advanced", f"""WITH {H_SQL}, w AS (SELECT series_id, max(ts) FILTER (WHERE ts < TIMESTAMP '2024-01-20 00:00:00') AS b, max(ts) AS a FROM h GROUP BY 1)
SELECT series_id, a > b AS moved, false AS unmoved, true AS first_time FROM w""")
def _(spark, d):
    marks = hours(spark, d).groupBy("series_id").agg(
        F.max(F.when(F.col("ts") < F.lit("2024-01-20").cast("timestamp"), F.col("ts"))).alias("b"), F.max("ts").alias("a"))
    return marks.select("series_id", ops.advanced(F.col("b"), F.col("a")).alias("moved"), ops.advanced(F.col("a"), F.col("a")).alias("unmoved"),
                        ops.advanced(F.lit(None).cast("timestamp"), F.col("a")).alias("first_time"))


@query("in4_trim_unpublished", f"""WITH {S_SQL} SELECT series_id, ts, price_eur_mwh, load_mw FROM s WHERE ts <= TIMESTAMP '2024-01-29 20:00:00'""")
def _(spark, d):
    late = F.col("ts") > F.lit("2024-01-29 20:00:00").cast("timestamp")
    rows = silver(spark, d).select("series_id", "ts", "price_eur_mwh", F.when(~late, F.col("load_mw")).alias("load_mw"))
    return ops.trim_unpublished(rows, ["series_id"], ["price_eur_mwh", "load_mw"])


@query("in5_pending_targets", f"""WITH {H_SQL} SELECT series_id, ts, value, ts + INTERVAL 1 HOUR AS target_ts FROM h WHERE series_id = 'view' OR ts + INTERVAL 1 HOUR > (
  SELECT max(p.ts) FROM h p WHERE p.series_id = h.series_id AND p.ts < TIMESTAMP '2024-01-25 00:00:00')""")
def _(spark, d):
    base = hours(spark, d)
    stored = base.filter("ts < '2024-01-25' AND series_id <> 'view'").select("series_id", F.col("ts").alias("target_ts"))
    return ops.pending_targets(base, stored)
