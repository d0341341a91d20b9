"""Views of the driver tables in the shapes that the operators expect.

Each view exists twice: as a DataFrame, and as the text of a SQL common table
expression with the same columns, which the oracle statements build on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampNTZType, TimestampType

from tidegrid.functions.times import DAY, HOUR, QUARTER, floor_to, shift


# Values lie on a grid of 1/1024, on which sums are exact in any order, so both
# engines agree to the last bit. Means are scaled by K first, which keeps them
# off the ties of that rounding.
K = 1.2345678901


def on_grid(column):
    return F.round(column * 1024, 0) / 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with zone-less timestamps declared as UTC instants.

    Declaring the type at the scan, instead of casting after it, lets time
    filters reach the Parquet reader.
    """
    path = f"{sf_dir}/{name}.parquet"
    stored = spark.read.parquet(path).schema
    declared = StructType([
        StructField(f.name, TimestampType() if isinstance(f.dataType, TimestampNTZType) else f.dataType, f.nullable)
        for f in stored])
    return spark.read.schema(declared).parquet(path)


# --- Q: quarter-hour observations of each event type -------------------------
Q_SQL = f"""q AS (
  SELECT event_type AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts,
         round((avg(value) * {K}) * 1024) / 1024 AS value, count(*) AS points
  FROM events GROUP BY 1, 2)"""


def quarters(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(
        F.col("event_type").alias("series_id"), floor_to("ts", QUARTER).alias("ts")
    ).agg(on_grid(F.avg("value") * K).alias("value"), F.count("*").alias("points"))


# --- QA: quarter-hour observations of all events, one series -----------------
QA_SQL = f"""qa AS (
  SELECT 'all' AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts,
         round((avg(value) * {K}) * 1024) / 1024 AS value, round((sum(value)) * 1024) / 1024 AS load_mw,
         CASE WHEN time_bucket(INTERVAL 15 MINUTE, ts) < TIMESTAMP '2024-01-16 00:00:00'
              THEN 'PT60M' ELSE 'PT15M' END AS resolution
  FROM events GROUP BY 1, 2)"""


def quarters_all(spark, d) -> DataFrame:
    slot = floor_to("ts", QUARTER)
    return (
        table(spark, d, "events").groupBy(slot.alias("ts"))
        .agg(on_grid(F.avg("value") * K).alias("value"), on_grid(F.sum("value")).alias("load_mw"))
        .select(
            F.lit("all").alias("series_id"), "ts", "value", "load_mw",
            F.when(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp"), "PT60M")
            .otherwise("PT15M").alias("resolution"),
        )
    )


# --- H: hourly mean of each event type ---------------------------------------
H_SQL = f"""h AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ts,
         round((avg(value) * {K}) * 1024) / 1024 AS value
  FROM events GROUP BY 1, 2)"""


def hours(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(
        F.col("event_type").alias("series_id"), floor_to("ts", HOUR).alias("ts")
    ).agg(on_grid(F.avg("value") * K).alias("value"))


# --- S: an hourly market table, one series -----------------------------------
S_SQL = f"""s AS (
  SELECT 'all' AS series_id, date_trunc('hour', ts) AS ts,
    round(((avg(value) - 42) * {K} * 5) * 1024) / 1024 AS price_eur_mwh,
    round((sum(value)) * 1024) / 1024 AS load_mw,
    round((max(value)) * 1024) / 1024 AS biomass_mw, round((min(value)) * 1024) / 1024 AS lignite_mw,
    round((avg(value) * {K} / 2) * 1024) / 1024 AS gas_mw, CAST(count(*) AS DOUBLE) AS hard_coal_mw,
    round((avg(value) * {K} / 4) * 1024) / 1024 AS hydro_mw,
    round((sum(value) FILTER (WHERE event_type = 'error')) * 1024) / 1024 AS nuclear_mw,
    round((coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0)) * 1024) / 1024 AS solar_mw,
    round((coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0)) * 1024) / 1024 AS wind_offshore_mw,
    round((coalesce(sum(value) FILTER (WHERE event_type = 'signup'), 0)) * 1024) / 1024 AS wind_onshore_mw,
    round((coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0)) * 1024) / 1024
      + round((coalesce(sum(value) FILTER (WHERE event_type = 'signup'), 0)) * 1024) / 1024 AS wind_total_mw,
    round((avg(user_id) * {K}) * 1024) / 1024 AS temperature_2m,
    least(100.0, round((avg(value) * {K}) * 1024) / 1024) AS relative_humidity_2m,
    round((min(value)) * 1024) / 1024 AS wind_speed_10m, least(100.0, round((max(value)) * 1024) / 1024) AS cloud_cover,
    round((max(value)) * 1024) / 1024 * 2 AS shortwave_radiation
  FROM events GROUP BY 1, 2)"""


def silver(spark, d) -> DataFrame:
    def of_type(kind):
        return F.sum(F.when(F.col("event_type") == kind, F.col("value")))

    mean, top, low = F.avg("value"), on_grid(F.max("value")), on_grid(F.min("value"))
    offshore = on_grid(F.coalesce(of_type("view"), F.lit(0.0)))
    onshore = on_grid(F.coalesce(of_type("signup"), F.lit(0.0)))
    return (
        table(spark, d, "events").groupBy(floor_to("ts", HOUR).alias("ts"))
        .agg(
            on_grid((mean - 42) * K * 5).alias("price_eur_mwh"),
            on_grid(F.sum("value")).alias("load_mw"),
            top.alias("biomass_mw"), low.alias("lignite_mw"),
            on_grid(mean * K / 2).alias("gas_mw"), F.count("*").cast("double").alias("hard_coal_mw"),
            on_grid(mean * K / 4).alias("hydro_mw"),
            on_grid(of_type("error")).alias("nuclear_mw"),
            on_grid(F.coalesce(of_type("click"), F.lit(0.0))).alias("solar_mw"),
            offshore.alias("wind_offshore_mw"), onshore.alias("wind_onshore_mw"),
            (offshore + onshore).alias("wind_total_mw"),
            on_grid(F.avg("user_id") * K).alias("temperature_2m"),
            F.least(F.lit(100.0), on_grid(mean * K)).alias("relative_humidity_2m"),
            low.alias("wind_speed_10m"), F.least(F.lit(100.0), top).alias("cloud_cover"),
            (top * 2).alias("shortwave_radiation"),
        )
        .withColumn("series_id", F.lit("all"))
    )


# --- D: daily mean order value of each priority, a long series with gaps ------
D_SQL = f"""dd AS (
  SELECT o_orderpriority AS series_id, o_orderdate AS ts,
         round(((avg(o_totalprice) - 200000) / 1000 * {K}) * 1024) / 1024 AS price_eur_mwh,
         count(*) AS orders, round(sum(o_totalprice), 2) AS total
  FROM orders GROUP BY 1, 2)"""


def days(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts")
    ).agg(
        on_grid((F.avg("o_totalprice") - 200000) / 1000 * K).alias("price_eur_mwh"),
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"),
    )


# --- DS: the columns of the hourly table by day, one series of all orders -----
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _day_columns():
    """Column name, SQL before it goes to the grid."""
    priced = lambda test: f"coalesce(sum(CASE WHEN {test} THEN o_totalprice END), 0) / 1000 * {K}"
    yield "price_eur_mwh", f"(avg(o_totalprice) - 200000) / 1000 * {K}"
    yield "load_mw", f"sum(o_totalprice) / 1000 * {K}"
    for name, value in zip(("biomass_mw", "lignite_mw", "gas_mw", "hydro_mw", "solar_mw"), PRIORITIES, strict=True):
        yield name, priced(f"o_orderpriority = '{value}'")
    yield "hard_coal_mw", "count(*)"
    for name, value in zip(("nuclear_mw", "wind_offshore_mw", "wind_onshore_mw"), "POF", strict=True):
        yield name, priced(f"o_orderstatus = '{value}'")
    yield "temperature_2m", f"avg(o_custkey) * {K}"
    yield "relative_humidity_2m", f"least(100.0, avg(o_totalprice) / 4000 * {K})"
    yield "wind_speed_10m", f"min(o_totalprice) / 1000 * {K}"
    yield "cloud_cover", f"least(100.0, max(o_totalprice) / 5000 * {K})"
    yield "shortwave_radiation", f"max(o_totalprice) / 1000 * {K}"


DS_SQL = ("s AS (SELECT *, wind_offshore_mw + wind_onshore_mw AS wind_total_mw FROM (SELECT 'all' AS series_id, o_orderdate AS ts, "
          + ", ".join(f"round(({x}) * 1024) / 1024 AS {c}" for c, x in _day_columns()) + " FROM orders GROUP BY 1, 2))")


def daily_silver(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.lit("all").alias("series_id"), F.col("o_orderdate").alias("ts")).agg(
        *[on_grid(F.expr(x).cast("double")).alias(c) for c, x in _day_columns()]).withColumn(
            "wind_total_mw", F.col("wind_offshore_mw") + F.col("wind_onshore_mw"))


# --- V: forecast vintages: order day -> ship day ------------------------------
V_SQL = """v AS (
  SELECT 'orders' AS source, 'A69' AS document_type,
    CASE WHEN l_suppkey % 3 = 0 THEN 'A40' ELSE 'A01' END AS process_type,
    CAST(l_orderkey AS VARCHAR) AS document_id, CAST(l_linenumber AS VARCHAR) AS revision_number,
    o_orderdate - INTERVAL 20 MINUTE AS source_created_at_utc,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE o_orderdate END AS collection_issue_time,
    o_orderdate + l_linenumber * INTERVAL 12 MINUTE AS acquired_at_utc,
    o_orderpriority AS series_id, l_shipdate AS target_timestamp,
    CASE l_returnflag WHEN 'A' THEN 'SOLAR' WHEN 'N' THEN 'WIND_ONSHORE' ELSE 'WIND_OFFSHORE' END AS technology,
    CASE WHEN l_linestatus = 'O' THEN 'PT60M' ELSE 'PT15M' END AS resolution,
    l_extendedprice AS value_mw, l_partkey AS part_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate)"""


def vintages(spark, d) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    flag = F.col("l_returnflag")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .filter("l_shipdate > o_orderdate")
        .select(
            F.lit("orders").alias("source"), F.lit("A69").alias("document_type"),
            F.when(F.col("l_suppkey") % 3 == 0, "A40").otherwise("A01").alias("process_type"),
            F.col("l_orderkey").cast("string").alias("document_id"),
            F.col("l_linenumber").cast("string").alias("revision_number"),
            shift("o_orderdate", -1200).alias("source_created_at_utc"),
            F.when(F.col("l_linenumber") != 7, F.col("o_orderdate")).alias("collection_issue_time"),
            shift("o_orderdate", F.col("l_linenumber") * 720).alias("acquired_at_utc"),
            F.col("o_orderpriority").alias("series_id"),
            F.col("l_shipdate").alias("target_timestamp"),
            F.when(flag == "A", "SOLAR").when(flag == "N", "WIND_ONSHORE")
            .otherwise("WIND_OFFSHORE").alias("technology"),
            F.when(F.col("l_linestatus") == "O", "PT60M").otherwise("PT15M").alias("resolution"),
            F.col("l_extendedprice").alias("value_mw"), F.col("l_partkey").alias("part_key"),
        )
    )


# --- F: issued forecasts on the hourly series, with their actual values -------
F_SQL = f"""{H_SQL}, issued AS (
  SELECT h.series_id, m.model_release, h.ts AS forecast_issue_time, k.horizon AS horizon_hours,
    h.ts + k.horizon * INTERVAL 1 HOUR AS target_timestamp,
    round(((CASE m.model_release WHEN 'persistence' THEN h.value ELSE b.value END - 52) * 4) * 1024) / 1024
      AS predicted_price_eur_mwh,
    h.ts + (k.horizon * 7) % 90 * INTERVAL 1 MINUTE AS issued_at_utc
  FROM h CROSS JOIN (SELECT unnest(range(1, 25)) AS horizon) k
  CROSS JOIN (SELECT unnest(['persistence', 'daily']) AS model_release) m
  LEFT JOIN h b ON b.series_id = h.series_id AND b.ts = h.ts + k.horizon * INTERVAL 1 HOUR - INTERVAL 24 HOUR),
history AS (SELECT * FROM issued WHERE predicted_price_eur_mwh IS NOT NULL),
actual AS (SELECT series_id, ts AS target_timestamp, round(((value - 52) * 4) * 1024) / 1024 AS price_eur_mwh FROM h)"""


def forecasts(spark, d) -> DataFrame:
    """Two naive forecasts per issue hour and horizon (1 to 24)."""
    base = hours(spark, d)
    grid = base.withColumn("horizon_hours", F.explode(F.sequence(F.lit(1), F.lit(24))))
    past = base.select("series_id", F.col("ts").alias("_past"), F.col("value").alias("_daily"))
    grid = grid.withColumn("_past", shift("ts", (F.col("horizon_hours") - 24) * HOUR))
    joined = grid.join(past, ["series_id", "_past"], "left")
    guesses = F.array(
        F.struct(F.lit("persistence").alias("model_release"), F.col("value").alias("guess")),
        F.struct(F.lit("daily").alias("model_release"), F.col("_daily").alias("guess")),
    )
    return (
        joined.withColumn("_g", F.explode(guesses)).filter("_g.guess IS NOT NULL")
        .select(
            "series_id", F.col("_g.model_release").alias("model_release"),
            F.col("ts").alias("forecast_issue_time"), "horizon_hours",
            shift("ts", F.col("horizon_hours") * HOUR).alias("target_timestamp"),
            on_grid((F.col("_g.guess") - 52) * 4).alias("predicted_price_eur_mwh"),
            shift("ts", F.pmod(F.col("horizon_hours") * 7, F.lit(90)) * 60).alias("issued_at_utc"),
        )
    )


def actuals(spark, d) -> DataFrame:
    return hours(spark, d).select(
        "series_id", F.col("ts").alias("target_timestamp"),
        on_grid((F.col("value") - 52) * 4).alias("price_eur_mwh"),
    )


# --- M: a stored table and a later delivery that overlaps it ------------------
M_SQL = f"""{D_SQL}, stored AS (
  SELECT series_id, ts, CASE WHEN orders % 5 = 0 THEN NULL ELSE price_eur_mwh END AS price, total
  FROM dd WHERE ts < TIMESTAMP '1999-06-01 00:00:00'),
incoming AS (
  SELECT series_id, ts, CASE WHEN day(ts) % 11 = 0 THEN NULL ELSE price_eur_mwh END AS price,
         CASE WHEN day(ts) % 7 = 0 THEN total + 1 ELSE total END AS total
  FROM dd WHERE ts >= TIMESTAMP '1997-06-01 00:00:00')"""


def stored_and_incoming(spark, d) -> tuple[DataFrame, DataFrame]:
    daily = days(spark, d)
    day = F.dayofmonth("ts")
    stored = daily.filter(F.col("ts") < F.lit("1999-06-01").cast("timestamp")).select(
        "series_id", "ts",
        F.when(F.col("orders") % 5 != 0, F.col("price_eur_mwh")).alias("price"), "total",
    )
    incoming = daily.filter(F.col("ts") >= F.lit("1997-06-01").cast("timestamp")).select(
        "series_id", "ts", F.when(day % 11 != 0, F.col("price_eur_mwh")).alias("price"),
        F.when(day % 7 == 0, F.col("total") + 1).otherwise(F.col("total")).alias("total"),
    )
    return stored, incoming


# --- R: operations tables -----------------------------------------------------
R_SQL = """runs AS (
  SELECT event_id AS id, ts AS run_time, 'c' || CAST(user_id % 7 AS VARCHAR) AS component,
    CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'WARNING' ELSE 'SUCCESS' END AS status,
    event_type, value AS duration_seconds, props AS message FROM events)"""


def runs(spark, d) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("run_time"),
        F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("component"),
        F.when(kind == "error", "FAILED").when(kind == "signup", "WARNING")
        .otherwise("SUCCESS").alias("status"),
        "event_type", F.col("value").alias("duration_seconds"), F.col("props").alias("message"),
    )


STEP_DAY, STEP_HOUR, STEP_QUARTER = DAY, HOUR, QUARTER
