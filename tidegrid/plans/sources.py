"""Queries on sources and sinks; files are written from the driver tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegrid.functions.times import DAY, shift

from tidegrid.plans.adapters import D_SQL, F_SQL, H_SQL, M_SQL, days, forecasts, hours, table
from tidegrid.plans.registry import query
from tidegrid.plans.series import P_SQL, period_points
from tidegrid.session import shared_dir
from tidegrid.sources import documents, observations, payloads, sinks


def scratch(spark) -> str:
    """A new folder in the shared folder of the cluster."""
    return f"{shared_dir(spark)}/tidegrid-{uuid.uuid4().hex}"


@query("src1_read_observations", f"WITH {H_SQL} SELECT series_id, ts, value FROM h")
def _(spark, d):
    path = scratch(spark)
    hours(spark, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).select("series_id", "ts", "value").write.option(
        "header", True).csv(path)
    return observations.read_observations(spark, path, "series_id string, ts string, value double", ["series_id"], format="csv")


@query("src2_two_level_header", """SELECT date_trunc('hour', ts) AS ts, round(sum(value) FILTER (WHERE event_type = 'view'), 4) AS "Solar",
  round(sum(value) FILTER (WHERE event_type = 'click'), 4) AS "Gas" FROM events GROUP BY 1""")
def _(spark, d):
    kinds = ["view", "signup", "click", "error"]
    wide = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(*[
        F.round(F.sum(F.when(F.col("event_type") == k, F.col("value"))), 4).alias(f"c{i}") for i, k in enumerate(kinds)])
    header = [("Solar", "Actual Aggregated"), ("Solar", "Actual Consumption"), ("Gas", "Actual Aggregated"), ("Gas", "Actual Aggregated")]
    return observations.flatten_two_level_header(wide, header, keep=["ts"])


@query("src2_wide_file", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS timestamp, CAST(count(*) FILTER (WHERE event_type = 'view') AS VARCHAR) AS "Solar",
  CAST(count(*) FILTER (WHERE event_type = 'click') AS VARCHAR) AS "Gas" FROM events GROUP BY 1""")
def _(spark, d):
    """A file with a two-line header, written from the events and read back."""
    counts = table(spark, d, "events").groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("t")).agg(*[
        F.count_if(F.col("event_type") == k).cast("string").alias(k) for k in ("view", "signup", "click")])
    lines = counts.select(F.concat_ws(",", "t", "view", "signup", "click").alias("value"))
    header = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit(0).alias("n"), F.lit(",Solar,Solar,Gas").alias("value")),
        F.struct(F.lit(1).alias("n"), F.lit(",Actual Aggregated,Actual Consumption,Actual Aggregated").alias("value")))).alias("h")).select("h.*")
    path = scratch(spark)
    header.unionByName(lines.withColumn("n", F.lit(2))).repartition(1).sortWithinPartitions("n").select("value").write.text(path)
    return observations.read_wide_generation(spark, path)


def price_xml(spark, d) -> str:
    """One price document per order, as text files in a new folder."""
    point = F.concat(F.lit("<Point><position>"), F.col("position").cast("string"), F.lit("</position><price.amount>"),
                     F.col("value").cast("string"), F.lit("</price.amount></Point>"))
    ordered = F.sort_array(F.collect_list(F.struct("position", point.alias("x"))))
    stamp = "yyyy-MM-dd'T'HH:mm'Z'"
    # A period holds at most eight points, so each document is one small row.
    docs = period_points(spark, d).groupBy("period_id", "curve_type", "period_start", "period_end").agg(ordered.alias("_p")).select(F.concat(
        F.lit("<Document><TimeSeries><mRID>"), F.col("period_id").cast("string"), F.lit("</mRID><curveType>"), F.col("curve_type"),
        F.lit("</curveType><Period><timeInterval><start>"), F.date_format("period_start", stamp), F.lit("</start><end>"),
        F.date_format("period_end", stamp), F.lit("</end></timeInterval><resolution>PT60M</resolution>"),
        F.array_join(F.transform("_p", lambda p: p["x"]), ""), F.lit("</Period></TimeSeries></Document>")).alias("value"))
    path = scratch(spark)
    docs.write.option("compression", "gzip").text(path)
    return path


@query("src3_price_documents", f"""WITH {P_SQL}, nxt AS (SELECT *, lead(position) OVER (PARTITION BY period_id ORDER BY position) AS following FROM points),
slots AS (SELECT period_id, period_start, value, unnest(range(position, CASE WHEN curve_type = 'A03' THEN coalesce(following, 9) ELSE position + 1 END)) AS slot FROM nxt)
SELECT CAST(period_id AS VARCHAR) AS series_no, period_start + (slot - 1) * INTERVAL 1 HOUR AS ts, value, 'PT60M' AS resolution FROM slots""")
def _(spark, d):
    rows = documents.read_price_documents(spark, price_xml(spark, d), one_per_line=True)
    return rows.select(F.element_at(F.split("period_id", "\\|"), -2).alias("series_no"), "ts", "value", "resolution")


@query("src4_forecast_documents", """SELECT CAST(l_orderkey AS VARCHAR) AS document_id, CAST(l_linenumber AS VARCHAR) AS revision_number, 'A69' AS document_type, 'SOLAR' AS technology,
  o_orderdate + INTERVAL 1 HOUR * h AS target_timestamp, l_extendedprice + h AS value_mw, 'PT60M' AS resolution, CAST(20 + 60 * h AS DOUBLE) AS source_horizon_minutes
FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2) JOIN orders ON o_orderkey = l_orderkey CROSS JOIN (SELECT unnest([0, 1]) AS h)""")
def _(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("v"))
    rows = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    stamp = "yyyy-MM-dd'T'HH:mm'Z'"

    def text(column):
        return F.col(column).cast("string")

    docs = rows.select(F.concat(
        F.lit("<MarketDocument><mRID>"), text("l_orderkey"), F.lit("</mRID><revisionNumber>"), text("l_linenumber"),
        F.lit("</revisionNumber><type>A69</type><process.processType>A01</process.processType><createdDateTime>"),
        F.date_format(shift("o_orderdate", -1200), stamp), F.lit("</createdDateTime><TimeSeries><MktPSRType><psrType>B16</psrType></MktPSRType><Period><timeInterval><start>"),
        F.date_format("o_orderdate", stamp), F.lit("</start><end>"), F.date_format(shift("o_orderdate", DAY), stamp),
        F.lit("</end></timeInterval><resolution>PT60M</resolution><Point><position>1</position><quantity>"), text("v"),
        F.lit("</quantity></Point><Point><position>2</position><quantity>"), (F.col("v") + 1).cast("string"),
        F.lit("</quantity></Point></Period></TimeSeries></MarketDocument>")).alias("value"))
    path = scratch(spark)
    docs.write.option("compression", "gzip").text(path)
    return documents.read_forecast_documents(spark, path, one_per_line=True).select(
        "document_id", "revision_number", "document_type", "technology", "target_timestamp", "value_mw", "resolution", "source_horizon_minutes")


@query("src5_parallel_arrays", f"WITH {H_SQL} SELECT series_id, ts AS \"time\", value FROM h")
def _(spark, d):
    # One payload per series and day: at most 24 values each.
    cells = F.sort_array(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), "value")))
    days_of = hours(spark, d).groupBy("series_id", F.to_date("ts").alias("day")).agg(cells.alias("c"))
    payload = F.to_json(F.struct(F.struct(F.col("c.time").alias("time"), F.col("c.value").alias("value")).alias("hourly")))
    rows = payloads.explode_parallel_arrays(days_of.select("series_id", payload.alias("payload")), {"time": "string", "value": "double"},
                                            keep=["series_id"], check=True)
    return rows.withColumn("time", F.to_timestamp("time"))


@query("src6_monthly_records", f"""WITH {D_SQL}, m AS (SELECT series_id, date_trunc('month', ts) AS month, round(sum(total), 2) AS sales, count(*) AS n FROM dd GROUP BY 1, 2)
SELECT month AS timestamp, CAST(n AS DOUBLE) AS market_price, sales AS electricity_sales, NULL::DOUBLE AS electricity_revenue, series_id AS region, 'ALL' AS sector FROM m WHERE n % 5 <> 0""")
def _(spark, d):
    monthly = days(spark, d).groupBy("series_id", F.date_format("ts", "yyyy-MM").alias("period")).agg(
        F.round(F.sum("total"), 2).alias("sales"), F.count("*").alias("n"))
    record = F.struct("period", F.when(F.col("n") % 5 == 0, "-").otherwise(F.col("n").cast("string")).alias("price"),
                      F.format_string("%.2f", "sales").alias("sales"), F.lit("n/a").alias("revenue"), F.col("series_id").alias("stateid"))
    # One payload per series and year: twelve records, each repeated once.
    yearly = monthly.groupBy("series_id", F.substring("period", 1, 4).alias("y")).agg(F.collect_list(record).alias("r"))
    body = F.to_json(F.struct(F.struct(F.concat("r", "r").alias("data")).alias("response")))
    return payloads.read_monthly_records(yearly.select(body.alias("payload")))


@query("src8_scan_columns", "SELECT max(ts) AS latest_ts, count(ts) AS \"rows\" FROM events")
def _(spark, d):
    return observations.scan_columns(table(spark, d, "events"), ["ts"]).agg(F.max("ts").alias("latest_ts"), F.count("ts").alias("rows"))


@query("src9_time_chunks", """WITH b AS (SELECT o_orderpriority AS series_id, min(o_orderdate) AS s, max(o_orderdate) + INTERVAL 1 DAY AS e FROM orders GROUP BY 1),
n AS (SELECT *, unnest(range(0, 40)) AS k FROM b)
SELECT series_id, s + k * 6 * INTERVAL 1 MONTH AS chunk_start, least(s + (k + 1) * 6 * INTERVAL 1 MONTH, e) AS chunk_end FROM n WHERE s + k * 6 * INTERVAL 1 MONTH < e""")
def _(spark, d):
    ends = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id")).agg(
        F.min("o_orderdate").alias("start_ts"), shift(F.max("o_orderdate"), DAY).alias("end_ts"))
    return observations.time_chunks(ends, 6, ["series_id"])


@query("src10_historical_range", "SELECT o_orderkey, o_orderdate AS ts FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-09-01 00:00:00'")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    return observations.historical_range(rows, "1997-03-01", "1999-08-31")


@query("src11_migrate_schema", "SELECT o_orderkey AS id, NULL::TIMESTAMP AS collection_issue_time, o_totalprice AS source_horizon_minutes FROM orders")
def _(spark, d):
    legacy = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("horizon_minutes"))
    return observations.migrate_schema(legacy, ["id", "collection_issue_time", "source_horizon_minutes"], ["id", "horizon_minutes"],
                                       {"horizon_minutes": "source_horizon_minutes"}, {"collection_issue_time": "timestamp"})


@query("snk1_append_new", f"WITH {M_SQL} SELECT series_id, ts, price_eur_mwh AS price FROM dd")
def _(spark, d):
    whole = days(spark, d).select("series_id", "ts", F.col("price_eur_mwh").alias("price"))
    path = scratch(spark)
    whole.filter("ts < '1999-06-01'").write.parquet(path)
    sinks.append_to(path, spark.read.parquet(path), whole.filter("ts >= '1997-06-01'"), ["series_id", "ts"])
    return spark.read.parquet(path)


@query("snk2_publish_table", f"WITH {D_SQL} SELECT series_id, ts, total FROM dd")
def _(spark, d):
    root = scratch(spark)
    daily = days(spark, d).select("series_id", "ts", "total")
    sinks.publish_table(daily.filter("ts < '1998-01-01'"), root)
    sinks.publish_table(daily, root, ["series_id"])
    return sinks.read_published(spark, root)


@query("snk3_append_issued", f"""WITH {F_SQL}, whole AS (SELECT * FROM history QUALIFY count(*) OVER (PARTITION BY series_id, model_release, forecast_issue_time) = 24)
SELECT series_id, model_release, forecast_issue_time, CAST(horizon_hours AS INTEGER) AS horizon_hours, predicted_price_eur_mwh FROM whole WHERE hour(forecast_issue_time) >= 12""")
def _(spark, d):
    rows = forecasts(spark, d)
    issue = ["series_id", "model_release", "forecast_issue_time"]
    whole = rows.join(rows.groupBy(*issue).agg(F.count("*").alias("n")).filter("n = 24").drop("n"), issue, "left_semi")
    stored = whole.filter(F.hour("forecast_issue_time") < 12)
    return sinks.append_issued(stored, whole).select(*issue, "horizon_hours", "predicted_price_eur_mwh")


LINE_COLUMNS = ("l_discount", "l_extendedprice", "l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag",
                "l_shipdate", "l_suppkey", "l_tax")


@query("snk4_fingerprint", f"""WITH t AS (SELECT md5(concat_ws('|', {", ".join(f"'{c}=' || coalesce(chr(39) || CAST({c} AS VARCHAR), 'null')" for c in LINE_COLUMNS)})) AS m
  FROM lineitem)
SELECT count(*) AS "rows", concat_ws('-', {", ".join(f"CAST(sum(CAST('0x' || substr(m, {1 + 8 * i}, 8) AS UBIGINT)) AS VARCHAR)" for i in range(4))}) AS content_hash FROM t""")
def _(spark, d):
    return sinks.fingerprint(table(spark, d, "lineitem"))


