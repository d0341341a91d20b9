"""Price and forecast documents in XML, many documents per job.

Documents arrive as text, one per file or one per line, and are parsed with a
declared schema: one child or many then gives the same array type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.checks import ensure_none
from tidegrid.functions.scalars import has_explicit_zone
from tidegrid.functions.times import elapsed_seconds, floor_to
from tidegrid.operators.joins import overlapping_periods
from tidegrid.operators.series import block_violations, expand_blocks, points_to_ts, position_violations
from tidegrid.session import written, written_buckets

POINT = "struct<position:int, `price.amount`:double, quantity:double>"
PERIOD = f"struct<timeInterval:struct<start:string,`end`:string>, resolution:string, Point:array<{POINT}>>"
SERIES = f"struct<mRID:string, curveType:string, `MktPSRType`:struct<psrType:string>, Period:array<{PERIOD}>>"

# Production type codes of wind and solar forecasts.
PRODUCTION_TYPES = {"B16": "SOLAR", "B18": "WIND_OFFSHORE", "B19": "WIND_ONSHORE"}


def _series_points(series: DataFrame, value: str, carried: list[str]) -> DataFrame:
    """Explode periods and points of one document series per row."""
    periods = series.select(*carried, F.posexplode("Period").alias("_p", "_period"))
    return periods.select(
        *carried, F.col("_p").alias("period_no"),
        utc(F.col("_period.timeInterval.start")).alias("period_start"),
        utc(F.col("_period.timeInterval.end")).alias("period_end"),
        F.col("_period.resolution").alias("resolution"), F.explode("_period.Point").alias("_point"),
    ).select(
        *[c for c in (*carried, "period_no", "period_start", "period_end", "resolution")],
        F.col("_point.position").alias("position"), F.col(f"_point.`{value}`").alias("value"),
    )


def load_documents(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Texts of all documents in a folder with the time their file was stored.

    A document is a file or, with ``one_per_line``, a line, named by its file and content.
    """
    name = F.concat_ws("#", "_metadata.file_path", F.md5("value")) if one_per_line else F.col("_metadata.file_path")
    return spark.read.text(path, wholetext=not one_per_line).select(
        name.alias("document"), F.col("value").alias("xml"),
        F.col("_metadata.file_modification_time").alias("acquired_at_utc"))


def utc(text: Column | str) -> Column:
    """A timestamp with an explicit zone, with or without seconds."""
    column = F.col(text) if isinstance(text, str) else text
    full = F.regexp_replace(column, "^([0-9-]+T[0-9]{2}:[0-9]{2})(Z|[+-][0-9:]+)$", "$1:00$2")
    return F.when(has_explicit_zone(full), F.try_to_timestamp(full))


def price_points(documents: DataFrame) -> DataFrame:
    """Points of every price series; a missing curve type means explicit points."""
    schema = f"TimeSeries array<{SERIES}>"
    parsed = documents.withColumn("_d", F.from_xml("xml", schema, {"ignoreNamespace": "true"}))
    series = parsed.select("document", F.posexplode("_d.TimeSeries").alias("_no", "_s")).select(
        "document", F.coalesce(F.col("_s.mRID"), F.col("_no").cast("string")).alias("series_no"),
        F.coalesce(F.col("_s.curveType"), F.lit("A01")).alias("curve_type"), F.col("_s.Period").alias("Period"))
    points = _series_points(series, "price.amount", ["document", "series_no", "curve_type"])
    return points.withColumn("period_id", F.concat_ws("|", "document", "series_no", F.col("period_no").cast("string")))


def read_price_documents(spark: SparkSession, path: str, one_per_line: bool = False, check: bool = True) -> DataFrame:
    """Price rows (period_id, ts, value, resolution) with block-coded periods expanded.

    Periods of one document that overlap, in one series or in several, or that cannot be decoded are fatal.
    """
    points = price_points(load_documents(spark, path, one_per_line))
    if check:
        # parsed once for two checks and the result, in buckets of the period, so that none of the three moves the points again
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        points = written_buckets(points.repartition(buckets, "period_id"), "period_id", buckets)
        ensure_none(block_violations(points), "Price period cannot be decoded")
        periods = written(points.select("document", "period_id", F.col("period_start").alias("start_ts"),
                                        F.col("period_end").alias("end_ts")).distinct())  # a row for each period, read by two steps
        # a document's only period overlaps none
        several = periods.groupBy("document").agg(F.count("*").alias("_n")).filter("_n > 1").select("document")
        ensure_none(overlapping_periods(periods.join(several, "document", "left_semi"), ["document"]), "Price periods overlap")
    return expand_blocks(points)


def forecast_points(documents: DataFrame) -> DataFrame:
    """Points of every forecast series with the provenance of their document."""
    schema = (
        "mRID string, revisionNumber string, type string, `process.processType` string, createdDateTime string, "
        f"TimeSeries array<{SERIES}>")
    parsed = documents.withColumn("_d", F.from_xml("xml", schema, {"ignoreNamespace": "true"}))
    head = parsed.select(
        F.col("_d.mRID").alias("document_id"), F.col("_d.revisionNumber").alias("revision_number"),
        F.col("_d.type").alias("document_type"), F.col("_d.`process.processType`").alias("process_type"),
        utc(F.col("_d.createdDateTime")).alias("source_created_at_utc"), "acquired_at_utc",
        F.explode("_d.TimeSeries").alias("_series"))
    kinds = F.create_map(*[F.lit(x) for pair in PRODUCTION_TYPES.items() for x in pair])
    technology = (
        F.when(F.col("document_type") == "A65", "TOTAL_LOAD").when(F.col("document_type") == "A71", "TOTAL_GENERATION")
        .otherwise(F.try_element_at(kinds, F.col("_series.MktPSRType.psrType"))))
    named = head.withColumns({"technology": technology, "Period": F.col("_series.Period")})
    return _series_points(named, "quantity", [
        "document_id", "revision_number", "document_type", "process_type", "source_created_at_utc",
        "acquired_at_utc", "technology"])


def read_forecast_documents(spark: SparkSession, path: str, *, source: str = "DOCUMENT", area: str | None = None,
                            one_per_line: bool = False, collection_issue: Column | None = None,
                            check: bool = True) -> DataFrame:
    """Vintage rows of a folder of documents.

    The acquisition time is the time a file was stored; the collection cycle is
    its hour unless given.
    """
    points = forecast_points(load_documents(spark, path, one_per_line))
    if check:
        points = written(points)  # parsed once for the check and the result
        ensure_none(position_violations(points), "Forecast point outside its period")
    issue = collection_issue if collection_issue is not None else floor_to("acquired_at_utc", 3600)
    return points_to_ts(points).select(
        F.lit(source).alias("source"), "document_type", "process_type", "document_id", "revision_number",
        "source_created_at_utc", issue.alias("collection_issue_time"), "acquired_at_utc",
        F.lit(area).cast("string").alias("market_area"), F.col("ts").alias("target_timestamp"), "resolution",
        (elapsed_seconds("ts", "source_created_at_utc") / 60).alias("source_horizon_minutes"), "technology",
        F.col("value").alias("value_mw"))
