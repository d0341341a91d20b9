"""Writing: idempotent appends, published versions, issued-forecast history, fingerprints."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegrid.checks import DataContractError, ensure_none
from tidegrid.operators.joins import new_rows, overlap_conflicts, stored_overlap
from tidegrid.operators.quality import check_forecast
from tidegrid.session import written


def append_new(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Incoming rows whose key is unseen; rows that overlap must equal the stored ones.

    An empty result is a no-op for the caller: nothing has to be written.
    """
    overlap = stored_overlap(stored, incoming, keys)
    if check:
        overlap = written(overlap)
        ensure_none(overlap_conflicts(overlap, incoming, keys), "Overlapping rows differ")
    return new_rows(overlap, incoming, keys)


def append_to(path: str, stored: DataFrame, incoming: DataFrame, keys: Sequence[str],
              partition_by: Sequence[str] = ()) -> int:
    """Append unseen rows to a Parquet table; returns how many, and writes nothing for none."""
    fresh = written(append_new(stored, incoming, keys))  # counted and appended
    count = fresh.count()
    if count:
        fresh.write.mode("append").partitionBy(*partition_by).parquet(path)
    return count


class VersionTaken(DataContractError):
    """Another writer published the version that this write was based on."""


class Manifest(NamedTuple):
    """A version of a published table: the folder of each part, the columns, and a mark of the writer."""

    version: int
    parts: dict[str, str]
    schema: StructType | None
    mark: str | None


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _create(spark: SparkSession, text: str, body: str) -> bool:
    """Create a file with its whole content, unless it exists: written beside it, then renamed without overwriting."""
    path, fs = _path(spark, text)
    aside, _ = _path(spark, f"{path.getParent()}/.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(body.encode()))
    out.close()
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    none = spark.sparkContext._gateway.new_array(kind, 1)
    none[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, path, none)
    except Py4JJavaError as error:
        fs.delete(aside, False)
        if "FileAlreadyExistsException" in str(error.java_exception):
            return False
        raise
    return True


def current_version(spark: SparkSession, root: str) -> int | None:
    """The newest published version; None for a table that was never published."""
    path, fs = _path(spark, f"{root}/manifest")
    if not fs.exists(path):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), default=None)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest | None:
    """The manifest of a version, of the newest one by default. It has a line for every part, not for every row."""
    version = current_version(spark, root) if version is None else version
    if version is None:
        return None
    found = json.loads(spark.read.text(f"{root}/manifest/{version:012d}.json", wholetext=True).first()[0])
    return Manifest(version, found["parts"], StructType.fromJson(found["schema"]), found["mark"])


def _publish(spark: SparkSession, root: str, based_on: int | None, parts: dict[str, str], schema: StructType, mark: str | None) -> int:
    version = (based_on or 0) + 1
    body = json.dumps({"parts": parts, "schema": schema.jsonValue(), "mark": mark})
    if not _create(spark, f"{root}/manifest/{version:012d}.json", body):
        raise VersionTaken(f"Version {version} of {root} is taken")
    return version


def publish_table(df: DataFrame, root: str, partition_by: Sequence[str] = ()) -> int:
    """Write a table as a whole into a folder of its own, then publish it as the next free version.

    A failed write leaves the version before it current. Of two writers, each
    gets a number of its own; the one that publishes last is current.
    """
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{root}/{folder}")
    while True:
        try:
            return _publish(spark, root, current_version(spark, root), {"": folder}, df.schema, None)
        except VersionTaken:
            continue  # the next number is free or taken by somebody who got on, too


PART = "_part"


def publish_parts(df: DataFrame, root: str, part: Column, based_on: Manifest | None, mark: str | None = None) -> int:
    """Publish the parts that ``df`` has rows for; all other parts stay as ``based_on`` has them, unread and unwritten.

    ``part`` gives a text that names a row's part, for example its month. Fails
    with ``VersionTaken`` if somebody published since ``based_on`` was read.
    """
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    df.withColumn(PART, F.concat(F.lit("p"), part)).write.partitionBy(PART).parquet(f"{root}/{folder}")
    path, fs = _path(spark, f"{root}/{folder}")
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    fresh = {n.removeprefix(f"{PART}=p"): f"{folder}/{n}" for n in names if n.startswith(f"{PART}=")}
    kept = based_on.parts if based_on else {}
    return _publish(spark, root, based_on.version if based_on else None, {**kept, **fresh}, df.schema, mark)


def read_parts(spark: SparkSession, root: str, of: Manifest, parts: Sequence[str] | None = None) -> DataFrame:
    """The rows of a manifest's parts, of all by default; a part that it does not have has no rows."""
    folders = [f"{root}/{f}" for p, f in of.parts.items() if parts is None or p in parts]
    if not folders:
        return spark.createDataFrame([], of.schema)
    if list(of.parts) == [""]:  # a table as a whole, which may have partition columns of its own
        return spark.read.schema(of.schema).parquet(folders[0]).select(*of.schema.names)
    return spark.read.schema(of.schema).parquet(*folders)


def read_published(spark: SparkSession, root: str) -> DataFrame:
    return read_parts(spark, root, manifest(spark, root))


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions that ``df`` has rows for, for example the changed months."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


ISSUE_KEY = ("series_id", "model_release", "forecast_issue_time", "target_timestamp", "horizon_hours")


def issued_conflicts(history: DataFrame, forecast: DataFrame, horizons: int = 24, tolerance: float = 1e-12) -> DataFrame:
    """Issues already stored only in part, or with other values."""
    value = "predicted_price_eur_mwh"
    known = history.select(*ISSUE_KEY, F.col(value).alias("_stored"))
    shared = forecast.select(*ISSUE_KEY, value).join(known, list(ISSUE_KEY))
    facts = shared.groupBy("series_id", "model_release", "forecast_issue_time").agg(
        F.count("*").alias("stored_rows"), F.count_if(F.abs(F.col(value) - F.col("_stored")) > tolerance).alias("changed"))
    return facts.filter((F.col("stored_rows") != horizons) | (F.col("changed") > 0))


def append_issued(history: DataFrame, forecast: DataFrame, check: bool = True) -> DataFrame:
    """Rows to append to the issued-forecast history; stored issues must be whole and unchanged."""
    if check:
        ensure_none(check_forecast(forecast), "Incomplete forecast")
        ensure_none(forecast.filter("issued_at_utc < forecast_issue_time"), "Issued before its issue hour")
        ensure_none(issued_conflicts(history, forecast), "An issued forecast cannot be changed")
    return new_rows(history, forecast, ISSUE_KEY)


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and content hash that do not depend on row or column order.

    Every row is the text of its columns by name, numbers and times as Spark
    prints them, and null as a text of its own; its MD5 is added up in four
    parts of 32 bits, so repeated rows count.
    """
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit("'"), F.col(c).cast("string")), F.lit("null"))) for c in sorted(df.columns)]
    digest = F.md5(F.concat_ws("|", *cells))
    parts = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(4)]
    return df.agg(F.count("*").alias("rows"), F.concat_ws("-", *[
        F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in parts]).alias("content_hash"))
