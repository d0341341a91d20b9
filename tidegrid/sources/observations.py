"""Reading observation tables: parsing, schema migration, ranges and work lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegrid.checks import DataContractError, ensure_none, ensure_unique
from tidegrid.functions.times import instant


def parse_observations(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", check: bool = True) -> DataFrame:
    """Text timestamps to UTC instants; unreadable or repeated ones are fatal."""
    parsed = df.withColumn(ts, F.try_to_timestamp(ts)) if dict(df.dtypes)[ts] == "string" else df
    if check:
        ensure_none(parsed.filter(F.col(ts).isNull()), "Unreadable timestamp")
        ensure_unique(parsed, [*keys, ts], "Repeated timestamp")
    return parsed


def read_observations(spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str] = (), *,
                      format: str = "parquet", ts: str = "ts", check: bool = True) -> DataFrame:
    """Scan files with a declared schema; CSV columns are read as declared, NaN as null."""
    reader = spark.read.schema(schema)
    if format == "csv":
        reader = reader.option("header", True)
    df = parse_observations(reader.format(format).load(path), keys, ts, check)
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})


def flatten_two_level_header(df: DataFrame, header: Sequence[tuple[str, str]], wanted: str = "Actual Aggregated",
                             keep: Sequence[str] = ()) -> DataFrame:
    """Columns of a two-row header: those labelled ``wanted``, under their top label, first one wins.

    ``header`` names (top, second) for the columns of ``df`` that are not kept as they are.
    """
    values = [c for c in df.columns if c not in keep]
    if len(values) != len(header):
        raise DataContractError("The header does not match the columns")
    chosen: dict[str, Column] = {}
    for name, (top, second) in zip(values, header):
        if second.strip() == wanted:
            chosen.setdefault(top, F.col(f"`{name}`").alias(top))
    return df.select(*keep, *chosen.values())


def read_wide_generation(spark: SparkSession, path: str, wanted: str = "Actual Aggregated") -> DataFrame:
    """CSV whose first two lines are a two-level header, or an ordinary one-line header.

    Only the two header lines reach the driver; values stay text for ``coerce_numeric``.
    """
    lines = [r.value for r in spark.read.text(path).head(2)]
    plain = len(lines) < 2 or not (lines[1].startswith(",") and wanted in lines[1])
    if plain:
        return spark.read.option("header", True).csv(path)
    top, second = lines[0].split(","), lines[1].split(",")
    raw = spark.read.schema(", ".join(f"c{i} string" for i in range(len(top)))).csv(path)
    data = raw.filter(F.try_to_timestamp("c0").isNotNull()).withColumnRenamed("c0", "timestamp")
    return flatten_two_level_header(data, list(zip(top[1:], second[1:])), wanted, keep=["timestamp"])


def scan_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only these columns; Parquet readers then skip the others."""
    return df.select(*columns)


def time_chunks(bounds: DataFrame, months: int, keys: Sequence[str] = ()) -> DataFrame:
    """Split ``[start_ts, end_ts)`` into consecutive chunks of ``months`` months."""
    if months <= 0:
        raise DataContractError("months must be positive")
    count = F.ceil(F.months_between("end_ts", "start_ts") / months)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(0)).cast("long")))

    def edge(n):
        return F.col("start_ts") + F.make_ym_interval(F.lit(0), (n * months).cast("int"))

    return (
        bounds.filter("start_ts < end_ts").withColumn("_n", chunk)
        .withColumn("chunk_start", edge(F.col("_n")))
        .withColumn("chunk_end", F.least(edge(F.col("_n") + 1), F.col("end_ts")))
        .filter(F.col("chunk_start") < F.col("end_ts"))
        .select(*keys, "chunk_start", "chunk_end")
    )


def historical_range(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows from the start date to the end of the end date (dates, UTC)."""
    if start > end:
        raise DataContractError("The start date must not be after the end date")
    stop = instant(end) + F.expr("INTERVAL 1 DAY")
    return df.filter((F.col(ts) >= instant(start)) & (F.col(ts) < stop))


def migrate_schema(df: DataFrame, current: Sequence[str], legacy: Sequence[str], renames: Mapping[str, str],
                   added: Mapping[str, str] | None = None) -> DataFrame:
    """Bring a legacy table to the current columns; any other schema is fatal."""
    if set(df.columns) == set(current):
        return df.select(*current)
    if set(df.columns) != set(legacy):
        raise DataContractError(f"Unknown schema: {sorted(df.columns)}")
    moved = df.withColumnsRenamed(dict(renames))
    for name, kind in (added or {}).items():
        moved = moved.withColumn(name, F.lit(None).cast(kind))
    return moved.select(*current)
