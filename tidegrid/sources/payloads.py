"""JSON payloads: parallel arrays and record arrays to rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.checks import DataContractError, ensure_none
from tidegrid.functions.scalars import number


def payload_violations(df: DataFrame, names: Sequence[str], payload: str, path: str) -> DataFrame:
    """Payloads that lack an array, or whose arrays differ in length."""
    schema = f"{path} struct<{', '.join(f'{n}: array<string>' for n in names)}>"
    parsed = df.withColumn("_p", F.from_json(payload, schema)[path])
    sizes = F.array(*[F.coalesce(F.size(F.col(f"_p.{n}")), F.lit(-1)) for n in names])
    bad = (F.array_min(sizes) < 0) | (F.array_min(sizes) != F.array_max(sizes))
    return parsed.filter(F.coalesce(bad, F.lit(True))).drop("_p")


def explode_parallel_arrays(df: DataFrame, arrays: Mapping[str, str], *, payload: str = "payload", path: str = "hourly",
                            keep: Sequence[str] = (), check: bool = False) -> DataFrame:
    """One row per position of the parallel arrays in a JSON object column."""
    if check:
        ensure_none(payload_violations(df, list(arrays), payload, path), "Payload arrays differ in length")
    schema = f"{path} struct<{', '.join(f'{n}: array<{t}>' for n, t in arrays.items())}>"
    parsed = df.select(*keep, F.from_json(payload, schema)[path].alias("_p"))
    zipped = F.arrays_zip(*[F.col(f"_p.{n}").alias(n) for n in arrays])
    return parsed.select(*keep, F.inline(zipped))


# Field names of a monthly record and what they become.
MONTHLY_FIELDS = {
    "period": "timestamp", "price": "market_price", "sales": "electricity_sales",
    "revenue": "electricity_revenue", "stateid": "region", "sectorName": "sector",
}


def read_monthly_records(df: DataFrame, payload: str = "payload", path: Sequence[str] = ("response", "data"),
                         default_sector: str = "ALL") -> DataFrame:
    """Typed monthly rows from record arrays: renamed, coerced, incomplete and repeated rows dropped."""
    if len(path) != 2:
        raise DataContractError("path names an object and its record array")
    fields = ", ".join(f"{n}: string" for n in MONTHLY_FIELDS)
    schema = f"{path[0]} struct<{path[1]}: array<struct<{fields}>>>"
    rows = df.select(F.inline(F.from_json(payload, schema)[path[0]][path[1]])).withColumnsRenamed(MONTHLY_FIELDS)
    month = F.coalesce(F.try_to_timestamp("timestamp", F.lit("yyyy-MM")), F.try_to_timestamp("timestamp"))
    typed = rows.withColumns({
        "timestamp": month, "market_price": number("market_price"),
        "electricity_sales": number("electricity_sales"), "electricity_revenue": number("electricity_revenue"),
        "sector": F.coalesce("sector", F.lit(default_sector))})
    keys = ["timestamp", "region", "sector"]
    whole = typed.na.drop(subset=["timestamp", "market_price", "electricity_sales"])
    # The least row of a key, so that the choice among repeats does not depend on file order.
    rest = [c for c in whole.columns if c not in keys]
    return whole.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
