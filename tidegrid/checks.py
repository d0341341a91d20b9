"""Fatal data contracts: violations are a DataFrame, raising is one small action."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DataContractError(ValueError):
    """Input data breaks a rule that must hold before anything is written."""


def ensure_none(violations: DataFrame, message: str) -> None:
    """Raise with the first offending row; reads at most one row to the driver."""
    first = violations.limit(1).collect()
    if first:
        raise DataContractError(f"{message}: {first[0].asDict(recursive=True)}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def ensure_unique(df: DataFrame, keys: list[str], message: str = "Duplicate keys") -> DataFrame:
    ensure_none(duplicate_keys(df, keys), message)
    return df


def ensure_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise DataContractError(f"Missing required columns: {missing}")
    return df
