"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a small side may have at most to be sent to every executor.
BROADCAST_ROWS = 200_000
#: Rows with whole texts that are sent to Python at a time.
TEXT_ROWS = 1000
#: Rows per window partition that cells of a long order are cut to, on average.
CELL_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_small(large: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join with a side that is usually tiny: broadcast behind a count, else an ordinary join.

    ``small`` must be cheap to compute twice (a written table). Null keys match nothing.
    """
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return large.join(F.broadcast(small) if few else small, on, how)


def cells(rows: int, groups: int = 1, least: int = 64) -> int:
    """How many cells to cut each of ``groups`` orders into; grows with the rows."""
    return max(least, -(-rows // (CELL_ROWS * max(1, groups))))


def unit(*parts: Column) -> Column:
    """A number in (0, 1) that the parts decide."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
