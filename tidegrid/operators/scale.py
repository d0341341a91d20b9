"""Building blocks that keep one long series or one hot key spread over many tasks.

* ``TimeFrame``   windows over (keys, time bucket) with a halo, not over a whole series
* ``ranked``      exact row numbers from bucket-local ranks plus bucket offsets
* ``exact_quantiles``  exact interpolated quantiles without one task per group
* ``salted_join`` joins one row per key back to facts with hot keys
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.times import epoch
from tidegrid.session import written

BUCKET = "_bucket"
HOME = "_home"


class TimeFrame:
    """Windows on elapsed time whose tasks hold one time bucket of a series.

    A row is copied into a neighbouring bucket when some frame there can reach
    it, so results do not depend on the bucket width. With the default width of
    64 reaches about one row in 64 is copied, and all frames share one shuffle.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], ts: str, *, back_s: int, fwd_s: int = 0,
                 width_s: int | None = None, position: Column | None = None):
        """``position`` replaces the time axis, for windows that count rows."""
        self.keys, self.ts = list(keys), ts
        # Instants are compared in microseconds, so a row off the grid is never taken for one on it.
        self._unit = 1_000_000 if position is None else 1
        width = (width_s or 64 * max(back_s, fwd_s, 1)) * self._unit
        place = F.unix_micros(F.col(ts).cast("timestamp")) if position is None else position
        first = F.floor((place - fwd_s * self._unit) / width)
        last = F.floor((place + back_s * self._unit) / width)
        own = F.floor(place / width)
        spread = df.withColumn(BUCKET, F.explode(F.sequence(first, last)))
        self.frame = spread.withColumn(HOME, F.col(BUCKET) == own)
        self._base = Window.partitionBy(*self.keys, BUCKET).orderBy(place)

    def value_at(self, column: Column | str, offset_s: int) -> Column:
        """Value exactly ``offset_s`` seconds away; null when that row is absent."""
        value = F.col(column) if isinstance(column, str) else column
        return self.over(F.max(value), offset_s, offset_s)

    def trailing(self, fn: Callable[[Column], Column], column: Column | str, rows: int,
                 step_s: int) -> Column:
        """``fn`` over the last ``rows`` grid steps; null unless all of them are present."""
        value = F.col(column) if isinstance(column, str) else column
        window = self._base.rangeBetween(-(rows - 1) * step_s * self._unit, 0)
        return F.when(F.count(value).over(window) == rows, fn(value).over(window))

    def over(self, aggregate: Column, start_s: int, end_s: int) -> Column:
        return aggregate.over(self._base.rangeBetween(start_s * self._unit, end_s * self._unit))

    def select(self, **columns: Column) -> DataFrame:
        """The input columns plus ``columns``, one row per input row."""
        return self.frame.withColumns(columns).filter(HOME).drop(BUCKET, HOME)


#: Rows that a window over one bucket orders, about, and parts that a larger bucket is cut into at a time.
BUCKET_ROWS, SPLITS = 500_000, 64


def equal_depth(df: DataFrame, keys: Sequence[str], position: Column, coarse: Column, rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """``df`` with buckets that order like ``position``, and the written sizes (keys, bucket, _n) of the buckets.

    ``coarse`` cuts by value, so a dense stretch may fill one bucket. A bucket
    of more than ``rows`` rows is cut again at split points from a sketch of
    its own positions, round by round; only equal positions stay together.
    """
    keys = list(keys)
    out = df.withColumn(BUCKET, F.array(coarse.cast("long"))).withColumn("_place", position)
    sizes = written(out.groupBy(*keys, BUCKET).agg(F.count("*").alias("_n")))
    before = None
    while True:
        large = sizes.filter(F.col("_n") > rows)
        most = large.agg(F.max("_n"), F.sum("_n")).first()
        if most[0] is None or tuple(most) == before:
            return out.drop("_place"), sizes
        before = tuple(most)
        part = out.join(large.drop("_n"), [*keys, BUCKET], "left_semi")
        bounds = written(part.groupBy(*keys, BUCKET).agg(F.array_distinct(F.percentile_approx(
            "_place", [i / SPLITS for i in range(1, SPLITS)], 10_000)).alias("_bounds")))  # a row for each large bucket
        at = F.when(F.col("_bounds").isNotNull(), F.concat(BUCKET, F.array(_count_not_above("_bounds", F.col("_place"), SPLITS - 1).cast("long"))))
        out = out.join(bounds, [*keys, BUCKET], "left").withColumn(BUCKET, F.coalesce(at, BUCKET)).drop("_bounds")
        sizes = written(out.groupBy(*keys, BUCKET).agg(F.count("*").alias("_n")))


def ranked(df: DataFrame, keys: Sequence[str], order: str, *, width: int, out: str = "rn",
           total: str | None = None, position: Column | None = None, rows: int = BUCKET_ROWS) -> DataFrame:
    """Row number in the order of a column per key, and optionally the row count per key.

    Ranks are taken inside buckets of ``position`` (the seconds of a timestamp
    column by default, ``width`` per bucket, dense ones cut to ``rows`` rows); a
    small table with one row per bucket carries the offsets. Order values must
    be unique per key.
    """
    keys = list(keys)
    axis = epoch(order) if position is None else position
    bucketed, sizes = equal_depth(df, keys, axis, F.floor(axis / width), rows)
    upto = Window.partitionBy(*keys).orderBy(BUCKET)
    offsets = sizes.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)))
    local = Window.partitionBy(*keys, BUCKET).orderBy(order)
    return (
        bucketed.withColumn("_local", F.row_number().over(local))
        .join(offsets.drop("_n"), [*keys, BUCKET])
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop(BUCKET, "_local", "_before")
    )


def with_previous(df: DataFrame, keys: Sequence[str], ts: str, *, width_s: int,
                  out: str = "previous_ts") -> DataFrame:
    """Time of the row before, in time order per key, without a window over a whole key."""
    keys = list(keys)
    bucketed, _ = equal_depth(df, keys, epoch(ts), F.floor(epoch(ts) / width_s))
    upto = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = bucketed.groupBy(*keys, BUCKET).agg(F.max(ts).alias("_max")).withColumn(
        "_carried", F.max("_max").over(upto)
    )
    local = Window.partitionBy(*keys, BUCKET).orderBy(ts)
    return (
        bucketed.withColumn("_lag", F.lag(ts).over(local))
        .join(carried.drop("_max"), [*keys, BUCKET])
        .withColumn(out, F.coalesce("_lag", "_carried"))
        .drop(BUCKET, "_lag", "_carried")
    )


def nearest_known(df: DataFrame, keys: Sequence[str], position: str, value: str, *, width: int,
                  before: str, after: str) -> DataFrame:
    """Nearest non-null values at or before and at or after each row, as (position, value).

    Looks inside buckets of ``position``; what reaches in from other buckets
    comes from a table with one row per bucket.
    """
    keys = list(keys)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("at"), F.col(value).alias("v")))
    bucketed = df.withColumn(BUCKET, F.floor(F.col(position) / width)).withColumn("_known", known)
    edges = bucketed.groupBy(*keys, BUCKET).agg(F.max("_known").alias("_last"), F.min("_known").alias("_first"))
    line = Window.partitionBy(*keys).orderBy(BUCKET)
    edges = edges.withColumns({
        "_from_left": F.max("_last").over(line.rowsBetween(Window.unboundedPreceding, -1)),
        "_from_right": F.min("_first").over(line.rowsBetween(1, Window.unboundedFollowing)),
    }).drop("_last", "_first")
    local = Window.partitionBy(*keys, BUCKET).orderBy(position)
    return (
        bucketed.withColumns({
            "_left": F.max("_known").over(local.rowsBetween(Window.unboundedPreceding, 0)),
            "_right": F.min("_known").over(local.rowsBetween(0, Window.unboundedFollowing)),
        })
        .join(edges, [*keys, BUCKET])
        .withColumns({before: F.coalesce("_left", "_from_left"), after: F.coalesce("_right", "_from_right")})
        .drop(BUCKET, "_known", "_left", "_right", "_from_left", "_from_right")
    )


def _count_not_above(bounds: str, value: Column, size: int, low: int = 0) -> Column:
    """How many entries of a sorted array of at most ``size`` entries are not above ``value``.

    A binary search written out as nested conditions, which Spark compiles.
    """
    if low >= size:
        return F.lit(low)
    middle = (low + size) // 2
    return F.when(
        F.get(bounds, F.lit(middle)) <= value, _count_not_above(bounds, value, size, middle + 1)
    ).otherwise(_count_not_above(bounds, value, middle, low))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    *, out: str = "quantiles", most: int = 100_000) -> DataFrame:
    """Exact quantiles with linear interpolation, one array per key.

    Values are counted per (key, value) first, so repeated values and hot keys
    collapse before anything is ordered. While the range that holds a wanted
    rank has more than ``most`` distinct values, a sketch of that range cuts it
    into ``SPLITS`` ranges and only those with a wanted rank stay. Each range is
    then ordered in a task of its own.
    """
    keys = list(keys)
    key_list = keys or ["_all"]
    source = df if keys else df.withColumn("_all", F.lit(1))
    place = [*key_list, BUCKET]
    part = written(
        source.filter(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*key_list, F.lit(0).cast("long").alias(BUCKET), F.col(value).alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    # One row for each range and wanted rank: probability, exact place, rank, and rows before the range.
    needed = (
        part.groupBy(*place).agg(F.sum("_c").alias("_n"))
        .withColumn("_w", F.explode(wanted)).withColumn("_h", (F.col("_n") - 1) * F.col("_w.p"))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))))
        .select(*place, F.col("_w.i").alias("_i"), "_h", "_rank", F.lit(0).cast("long").alias("_before"))
    )
    size = None
    while True:
        sizes = part.groupBy(*place).agg(F.count("*").alias("_d"))
        now = sizes.filter(F.col("_d") > most).agg(F.max("_d")).first()[0]
        if now is None or now == size:
            break
        size = now
        bounds = part.groupBy(*place).agg(F.array_distinct(F.percentile_approx(
            "_v", [i / SPLITS for i in range(1, SPLITS)], 10_000)).alias("_bounds"))
        cut = written(salted_join(part, bounds, place).withColumn("_sub", _count_not_above("_bounds", F.col("_v"), SPLITS - 1)).drop("_bounds"))
        totals = cut.groupBy(*place, "_sub").agg(F.sum("_c").alias("_rows"))
        upto = Window.partitionBy(*place).orderBy("_sub")
        inside = totals.withColumn("_inside", F.sum("_rows").over(upto) - F.col("_rows"))
        start = F.col("_before") + F.col("_inside")
        needed = written(
            needed.join(inside, place).filter((F.col("_rank") >= start) & (F.col("_rank") < start + F.col("_rows")))
            .select(*key_list, (F.col(BUCKET) * SPLITS + F.col("_sub")).alias(BUCKET), "_i", "_h", "_rank", start.alias("_before")))
        finer = cut.withColumn(BUCKET, F.col(BUCKET) * SPLITS + F.col("_sub")).drop("_sub")
        part = written(finer.join(F.broadcast(needed.select(*place).distinct()) if not keys else needed.select(*place).distinct(), place, "left_semi"))
    local = Window.partitionBy(*place).orderBy("_v")
    picked = (
        part.withColumn("_end", F.sum("_c").over(local)).join(needed, place)
        .filter((F.col("_rank") < F.col("_before") + F.col("_end")) & (F.col("_rank") >= F.col("_before") + F.col("_end") - F.col("_c")))
    )
    low = F.min(F.struct(F.col("_rank").alias("r"), F.col("_v").alias("v")))["v"]
    high = F.max(F.struct(F.col("_rank").alias("r"), F.col("_v").alias("v")))["v"]
    weight = F.max(F.col("_h") - F.floor("_h"))
    per_prob = picked.groupBy(*key_list, "_i").agg((low + (high - low) * weight).alias("_q"))
    result = per_prob.groupBy(*key_list).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]
        ).alias(out)
    )
    return result if keys else result.drop("_all")


#: Rows of the small side of a join up to which it is sent to every executor.
BROADCAST_ROWS = 200_000


def salted_join(facts: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner",
                salts: int = 32) -> DataFrame:
    """Join one row per key to facts in which a key may hold a large share of all rows.

    The key rows are written. Few of them are broadcast as they are. Else the
    facts get a salt from their whole content and the key rows are repeated once
    per salt, so a hot key is spread over ``salts`` tasks. Repeated rows are
    never broadcast: Spark judges their size without the repeats, and the driver
    would hold ``salts`` times what it expects.
    """
    keys = list(keys)
    per_key = written(per_key)
    if per_key.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return facts.join(F.broadcast(per_key), keys, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns]), F.lit(salts))
    spread = facts.withColumn("_salt", salt)
    repeated = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated.hint("merge"), [*keys, "_salt"], how).drop("_salt")
