"""Ordered pages, top rows, and choices with explicit tie keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.merge import oldest_per


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered result with the total row count and the next offset.

    The page is bounded by ``offset + limit``; the count is its own aggregate,
    joined as a single row.
    """
    rows = df.orderBy(*order).offset(offset).limit(limit)
    total = df.agg(F.count("*").alias("matched_rows")).withColumn("_one", F.lit(1))
    following = F.when(F.col("matched_rows") > offset + limit, F.lit(offset + limit).cast("long"))
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one").withColumn(
        "next_offset", following)


EVENT_ORDERS = {
    "price_desc": lambda ts, price: [F.desc(price), F.asc(ts)],
    "time_asc": lambda ts, price: [F.asc(ts)],
    "time_desc": lambda ts, price: [F.desc(ts)],
}


def order_events(df: DataFrame, mode: str, ts: str = "ts", price: str = "price_eur_mwh") -> DataFrame:
    return df.orderBy(*EVENT_ORDERS[mode](ts, price))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def recent(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The newest ``n`` rows of an operational table."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def best_per_family(df: DataFrame, family: str = "model_name") -> DataFrame:
    """The configuration with the least RMSE, its spread, its MAE and its text, per family."""
    order = ["mean_rmse", "rmse_std", "mean_mae", "selected_hyperparameters"]
    return oldest_per(df, [family], [F.col(c) for c in order])


def winner(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The family with the least RMSE and five tie keys; no extreme hours ranks last."""
    extreme = F.coalesce(F.col("extreme_2022_rmse"), F.lit(float("inf")))
    order = [F.col("mean_rmse"), F.col("rmse_std"), extreme.alias("_extreme"), F.col("mean_mae"),
             F.col("simplicity_rank"), F.col("model_name")]
    return oldest_per(df, list(keys), order)


def simplest_within(df: DataFrame, tolerance: float, order: Mapping[str, int], keys: Sequence[str] = (),
                    model: str = "model_name", rmse: str = "rmse") -> DataFrame:
    """The simplest model whose RMSE is within ``tolerance`` of the best one."""
    keys = list(keys) or ["_k"]
    source = df if keys != ["_k"] else df.withColumn("_k", F.lit(1))
    ranks = F.create_map(*[F.lit(x) for name, rank in order.items() for x in (name, rank)])
    best = source.groupBy(*keys).agg(F.min(rmse).alias("_best"))
    eligible = source.join(best, keys).filter(F.col(rmse) <= F.col("_best") * (1 + tolerance))
    chosen = oldest_per(
        eligible.withColumn("_rank", ranks[F.col(model)]).filter("_rank IS NOT NULL"), keys, [F.col("_rank")])
    return chosen.drop("_best", "_rank", "_k")


def preferred_strategy(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    order = ["mean_rmse", "worst_fold_rmse", "mean_absolute_bias", "strategy"]
    return oldest_per(df, list(keys), [F.col(c) for c in order])
