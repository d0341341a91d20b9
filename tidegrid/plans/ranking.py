"""Queries on ordered pages, top rows and choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import evaluation, ranking as ops
from tidegrid.plans.adapters import R_SQL, S_SQL, runs, silver, table
from tidegrid.plans.joins import BASE_SQL, predictions
from tidegrid.plans.registry import query


@query("tk1_page", f"""WITH {S_SQL}, x AS (SELECT ts, price_eur_mwh, load_mw FROM s WHERE ts >= TIMESTAMP '2024-01-10 00:00:00')
SELECT *, (SELECT count(*) FROM x) AS matched_rows, CASE WHEN (SELECT count(*) FROM x) > 75 THEN 75::BIGINT END AS next_offset FROM x ORDER BY ts LIMIT 25 OFFSET 50""")
def _(spark, d):
    rows = silver(spark, d).filter("ts >= '2024-01-10'").select("ts", "price_eur_mwh", "load_mw")
    return ops.page(rows, [F.asc("ts")], 25, 50)


@query("tk2_order_events", f"WITH {S_SQL} SELECT ts, price_eur_mwh FROM s ORDER BY price_eur_mwh DESC NULLS LAST, ts")
def _(spark, d):
    return ops.order_events(silver(spark, d).select("ts", "price_eur_mwh"), "price_desc")


@query("tk2_order_events_time_desc", f"WITH {S_SQL} SELECT ts, price_eur_mwh FROM s ORDER BY ts DESC")
def _(spark, d):
    return ops.order_events(silver(spark, d).select("ts", "price_eur_mwh"), "time_desc")


@query("tk3_top_prices", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark, d):
    return ops.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20)


@query("src7_recent_runs", f"WITH {R_SQL} SELECT id, run_time, component, status FROM runs ORDER BY run_time DESC, id DESC LIMIT 100")
def _(spark, d):
    return ops.recent(runs(spark, d).select("id", "run_time", "component", "status"), ["run_time", "id"], 100)


def configurations(spark, d):
    return table(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("model_name"),
        F.concat(F.lit("line="), F.col("l_linenumber").cast("string"), F.lit(" sup="), F.col("l_suppkey").cast("string")).alias("selected_hyperparameters"),
    ).agg(F.avg("l_quantity").alias("_q"), F.avg("l_discount").alias("_d"), F.avg("l_tax").alias("_t")).select(
        "model_name", "selected_hyperparameters", (F.floor(F.col("_q") * 2) / 2).alias("mean_rmse"),
        (F.floor(F.col("_d") * 50 + 0.005) / 50).alias("rmse_std"), (F.floor(F.col("_t") * 100 + 0.0025) / 100).alias("mean_mae"))


CONF_SQL = """conf AS (SELECT model_name, selected_hyperparameters, floor(q * 2) / 2 AS mean_rmse, floor(d * 50 + 0.005) / 50 AS rmse_std, floor(t * 100 + 0.0025) / 100 AS mean_mae FROM (
  SELECT l_returnflag AS model_name, 'line=' || l_linenumber || ' sup=' || l_suppkey AS selected_hyperparameters, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY 1, 2))"""


@query("tk4_best_per_family", f"""WITH {CONF_SQL} SELECT model_name, selected_hyperparameters, mean_rmse FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY mean_rmse, rmse_std, mean_mae, selected_hyperparameters) AS rn FROM conf) WHERE rn = 1""")
def _(spark, d):
    return ops.best_per_family(configurations(spark, d)).select("model_name", "selected_hyperparameters", "mean_rmse")


@query("tk4_winner", f"""WITH {CONF_SQL}, x AS (SELECT *, CASE WHEN length(selected_hyperparameters) % 2 = 0 THEN rmse_std END AS extreme, length(selected_hyperparameters) AS rank FROM conf)
SELECT model_name, mean_rmse, extreme AS extreme_2022_rmse FROM (SELECT *, row_number() OVER (ORDER BY mean_rmse, rmse_std, coalesce(extreme, 'inf'::DOUBLE), mean_mae, rank, model_name) AS rn FROM x) WHERE rn = 1""")
def _(spark, d):
    n = F.length("selected_hyperparameters")
    rows = configurations(spark, d).withColumns({"extreme_2022_rmse": F.when(n % 2 == 0, F.col("rmse_std")), "simplicity_rank": n})
    return ops.winner(rows).select("model_name", "mean_rmse", "extreme_2022_rmse")


ORDER = {"Persistence Baseline": 1, "Daily Seasonal Naive": 2, "Weekly Seasonal Naive": 3}
ERR = "sqrt(avg((predicted - actual) * (predicted - actual)))"


@query("tk5_simplest_within", f"""WITH {BASE_SQL}, r AS (SELECT validation_period, model_name, {ERR} AS rmse FROM pred GROUP BY 1, 2),
e AS (SELECT *, min(rmse) OVER (PARTITION BY validation_period) AS best, CASE model_name WHEN 'Persistence Baseline' THEN 1 WHEN 'Daily Seasonal Naive' THEN 2 ELSE 3 END AS rank FROM r)
SELECT validation_period, arg_min(model_name, rank) AS model_name, round(arg_min(rmse, rank), 6) AS rmse FROM e WHERE rmse <= best * 1.02::DOUBLE GROUP BY 1""")
def _(spark, d):
    errors = evaluation.error_metrics(predictions(spark, d), ["validation_period", "model_name"])
    out = ops.simplest_within(errors, 0.02, ORDER, ["validation_period"])
    return out.select("validation_period", "model_name", F.round("rmse", 6).alias("rmse"))


@query("tk6_preferred_strategy", f"""WITH {BASE_SQL}, r AS (SELECT model_name, validation_period, {ERR} AS rmse, avg(predicted - actual) AS bias FROM pred GROUP BY 1, 2)
SELECT model_name AS strategy, round(avg(rmse), 6) AS mean_rmse FROM r GROUP BY 1 ORDER BY avg(rmse), max(rmse), avg(abs(bias)), 1 LIMIT 1""")
def _(spark, d):
    errors = evaluation.error_metrics(predictions(spark, d), ["model_name", "validation_period"])
    folds = errors.groupBy(F.col("model_name").alias("strategy")).agg(
        F.avg("rmse").alias("mean_rmse"), F.max("rmse").alias("worst_fold_rmse"), F.avg(F.abs("bias")).alias("mean_absolute_bias"))
    return ops.preferred_strategy(folds).select("strategy", F.round("mean_rmse", 6).alias("mean_rmse"))
