import numpy as np
import pandas as pd
import pytest
from frames import table
from pyspark.sql import functions as F

from tidegrid import DataContractError
from tidegrid.operators import evaluation as ops, ranking


def prices(spark, n=400, start="2019-01-01"):
    pdf = pd.DataFrame({"series_id": "one", "ts": pd.date_range(start, periods=n, freq="h"), "price_eur_mwh": np.arange(n, dtype=float)})
    return spark.createDataFrame(pdf)


def test_baselines_use_elapsed_time(spark):
    row = ops.baselines(prices(spark)).filter("price_eur_mwh = 168").first()
    assert (row["persistence"], row["daily"], row["weekly"], row["actual"]) == (168.0, 145.0, 1.0, 169.0)
    gap = ops.baselines(prices(spark).filter("price_eur_mwh <> 145")).filter("price_eur_mwh = 168").first()
    assert gap["daily"] is None and gap["weekly"] == 1.0


def random_pairs(spark, n=500):
    rng = np.random.default_rng(5)
    return pd.DataFrame({"k": rng.choice(["a", "b"], n), "horizon_hours": rng.integers(1, 4, n), "actual": 1e6 + rng.normal(0, 3, n), "e": rng.normal(0, 1, n)}).assign(
        predicted=lambda x: x.actual + x.e)


def test_metrics_equal_direct_computation_far_from_zero(spark):
    pdf = random_pairs(spark)
    out = ops.metrics_by_horizon(spark.createDataFrame(pdf), ["k"]).toPandas().set_index(["k", "horizon_hours"])
    assert len(out) == 8
    for (k, h), row in out.iterrows():
        part = pdf[(pdf.k == k) & ((pdf.horizon_hours == h) | (h == 0))]
        e = part.predicted - part.actual
        assert row["observations"] == len(part) and row["bias"] == pytest.approx(e.mean())
        assert row["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
        assert row["r2"] == pytest.approx(1 - (e**2).sum() / ((part.actual - part.actual.mean()) ** 2).sum(), abs=1e-4)


def test_every_regime_is_listed(spark):
    rows = [("m", "g", "2022", a, a + 1) for a in (-5.0, 0.0, 99.9, 250.0)] + [("m", "g", "2023", 150.0, 140.0)]
    out = ops.regime_performance(spark.createDataFrame(rows, "model_name string, feature_group string, validation_period string, actual double, predicted double"))
    counts = {(r["validation_period"], r["price_regime"]): r["observation_count"] for r in out.collect()}
    assert len(counts) == 12 and counts[("2022", "Normal")] == 2 and counts[("2023", "Negative")] == 0 and counts[("All Development Folds", "High")] == 1


def test_folds_are_by_target_time(spark):
    df = prices(spark, 24 * 3, "2021-12-31").withColumn("target_ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    folds = ops.expanding_folds(df, (2022,), "2023-01-01")
    roles = {r["role"]: r["n"] for r in folds.groupBy("role").agg(F.count("*").alias("n")).collect()}
    assert roles == {"train": 23, "validation": 49}
    with pytest.raises(DataContractError):
        ops.expanding_folds(df, (2022,), "2022-06-01")


def test_windows_that_cross_a_boundary_are_purged(spark):
    df = prices(spark, 100).select(F.col("ts").alias("issue")).withColumn("last_target", F.col("issue") + F.expr("INTERVAL 24 HOURS"))
    out = ops.purged_split(df, "2019-01-02 12:00:00", "2019-01-04 00:00:00", F.col("last_target"))
    n = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n == {"train": 12, "validation": 12, "test": 28}


def pair_frame(spark, n, start="2026-01-10 00:00:00"):
    rows = []
    for i in range(n):
        t = pd.Timestamp(start) + pd.Timedelta(hours=i)
        rows.append(("one", "m", str(t - pd.Timedelta(hours=1)), str(t), 1 + i % 2, str(t - pd.Timedelta(minutes=30)), 1.0 + i % 3, 1.0 + i % 3, (1.0 + i % 3) ** 2))
    return table(spark, "series_id string, model_release string, forecast_issue_time timestamp, target_timestamp timestamp, horizon_hours int, issued_at_utc timestamp, "
                 "signed_error double, absolute_error double, squared_error double", rows)


def test_small_samples_have_a_count_but_no_metrics(spark):
    out = {(r["scope"], r["name"]): r for r in ops.realized_performance(pair_frame(spark, 30), "2026-01-11 06:00:00").collect()}
    assert len(out) == 28 and out[("overall", "all")]["pair_count"] == 30 and out[("overall", "all")]["status"] == "Available"
    assert out[("window", "24h")]["pair_count"] == 23 and out[("horizon", "7")]["pair_count"] == 0 and out[("horizon", "7")]["mae"] is None
    few = {(r["scope"], r["name"]): r for r in ops.realized_performance(pair_frame(spark, 19), "2026-01-11 06:00:00").collect()}
    assert few[("overall", "all")]["status"] == "Insufficient data" and few[("horizon", "1")]["status"] == "Available"


def test_rolling_metrics_take_the_newest_pairs(spark):
    out = {r["horizon_hours"]: r for r in ops.monitoring_metrics(pair_frame(spark, 30), min_observations=5, rolling=6).collect()}
    assert set(out) == {0, 1, 2} and out[0]["rolling_window"] == 6 and out[0]["rolling_mae"] == pytest.approx(2.0) and out[0]["observations"] == 30


def test_rolling_folds_need_four_complete_months(spark):
    issues = spark.createDataFrame(pd.DataFrame({"series_id": "one", "issue": pd.date_range("2022-06-01", "2024-12-31 23:00", freq="h")}))
    out = ops.rolling_folds(issues, "2025-01-01 00:00:00").orderBy("validation_start").collect()
    assert [r["fold_id"] for r in out] == ["2024-winter", "2024-spring", "2024-summer", "2024-autumn"]
    assert out[0]["validation_rows"] == 31 * 24 - 24
    holed = issues.filter("issue <> '2024-07-09 05:00:00'")
    assert ops.rolling_folds(holed, "2025-01-01 00:00:00").count() == 0  # 2023 lacks a year of training rows before January


def test_recency_weights_halve(spark):
    df = spark.createDataFrame(pd.DataFrame({"series_id": "one", "issue": [pd.Timestamp("2025-01-01"), pd.Timestamp("2026-01-01")]}))
    w = {str(r["issue"])[:4]: r["weight"] for r in ops.strategy_rows(df, "recency_weighted_365d").collect()}
    assert w == {"2025": 0.5, "2026": 1.0}
    assert ops.strategy_rows(df, "rolling_1y").count() == 2
    with pytest.raises(DataContractError):
        ops.strategy_rows(df, "unknown")


def test_choices_follow_their_tie_keys(spark):
    rows = [("b", 1.0, 0.1, None, 2.0, 2, "x"), ("a", 1.0, 0.1, 5.0, 2.0, 3, "y"), ("c", 1.0, 0.2, 1.0, 2.0, 1, "z")]
    df = spark.createDataFrame(rows, "model_name string, mean_rmse double, rmse_std double, extreme_2022_rmse double, mean_mae double, simplicity_rank int, selected_hyperparameters string")
    assert ranking.winner(df).first()["model_name"] == "a"
    scores = spark.createDataFrame([("forest", 10.0), ("linear", 10.19), ("boost", 10.3)], "model_name string, rmse double")
    order = {"linear": 1, "boost": 2, "forest": 3}
    assert ranking.simplest_within(scores, 0.02, order).first()["model_name"] == "linear"
    assert ranking.simplest_within(scores, 0.001, order).first()["model_name"] == "forest"


def test_pooled_r2_holds_for_large_values(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"series_id": "a", "horizon_hours": np.arange(240) % 24 + 1, "actual": 1e8 + rng.normal(size=240)})
    pdf["predicted"] = pdf["actual"] + rng.normal(size=240)
    got = ops.metrics_by_horizon(spark.createDataFrame(pdf), ["series_id"]).filter("horizon_hours = 0").first()["r2"]
    want = 1 - ((pdf.predicted - pdf.actual) ** 2).sum() / ((pdf.actual - pdf.actual.mean()) ** 2).sum()
    assert abs(got - want) < 1e-6
