import numpy as np
import pandas as pd
import os

import pytest
from frames import silver_pandas
from pyspark.sql import functions as F

from tidegrid import DataContractError
from tidegrid.operators import features, gram, models as ops
from tidegrid.operators.evaluation import rolling_folds


def rows(spark, n=300):
    rng = np.random.default_rng(1)
    x, z = rng.normal(0, 2, n), rng.normal(5, 1, n)
    return spark.createDataFrame(pd.DataFrame({"series_id": "one", "ts": pd.date_range("2026-01-01", periods=n, freq="h"), "x": x, "z": z, "label": 3 * x - 2 * z + 1}))


def test_linear_fit_and_coefficient_table(spark):
    df = rows(spark)
    model = ops.fit_linear(df, ["x", "z"])
    scored = ops.score(df, model, ["x", "z"], "2026-01-01 01:00:00", "2026-01-02 00:00:00", label="label")
    assert scored.count() == 24 and scored.filter("abs(actual_price - predicted_price) > 1e-6").count() == 0
    models = gram.fit(gram.moments(df, [], ["x", "z", "label"]), [], ["x", "z"], gram.linear_configs(["x", "z"], grids=False)[:1])
    table = ops.coefficients(models, df, ["x", "z"]).orderBy("coefficient_magnitude_rank").collect()
    assert [(r["feature"], r["coefficient_sign"], r["coefficient_magnitude_rank"]) for r in table] == [("x", "positive", 1), ("z", "negative", 2)]
    with pytest.raises(DataContractError):
        ops.score(df.withColumn("x", F.when(F.col("z") > 5, F.col("x"))), model, ["x", "z"], "2026-01-01", "2026-01-05")


def test_isolation_forest_marks_the_far_points(spark):
    rng = np.random.default_rng(2)
    n = 2000
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(0, 1, n), "b": rng.normal(0, 1, n)})
    pdf.loc[:9, ["a", "b"]] = 9.0 + rng.normal(0, 0.3, (10, 2))
    out = ops.isolation_forest(spark.createDataFrame(pdf).repartition(5), ["a", "b"], 0.01, key=["id"], trees=40)
    marked = {r["id"] for r in out.filter("is_anomaly").collect()}
    assert set(range(10)) <= marked and len(marked) == 20
    again = ops.isolation_forest(spark.createDataFrame(pdf).repartition(3), ["a", "b"], 0.01, key=["id"], trees=40)
    assert {r["id"] for r in again.filter("is_anomaly").collect()} == marked


def test_each_horizon_has_its_own_model_and_stale_issues_are_withheld(spark):
    silver = spark.createDataFrame(silver_pandas(260))
    columns = ("price_eur_mwh", "hour", "target_hour")
    train = ops.horizon_rows(features.issue_features(silver), silver, "price_eur_mwh", horizons=3)
    models = ops.fit_horizons(ops.by_horizon(train), lambda h: ops.scaled(ops.linear(), columns), (1, 2, 3))
    issues = features.issue_features(silver).filter("ts >= '2026-04-04 17:00:00'")
    issued, withheld = ops.issue_forecasts(issues, models, columns, "2026-04-04 20:30:00", "r1")
    assert issued.groupBy("forecast_issue_time").count().filter("count <> 3").count() == 0 and issued.count() == 6
    assert {r["reason"] for r in withheld.collect()} == {"stale_issue_hour"}
    error = issued.join(silver.select(F.col("ts").alias("target_timestamp"), "price_eur_mwh"), "target_timestamp")
    assert error.filter("abs(price_eur_mwh - predicted_price_eur_mwh) > 0.5").count() == 0
    shared = ops.scaled(ops.linear(), columns)
    with pytest.raises(DataContractError):
        ops.fit_horizons(train, lambda h: shared, (1, 2))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables are absent")
def test_queries_take_every_horizon_and_feature(spark):
    from tidegrid.operators import features
    from tidegrid.plans import models as plans

    rows = plans.issue_rows(spark, "/root/testdata/sf0.01")
    assert set(features.FEATURES) | set(plans.CALENDAR) <= set(rows.columns)
    assert sorted(r.horizon for r in rows.select("horizon").distinct().collect()) == list(range(1, 25))


def test_series_keep_their_own_folds(spark):
    day, parts = 86_400, []
    for name, start, end in (("a", "2014-06-01", "2016-12-31"), ("b", "2016-03-01", "2018-12-31")):
        ts = pd.date_range(start, end, freq="D")
        level = 50 + 20 * np.sin(np.arange(len(ts)) / 20) + np.random.default_rng(len(ts)).normal(0, 1, len(ts))
        parts.append(pd.DataFrame({"series_id": name, "ts": ts, "price_eur_mwh": level}))
    base = spark.createDataFrame(pd.concat(parts))
    rows = ops.horizon_rows(base.withColumn("month", F.month("ts")), base, "price_eur_mwh", horizons=2, step_s=day)
    strategies = ("full_expanding", "rolling_1y", "recency_weighted_90d")
    out = ops.nested_selection(rows, ("price_eur_mwh", "month"), "2018-06-01 00:00:00", strategies=strategies, step_s=day, horizons=2, min_train=100)
    aggregate = out.aggregate.collect()
    assert {(r.series_id, r.strategy, r.fold_count) for r in aggregate} == {(s, t, 4) for s in "ab" for t in strategies}
    chosen = {r.series_id: r.strategy for r in out.strategy.collect()}
    best = {s: min((r.mean_rmse, r.worst_fold_rmse, r.mean_absolute_bias, r.strategy) for r in aggregate if r.series_id == s)[-1] for s in "ab"}
    assert chosen == best
    assert {(r.series_id, r.strategy, r.horizon_hours) for r in out.test.collect()} == {("b", best["b"], h) for h in (0, 1, 2)}  # a has ended before
    folds = rolling_folds(rows.select("series_id", "issue").distinct(), "2018-06-01 00:00:00", step_s=day, horizons=2, min_train=100)
    assert {(r.series_id, r.fold_id[:4]) for r in folds.collect()} == {("a", "2016"), ("b", "2017")}
    with pytest.raises(DataContractError):
        ops.nested_selection(rows, ("month",), "2015-01-01 00:00:00", step_s=day, horizons=2, min_train=100)
