"""Fits from sums of products and histogram boosting against other implementations and brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidegrid import DataContractError
from tidegrid.operators import boosting, gram, models as ops
from tidegrid.operators.stats import max_abs_corr

COLUMNS = ("a", "b", "c", "d")


def frame(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3)) * [1.0, 50.0, 0.01] + [5.0, 1000.0, 0.0]
    y = 3 * x[:, 0] - 0.2 * x[:, 1] + rng.standard_t(2, n) * 2
    return pd.DataFrame({"key": np.where(np.arange(n) % 3 == 0, "one", "two"), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "d": 7.0, "label": y})


def fitted(spark, pdf, configs, **kwargs):
    df = spark.createDataFrame(pdf).repartition(3)
    origin = gram.origins(df, [*COLUMNS, "label"])
    sums = gram.moments(df, ["key"], [*COLUMNS, "label"], origin=origin, **kwargs)
    return {(r.key, r.model_name, r.selected_hyperparameters): r for r in gram.fit(sums, ["key"], COLUMNS, configs, origin).collect()}


def test_fits_equal_other_implementations(spark):
    pdf = frame()
    configs = gram.linear_configs(COLUMNS)
    models = fitted(spark, pdf, configs)
    assert len(models) == 2 * (1 + 7 + 6 + 25)
    for key, part in pdf.groupby("key"):
        x, y, n = part[list(COLUMNS)].to_numpy(), part["label"].to_numpy(), len(part)
        deviation = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
        z, centre = (x - x.mean(axis=0)) / deviation, y - y.mean()
        plain = models[key, "Ordinary Linear Regression", "{}"]
        want, *_ = np.linalg.lstsq(np.column_stack([np.ones(n), z]), y, rcond=None)
        assert np.allclose(plain.standardized, want[1:], atol=1e-6) and plain.train_rows == n
        assert np.allclose(x @ np.array(plain.coefficients) + plain.intercept, np.column_stack([np.ones(n), z]) @ want, atol=1e-6)
        for c in configs:
            if c.epsilon is None and c.alpha is not None:
                w = np.array(models[key, c.model_name, c.params].standardized)
                slope = z.T @ (z @ w - centre) / n
                if c.model_name == "Ridge Regression":
                    assert np.allclose(slope * n + c.alpha * w, 0, atol=1e-6)
                else:  # the conditions of the minimum
                    smooth = slope + c.alpha * (1 - c.l1_ratio) * w
                    assert np.all(np.abs(smooth) <= c.alpha * c.l1_ratio + 1e-6)
                    assert np.allclose(smooth[w != 0], -c.alpha * c.l1_ratio * np.sign(w[w != 0]), atol=1e-6)
        rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
            spark.createDataFrame(pd.DataFrame({**dict(zip("abc", z.T[:3])), "label": y})))
        lasso = LinearRegression(regParam=0.1, elasticNetParam=1.0, standardization=False, tol=1e-12, maxIter=1000).fit(rows)
        assert np.allclose(models[key, "Lasso Regression", '{"alpha": 0.1}'].standardized[:3], lasso.coefficients.toArray(), atol=1e-6)


def test_huber_equals_spark(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf)
    configs = gram.linear_configs(COLUMNS)
    start = gram.fit(gram.moments(df, ["key"], [*COLUMNS, "label"]), ["key"], COLUMNS, configs[:1])
    models = {(r.key, r.selected_hyperparameters): r for r in gram.fit_huber(df, ["key"], COLUMNS, configs, start).collect()}
    assert len(models) == 8
    assembled = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    for key in ("one", "two"):
        for epsilon in gram.HUBER_EPSILONS:
            other = LinearRegression(loss="huber", epsilon=epsilon, tol=1e-12, maxIter=2000).fit(assembled.filter(F.col("key") == key))
            own = models[key, f'{{"alpha": 0.0001, "epsilon": {epsilon}}}']
            assert np.allclose(own.coefficients[:3], other.coefficients.toArray(), rtol=2e-3, atol=2e-3)
            assert own.intercept == pytest.approx(other.intercept, rel=2e-3, abs=2e-2)


def test_weightings_keys_and_missing_rows(spark):
    pdf = frame()
    pdf.loc[5, "a"], pdf.loc[6, "label"] = None, np.nan
    pdf["w"] = np.linspace(0, 1, len(pdf))
    df = spark.createDataFrame(pdf)
    sums = gram.moments(df, ["key"], ["a", "label"], {"all": F.lit(1.0), "late": F.col("w"), "half": F.when(F.col("w") > 0.5, 1.0)})
    got = {(r.key, r.strategy, r.i, r.j): r.value for r in sums.collect()}
    good = pdf.dropna(subset=["a", "label"])
    for key, part in good.groupby("key"):
        assert got[key, "all", 0, 0] == len(part) and got[key, "late", 1, 2] == pytest.approx((part["w"] * part["a"] * part["label"]).sum())
        assert got[key, "half", 0, 1] == pytest.approx(part["a"][part["w"] > 0.5].sum())
    assert gram.moments(df.limit(0), ["key"], ["a"]).count() == 0
    folds = spark.createDataFrame([("3",), ("5",)], "validation_period string")
    years = df.withColumn("year", (F.col("w") * 5).cast("int"))
    total = {(r.validation_period, r.i, r.j): r.value for r in gram.expanded(gram.moments(years, ["year"], ["a"]), folds, []).collect()}
    assert total["3", 0, 0] == len(pdf[(pdf["w"] * 5 < 3)].dropna(subset=["a"]))


def test_correlations_use_the_rows_that_both_columns_have(spark):
    pdf = frame()
    pdf.loc[pdf.index % 5 == 0, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    want = pdf[list(COLUMNS)].corr()
    got = {(r.a, r.b): r.correlation for r in gram.correlations(df, COLUMNS).collect()}
    assert len(got) == 6 and got["a", "b"] == pytest.approx(want.loc["a", "b"]) and got["a", "d"] is None
    best = {r.feature: r.max_absolute_correlation for r in max_abs_corr(df, COLUMNS).collect()}
    assert best["a"] == pytest.approx(want.loc["a", ["b", "c"]].abs().max()) and best["d"] is None


def test_all_horizons_and_lists_from_one_scan(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"horizon": np.tile([1, 2, 3], 200), "x": rng.normal(size=600), "z": rng.normal(size=600)})
    pdf["label"] = pdf["horizon"] * pdf["x"] + pdf["z"]
    df = spark.createDataFrame(pdf)
    lists = {"primary": ("x", "z"), "fallback": ("z",)}
    models = ops.fit_linear_horizons(df, lists, (1, 2, 3))
    got = {(r.horizon, r.feature_group): r for r in models.collect()}
    assert len(got) == 6 and np.allclose(got[3, "primary"].coefficients, [3, 1], atol=1e-8) and got[2, "fallback"].coefficients[0] == 0
    scored = ops.score_linear_horizons(df, models, lists, ["label"])
    assert scored.count() == 1200 and scored.filter("feature_group = 'primary' AND abs(label - prediction) > 1e-6").count() == 0
    with pytest.raises(DataContractError, match="4"):
        ops.fit_linear_horizons(df, lists, (1, 4))
    with pytest.raises(DataContractError, match=r"\[1\]"):
        ops.fit_horizons(df.limit(0), lambda h: None, (1,))


# --- boosting ---------------------------------------------------------------------------

def plain_tree(x, r, depth, lam, least):
    """The greedy tree on residuals: prediction of every row."""
    out = np.full(len(r), r.sum() / (len(r) + lam))
    if depth == 0:
        return out
    best, choice = 1e-9, None
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j]):
            left = x[:, j] <= cut
            if least <= left.sum() <= len(r) - least:
                gain = r[left].sum() ** 2 / (left.sum() + lam) + r[~left].sum() ** 2 / ((~left).sum() + lam) - r.sum() ** 2 / (len(r) + lam)
                if gain > best * (1 + 1e-9):
                    best, choice = gain, left
    if choice is None:
        return out
    out[choice] = plain_tree(x[choice], r[choice], depth - 1, lam, least)
    out[~choice] = plain_tree(x[~choice], r[~choice], depth - 1, lam, least)
    return out


def boosting_frame(spark):
    rng = np.random.default_rng(5)
    n = 400
    x = rng.integers(0, 30, (n, 3)).astype(float)
    return spark.createDataFrame(pd.DataFrame({
        "series_id": "s", "ts": pd.date_range("2020-01-01", periods=n, freq="3D"), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2],
        "label": np.where(x[:, 0] > 12, 5.0, 1.0) * x[:, 1] + rng.normal(0, 0.1, n)})).withColumn("target_ts", F.col("ts"))


@pytest.mark.parametrize(("depth", "lam"), [(1, 1.0), (3, 0.0), (3, 2.5)])
def test_one_tree_equals_the_greedy_search(spark, depth, lam):
    df = boosting_frame(spark)
    config = boosting.Boost("m", 1, "all", ("a", "b", "c"), 1, 1.0, depth, lam, 3.0)
    scored = boosting.tune_boosted(df, [config], (2022,), "2023-01-01").collect()
    pdf = df.toPandas()
    train, held = pdf[pdf["ts"].dt.year < 2022], pdf[pdf["ts"].dt.year == 2022]
    x, y = train[["a", "b", "c"]].to_numpy(), train["label"].to_numpy()
    want = dict(zip(map(tuple, x), plain_tree(x, y - y.mean(), depth, lam, 3.0) + y.mean()))
    assert len(scored) == len(held) and {r.validation_period for r in scored} == {"2022"}
    known = {r.actual: r.predicted for r in scored}
    tested = [(known[t], want[k]) for t, k in zip(held["label"], map(tuple, held[["a", "b", "c"]].to_numpy())) if k in want]
    assert len(tested) > 0 and np.allclose(*zip(*tested)) or not tested
    assert set(np.round(list(known.values()), 9)) <= set(np.round(list(want.values()), 9))


def test_rows_apart_give_the_same_trees(spark):
    df = boosting_frame(spark).repartition(3)
    configs = [boosting.Boost("m", 1, "all", ("a", "b", "c"), 11, 0.4, 2, 1.0, 1.0, 0.8, 0.7), boosting.Boost("n", 2, "two", ("b", "c"), 2, 0.5, 1, 0.0)]
    results = [sorted((r.model_name, r.validation_period, r.actual, round(r.predicted, 6)) for r in
                      boosting.tune_boosted(df, configs, (2021, 2022), "2023-01-01", local_rows=rows).collect()) for rows in (10**6, 0)]
    assert results[0] == results[1] and len(results[0]) > 400
    error = {m: np.mean([(a - p) ** 2 for n, _, a, p in results[0] if n == m]) for m in ("m", "n")}
    assert error["m"] < np.var([r[2] for r in results[0]]) / 4
