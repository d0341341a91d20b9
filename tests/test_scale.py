import numpy as np
import pandas as pd
import pytest
from frames import silver_pandas
from pyspark.sql import functions as F

from tidegrid.operators import features, scale
from tidegrid.operators.projection import fill_series
from tidegrid.operators.scale import exact_quantiles, ranked, salted_join, with_previous


def skewed(spark, n=3000):
    rng = np.random.default_rng(7)
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n))
    value = np.where(rng.random(n) < 0.33, 5.0, np.round(rng.normal(0, 30, n), 2))
    return pd.DataFrame({"key": key, "value": value})


def test_exact_quantiles_match_numpy_on_hot_keys_and_repeats(spark):
    pdf = skewed(spark)
    probs = [0.0, 0.05, 0.25, 0.5, 0.77, 0.95, 1.0]
    got = {r["key"]: r["quantiles"] for r in exact_quantiles(spark.createDataFrame(pdf), ["key"], "value", probs, most=8).collect()}
    for key, part in pdf.groupby("key"):
        assert got[key] == pytest.approx(np.quantile(part["value"], probs).tolist(), abs=1e-9)


def test_exact_quantiles_without_keys_ignore_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,), (float("nan"),), (2.0,)], "value double")
    assert exact_quantiles(df, [], "value", [0.5, 0.75]).first()["quantiles"] == [2.0, 3.0]


@pytest.mark.parametrize("width", [3600, 7 * 3600, 10**9])
def test_ranked_and_previous_do_not_depend_on_bucket_width(spark, width):
    pdf = silver_pandas(60).drop(index=[5, 6, 31])[["series_id", "ts"]]
    df = spark.createDataFrame(pdf)
    got = [(r["rn"], r["n"]) for r in ranked(df, ["series_id"], "ts", width=width, total="n").orderBy("ts").collect()]
    assert got == [(i + 1, len(pdf)) for i in range(len(pdf))]
    before = [r["p"] for r in with_previous(df, ["series_id"], "ts", width_s=width, out="p").orderBy("ts").collect()]
    assert before[0] is None and before[1:] == [t.to_pydatetime() for t in pdf["ts"].iloc[:-1]]


@pytest.mark.parametrize("width", [3 * 3600, 24 * 3600, None])
def test_windows_do_not_depend_on_bucket_width(spark, width):
    pdf = silver_pandas(120).drop(index=[50])
    df = spark.createDataFrame(pdf[["series_id", "ts", "price_eur_mwh"]])
    out = features.rolling_mean(df, ["series_id"], "price_eur_mwh", 24, "m", width_s=width).orderBy("ts").toPandas()
    whole = pdf.set_index("ts")["price_eur_mwh"].reindex(pd.date_range(pdf["ts"].min(), pdf["ts"].max(), freq="h")).rolling(24).mean()
    want = whole.loc[pdf["ts"]].to_numpy()
    assert np.allclose(out["m"].to_numpy(dtype=float), want, equal_nan=True)


def test_salted_join_keeps_every_row_of_a_hot_key(spark):
    facts = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"), "id")
    per_key = spark.createDataFrame([("hot", 1)], "k string, v int")
    assert salted_join(facts, per_key, ["k"]).count() == 900
    assert salted_join(facts, per_key, ["k"], "left").count() == 1000


@pytest.mark.parametrize("width", [4, 100_000])
def test_fill_series_matches_pandas_interpolation(spark, width):
    pdf = silver_pandas(40)[["series_id", "ts"]].assign(v=np.sin(np.arange(40)))
    pdf.loc[[0, 1, 7, 8, 9, 20, 38, 39], "v"] = np.nan
    out = fill_series(spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None))), ["series_id"], ["v"], width=width)
    want = pdf["v"].interpolate().bfill().ffill()
    assert np.allclose(out.orderBy("ts").toPandas()["v"], want)


def test_dense_stretches_are_cut_by_rows(spark):
    """90 % of the rows in one day of one key: ranks stay exact and no bucket is large."""
    rng = np.random.default_rng(8)
    seconds = np.unique(np.concatenate([rng.integers(0, 86_400_000, 9000) / 1000 + 40 * 86400, rng.integers(0, 400 * 86400, 1000)]))
    pdf = pd.DataFrame({"k": "a", "ts": pd.to_datetime(seconds, unit="s")})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame(pdf.iloc[:50].assign(k="b")))
    micros = F.unix_micros("ts")
    _, sizes = scale.equal_depth(df, ["k"], micros, F.floor(micros / (30 * 86400 * 10**6)), rows=300)
    assert sizes.agg(F.max("_n"), F.sum("_n")).first()[0] <= 300 and sizes.agg(F.sum("_n")).first()[0] == len(pdf) + 50
    got = scale.ranked(df, ["k"], "ts", width=30 * 86400, total="n", rows=300).toPandas().sort_values(["k", "ts"])
    assert got[got["k"] == "a"]["rn"].tolist() == list(range(1, len(pdf) + 1)) and set(got["n"]) == {len(pdf), 50}
    ties = spark.range(1000).select(F.lit("a").alias("k"), F.lit(5).cast("long").alias("p"))
    _, sizes = scale.equal_depth(ties, ["k"], F.col("p"), F.lit(0), rows=100)  # equal positions stay together
    assert [r["_n"] for r in sizes.collect()] == [1000]


@pytest.mark.parametrize("most", [10, 200, 100_000])
def test_quantiles_narrow_the_range_of_a_rank(spark, most):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": np.where(np.arange(30_000) < 27_000, "hot", "cold"), "v": np.round(rng.lognormal(0, 2, 30_000), 3)})
    pdf.loc[::7, "v"] = 1.0
    probs = [0.0, 0.05, 0.5, 0.95, 0.999, 1.0]
    got = {r["k"]: r["quantiles"] for r in scale.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", probs, most=most).collect()}
    for k, part in pdf.groupby("k"):
        assert np.allclose(got[k], part["v"].quantile(probs), rtol=1e-12)
    whole = scale.exact_quantiles(spark.createDataFrame(pdf), [], "v", [0.25], most=most).first()["quantiles"]
    assert whole[0] == pytest.approx(pdf["v"].quantile(0.25))


def test_salted_join_broadcasts_no_repeated_rows(spark, monkeypatch):
    from tidegrid.operators import scale

    facts = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    per_key = spark.range(40).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = scale.salted_join(facts, per_key, ["k"], "left")
    assert "BroadcastHashJoin" in plan(few) and "Generate" not in plan(few)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 10, raising=False)
    many = scale.salted_join(facts, per_key, ["k"], "left")
    assert "SortMergeJoin" in plan(many) and "Broadcast" not in plan(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.select(*few.columns).collect()))
