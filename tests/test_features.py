import numpy as np
import pandas as pd
import pytest
from frames import silver_pandas, table, values
from pyspark.sql import functions as F

from tidegrid import DataContractError
from tidegrid.operators import features as ops, joins


def brute_gold(pdf: pd.DataFrame) -> pd.DataFrame:
    full = pdf.set_index("ts").reindex(pd.date_range(pdf["ts"].min(), pdf["ts"].max(), freq="h"))
    price, load = full["price_eur_mwh"], full["load_mw"]
    return pd.DataFrame({
        "price_lag_168h": price.shift(168), "price_rolling_mean_24h": price.rolling(24).mean(),
        "price_rolling_std_24h": price.rolling(24).std(), "load_lag_24h": load.shift(24), "target_price_next_hour": price.shift(-1),
    }, index=full.index)


@pytest.mark.parametrize("dropped", [[], [100], [219]])
def test_gold_equals_row_by_row_definition(spark, dropped):
    pdf = silver_pandas().drop(index=dropped)
    got = ops.build_gold(spark.createDataFrame(pdf).repartition(7)).orderBy("ts").toPandas()
    want = brute_gold(pdf).dropna()
    want = want[want.index.isin(pdf["ts"])]
    assert list(got["ts"]) == list(want.index)
    for column in want:
        assert np.allclose(got[column], want[column])


def test_issue_features_are_gold_without_the_label(spark):
    df = spark.createDataFrame(silver_pandas())
    gold = ops.build_gold(df).drop(ops.TARGET)
    assert ops.issue_features(df).join(gold, ["series_id", "ts"], "left_anti").count() == 1  # the last hour has no label
    assert len(ops.FEATURES) == 31 and len(ops.FALLBACK_FEATURES) == 25


def test_features_never_see_the_future(spark):
    pdf = silver_pandas()
    cut = pdf["ts"].iloc[200]
    changed = pdf.copy()
    changed.loc[changed["ts"] > cut, ["price_eur_mwh", "load_mw", "solar_mw"]] *= 3
    first, second = (ops.issue_features(spark.createDataFrame(x)).filter(F.col("ts") <= F.lit(cut)) for x in (pdf, changed))
    assert first.exceptAll(second).count() == 0 and first.count() == second.count() > 0


def test_fallback_does_not_read_prices(spark):
    pdf = silver_pandas()
    other = pdf.assign(price_eur_mwh=None)
    a = ops.fallback_features(spark.createDataFrame(pdf))
    b = ops.fallback_features(spark.createDataFrame(other.drop(columns="price_eur_mwh")))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_issue_hour_takes_newest_complete_fresh_hour(spark):
    pdf = silver_pandas()
    df = spark.createDataFrame(pdf)
    last = pdf["ts"].max()
    now = str(last + pd.Timedelta(hours=1, minutes=10))
    parts = [df.select("series_id", "ts", *c) for c in (["price_eur_mwh"], ["load_mw"], list(ops.GENERATION), list(ops.WEATHER))]
    assert joins.issue_features(*parts, now).first()["ts"] == last
    parts[1] = parts[1].filter(F.col("ts") < F.lit(last))
    assert joins.issue_features(*parts, now).first()["ts"] == last - pd.Timedelta(hours=1)
    assert joins.issue_features(*parts, str(last + pd.Timedelta(hours=9))).count() == 0


EVENTS = "key string, run_time timestamp, id long"


def brute_cooldown(pdf, minutes):
    kept, last = [], {}
    for row in pdf.sort_values(["run_time", "id"]).itertuples():
        if row.key not in last or row.run_time - last[row.key] >= pd.Timedelta(minutes=minutes):
            last[row.key] = row.run_time
            kept.append(row.id)
    return sorted(kept)


def test_cooldown_counts_from_the_last_kept_event(spark):
    rows = [("a", f"2026-01-01 {m // 60:02d}:{m % 60:02d}:00", m) for m in (0, 59, 61, 119, 121)]
    out = ops.cooldown(table(spark, EVENTS, rows), ["key"], 60, "run_time")
    assert [r[0] for r in values(out, "id")] == [0, 121, 61]


@pytest.mark.parametrize("block", [3, 50, 100_000])
def test_cooldown_matches_a_sequential_scan(spark, block):
    rng = np.random.default_rng(3)
    n = 800
    pdf = pd.DataFrame({
        "key": np.where(rng.random(n) < 0.5, "hot", rng.choice(list("xyz"), n)),
        "run_time": pd.Timestamp("2026-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 3 * 86400, n)), unit="s"), "id": np.arange(n)})
    out = ops.cooldown(spark.createDataFrame(pdf), ["key"], 45, "run_time", rows_per_block=block)
    assert sorted(r["id"] for r in out.select("id").collect()) == brute_cooldown(pdf, 45)


def test_extremes_survive_downsampling(spark):
    pdf = silver_pandas(500).assign(v=lambda x: np.sin(np.arange(500)))
    pdf.loc[137, "v"], pdf.loc[300, "v"], pdf.loc[301, "v"] = 99.0, -99.0, np.nan
    df = spark.createDataFrame(pdf[["series_id", "ts", "v"]]).withColumn("v", F.nanvl("v", F.lit(None)))
    out = ops.downsample_extremes(df, ["series_id"], ["v"], 40)
    kept = {r["rn"] for r in out.collect()}
    assert {1, 138, 301, 500} <= kept and len(kept) <= 40
    with pytest.raises(DataContractError):
        ops.downsample_extremes(df, ["series_id"], ["v"], 3)


def test_gap_flag_after_sampling(spark):
    pdf = silver_pandas(100).drop(index=range(40, 60))
    sample = ops.downsample_stride(spark.createDataFrame(pdf[["series_id", "ts"]]), ["series_id"], 20)
    assert ops.gap_before(sample, ["series_id"]).filter("gap_before").count() == 1


def test_frames_match_instants_not_seconds(spark):
    from tidegrid.operators.scale import TimeFrame

    df = table(spark, "k string, ts timestamp, v double", [
        ("a", "2026-01-01 09:00:00.2", 1.0), ("a", "2026-01-01 10:00:00.7", 2.0), ("a", "2026-01-01 11:00:00.7", 3.0)])
    frame = TimeFrame(df, ["k"], "ts", back_s=3600)
    got = frame.select(lag=frame.value_at("v", -3600)).orderBy("ts").collect()
    assert [r["lag"] for r in got] == [None, None, 2.0]


@pytest.mark.parametrize("seed", range(4))
def test_chained_step_functions_are_associative_and_short(seed):
    rng = np.random.default_rng(seed)
    gap = 50
    at = np.unique(rng.integers(0, 4000, 900)) if seed else np.arange(0, 4000, 5)
    parts = [ops.steps_of(p, gap) for p in np.array_split(at, 9)]
    left = parts[0]
    for p in parts[1:]:
        left = ops.chained(left, p, gap)
    right = parts[-1]
    for p in parts[-2::-1]:
        right = ops.chained(p, right, gap)
    whole = ops.steps_of(at, gap)
    for f in (left, right):
        asked = np.arange(at[0] - 5, at[0] + gap + 1)
        assert np.array_equal(f.last(asked, asked * 0 - 1), whole.last(asked, asked * 0 - 1))
        assert len(f.entries) <= np.searchsorted(at, at[0] + gap) + 1


def test_a_flood_of_one_key_is_cut_into_blocks(spark):
    """Ten events a second for three hours, in many blocks of one key, with a chain that began earlier."""
    n = 3 * 3600 * 10
    df = spark.range(n).select(F.lit("k").alias("key"), "id", F.timestamp_micros(F.col("id") * 100_000).alias("run_time"))
    kept = [r["id"] for r in ops.cooldown(df, ["key"], 7, "run_time", rows_per_block=10_000).orderBy("id").collect()]
    assert kept == list(range(0, n, 7 * 600))
    since = spark.createDataFrame([("k", 90_000_000)], "key string, _from long")
    later = [r["id"] for r in ops.cooldown(df, ["key"], 7, "run_time", rows_per_block=30_000, since=since).orderBy("id").collect()]
    assert later == list(range(900, n, 7 * 600))
