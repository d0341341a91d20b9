"""Fits, scoring and selection; every result is a table of predictions or errors.

Linear models come from sums of products (``gram``), trees from Spark ML.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.checks import DataContractError, ensure_none
from tidegrid.functions.scalars import is_finite
from tidegrid.functions.times import HOUR, calendar, elapsed_seconds, instant, shift
from tidegrid.operators import gram
from tidegrid.operators.evaluation import (
    baselines, baselines_long, error_metrics, expanding_folds, extreme_metrics, fold_aggregate, metrics_by_horizon,
    nested_aggregate, purged_split, regime_performance, rolling_folds, strategy_weight, with_last_target,
)
from tidegrid.operators.joins import attach_targets, weekly_asof
from tidegrid.operators.ranking import best_per_family
from tidegrid.operators.scale import exact_quantiles
from tidegrid.operators.stats import max_abs_corr
from tidegrid.session import written

Factory = Callable[[int], Estimator]


# --- estimators -------------------------------------------------------------------

def scaled(estimator: Estimator, features: Sequence[str]) -> Pipeline:
    """Assemble, centre and scale, then fit; scaling is learnt from the training rows only."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        estimator,
    ])


def unscaled(estimator: Estimator, features: Sequence[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), estimator])


def linear(label: str = "label", **params) -> LinearRegression:
    return LinearRegression(featuresCol="features", labelCol=label, predictionCol="prediction", **params)


def fit_linear(df: DataFrame, features: Sequence[str], label: str = "label") -> PipelineModel:
    """Ordinary least squares on centred and scaled features; one pass over the rows."""
    return scaled(linear(label, solver="normal"), features).fit(df)


class Candidate(NamedTuple):
    name: str
    estimator: Pipeline
    grid: Sequence[Mapping[str, float]]
    simplicity: int


def tree_family(features: Sequence[str], label: str = "label", seed: int = 42) -> list[Candidate]:
    """Random forest and gradient boosting with their grids; an empty entry is the untuned reference.

    Spark cuts trees at depth 30, which stands for unlimited depth.
    """
    def grid(**axes):
        rows = [{}]
        for name, values in axes.items():
            rows = [{**r, name: v} for r in rows for v in values]
        return [{}, *rows]

    forest = RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed, subsamplingRate=1.0, featureSubsetStrategy="all",
                                   numTrees=100, maxDepth=30)
    boosted = GBTRegressor(featuresCol="features", labelCol=label, seed=seed, maxIter=100, stepSize=0.1, maxDepth=3)
    # The searched grids.
    return [
        Candidate("Random Forest", unscaled(forest, features),
                  grid(numTrees=[200, 400], maxDepth=[12, 30], minInstancesPerNode=[1, 4]), 6),
        Candidate("Gradient Boosting", unscaled(boosted, features),
                  grid(maxIter=[100, 200], stepSize=[0.03, 0.05], maxDepth=[2, 3]), 7),
    ]


def configured(pipeline: Pipeline, params: Mapping[str, float]) -> Pipeline:
    """A copy of the pipeline whose last stage has these parameters."""
    *head, last = pipeline.getStages()
    return Pipeline(stages=[*head, last.copy({last.getParam(k): v for k, v in params.items()})])


# --- horizons ---------------------------------------------------------------------------

def horizon_rows(features: DataFrame, prices: DataFrame, value: str, keys: Sequence[str] = ("series_id",), *,
                 horizons: int = 24, step_s: int = HOUR, ts: str = "ts") -> DataFrame:
    """Long training rows: issue features, horizon, target calendar and the label."""
    long = attach_targets(features, prices, keys, value, horizons, step_s, ts, how="inner")
    return long.withColumnRenamed("target_value", "label").withColumns(calendar("target_ts", "target_"))


def by_horizon(rows: DataFrame, extra: Sequence[str] = (), horizon: str = "horizon") -> DataFrame:
    """The rows as a written table with one folder per horizon (and ``extra`` column)."""
    return written(rows, (*extra, horizon))


def fit_horizons(rows: DataFrame, factory: Factory, horizons: Sequence[int], threads: int = 4,
                 horizon: str = "horizon") -> dict[int, Model]:
    """One independent model per horizon.

    Every fit is a distributed job over the rows of its horizon; a small driver
    pool keeps several jobs in flight. No horizon is pulled into one task. Give
    it a table written by horizon (``by_horizon``), so that a fit reads only
    its own partition.
    """
    require_rows(rows, horizons, horizon)
    estimators = {h: factory(h) for h in horizons}
    if len({id(e) for e in estimators.values()}) != len(estimators):
        raise DataContractError("Each horizon needs its own estimator")
    with ThreadPoolExecutor(threads) as pool:
        fitted = pool.map(lambda h: (h, estimators[h].fit(rows.filter(F.col(horizon) == h))), horizons)
        return dict(fitted)


def require_rows(rows: DataFrame, horizons: Sequence[int], horizon: str = "horizon") -> None:
    """Every horizon needs training rows; one count over the rows."""
    found = {r[0] for r in rows.groupBy(horizon).agg(F.count("*")).collect()}  # at most one row per horizon
    missing = sorted(set(horizons) - found)
    if missing:
        raise DataContractError(f"No training rows for horizons {missing}")


def fit_linear_horizons(rows: DataFrame, lists: Mapping[str, Sequence[str]], horizons: Sequence[int] = tuple(range(1, 25)),
                        keys: Sequence[str] = (), label: str = "label", horizon: str = "horizon") -> DataFrame:
    """Least squares for every horizon and feature list, all from one scan of the rows.

    Returns a written table of models keyed by ``keys``, horizon and
    ``feature_group``, the name of the list.
    """
    require_rows(rows, horizons, horizon)
    columns = list(dict.fromkeys(c for names in lists.values() for c in names))
    configs = [gram.linear_configs(names, group, grids=False)[0] for group, names in lists.items()]
    origin = gram.origins(rows, [*columns, label])
    sums = gram.moments(rows.filter(F.col(horizon).isin(*horizons)), [*keys, horizon], [*columns, label], origin=origin)
    return written(gram.fit(sums, [*keys, horizon], columns, configs, origin, label))


def score_linear_horizons(rows: DataFrame, models: DataFrame, lists: Mapping[str, Sequence[str]], keep: Sequence[str],
                          keys: Sequence[str] = (), horizon: str = "horizon") -> DataFrame:
    """keys, horizon, keep, feature_group and prediction of every row by the models of its horizon."""
    columns = list(dict.fromkeys(c for names in lists.values() for c in names))
    return gram.score_models(rows, models, [*keys, horizon], columns, keep, ("feature_group",))


def score_horizons(rows: DataFrame, models: Mapping[int, Model], keep: Sequence[str], horizon: str = "horizon") -> DataFrame:
    """Predictions of every row by the model of its horizon."""
    parts = [m.transform(rows.filter(F.col(horizon) == h)).select(*keep, horizon, "prediction") for h, m in models.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def require_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise DataContractError(f"Missing model features: {missing}")
    return df


def score(df: DataFrame, model: Model, features: Sequence[str], start, end, *, step_s: int = HOUR, ts: str = "ts",
          label: str | None = None, check: bool = True) -> DataFrame:
    """Predictions of every row whose target lies in the closed range; a null feature is fatal."""
    target = shift(ts, step_s)
    rows = require_features(df, features).withColumn("target_ts", target).filter(
        (F.col("target_ts") >= instant(start)) & (F.col("target_ts") <= instant(end)))
    if check:
        bad = F.lit(False)
        for f in features:
            bad = bad | F.col(f).isNull()
        ensure_none(rows.filter(bad).select(ts), "Model feature is missing")
    actual = [F.col(label).alias("actual_price")] if label else []
    return model.transform(rows).select("series_id", "target_ts", *actual, F.col("prediction").alias("predicted_price"))


def issue_forecasts(issues: DataFrame, models: Mapping[int, Model] | DataFrame, features: Sequence[str], now, release: str, *,
                    max_age_s: int = 3 * HOUR, step_s: int = HOUR, ts: str = "ts",
                    check: bool = True) -> tuple[DataFrame, DataFrame]:
    """24 rows per fresh and complete issue row of every series, and the withheld rows with a reason.

    ``models`` is a table of ``fit_linear_horizons`` with one feature list, or
    a fitted model per horizon, for which the fresh rows are written once.
    """
    age = elapsed_seconds(instant(now), ts)
    observed = [f for f in features if not f.startswith("target_")]  # the target calendar is added below
    whole = F.lit(True)
    for f in observed:
        whole = whole & is_finite(f)
    reason = (F.when((age < 0) | (age > max_age_s), "stale_issue_hour").when(~whole, "incomplete_features"))
    marked = require_features(issues, observed).withColumn("reason", reason)
    withheld = marked.filter("reason IS NOT NULL").select("series_id", F.col(ts).alias("forecast_issue_time"), "reason")
    table = isinstance(models, DataFrame)
    horizons = [r[0] for r in models.select("horizon").distinct().collect()] if table else list(models)
    fresh = marked.filter("reason IS NULL").drop("reason").withColumn(
        "horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    fresh = fresh.withColumn("target_ts", shift(ts, F.col("horizon") * step_s)).withColumns(calendar("target_ts", "target_"))
    keep = ["series_id", ts, "target_ts"]
    if table:
        scored = score_linear_horizons(fresh, models, {"all": list(features)}, keep)
    else:
        scored = score_horizons(by_horizon(fresh), models, keep)
    issued = scored.select(
        "series_id", F.col(ts).alias("forecast_issue_time"), F.col("target_ts").alias("target_timestamp"),
        F.col("horizon").alias("horizon_hours"), F.col("prediction").alias("predicted_price_eur_mwh"),
        F.lit(release).alias("model_release"))
    if check:
        ensure_none(issued.filter(~is_finite("predicted_price_eur_mwh")), "Prediction is not finite")
    return issued, withheld


# --- selection ------------------------------------------------------------------------------

def predict_folds(folds: DataFrame, estimator: Pipeline, periods: Sequence[str]) -> DataFrame:
    """Validation predictions of every fold, each by a model fitted on that fold's training rows."""
    out = None
    for period in periods:
        part = folds.filter(F.col("validation_period") == period)
        model = estimator.fit(part.filter("role = 'train'"))
        scored = model.transform(part.filter("role = 'validation'")).select(
            "validation_period", F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
        out = scored if out is None else out.unionByName(scored)
    return out


CONFIGURATION = ("model_name", "simplicity_rank", "selected_hyperparameters", "feature_group", "feature_count")


def tune_linear(df: DataFrame, configs: Sequence[gram.Config], years: Sequence[int], holdout: str, *, label: str = "label",
                target_ts: str = "target_ts") -> DataFrame:
    """Errors of every linear configuration on every expanding fold, from yearly sums.

    One scan adds up the years, the fits of all folds and configurations follow
    from the sums, and one scan scores the validation years. Huber fits scan
    once per round, for all folds and configurations together.
    """
    if any(f"{y + 1}-01-01" > holdout[:10] for y in years):
        raise DataContractError("Development folds cannot overlap the holdout")
    columns = list(dict.fromkeys(c for x in configs for c in x.columns))
    rows = written(df.filter(F.col(target_ts) < instant(holdout)).select(
        F.year(target_ts).alias("year"), *[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias(label)))
    origin = gram.origins(rows, [*columns, label])
    sums = written(gram.moments(rows, ["year"], [*columns, label], origin=origin))
    fold = "validation_period"
    folds = df.sparkSession.createDataFrame([(str(y),) for y in years], f"{fold} string")
    training = gram.expanded(sums, folds, [])
    models = written(gram.fit(training, [fold], columns, configs, origin, label))
    if any(c.epsilon is not None for c in configs):
        start = gram.fit(training, [fold], columns, [gram.linear_configs(columns, grids=False)[0]], origin, label)
        copies = rows.withColumn(fold, F.explode(F.array_compact(F.array(
            *[F.when(F.col("year") < y, F.lit(str(y))) for y in years]))))
        models = written(models.unionByName(gram.fit_huber(copies, [fold], columns, configs, written(start), label=label)))
    held = rows.filter(F.col("year").isin(*years)).withColumn(fold, F.col("year").cast("string"))
    scored = gram.score_models(held, models, [fold], columns, [label])
    return error_metrics(scored.withColumnsRenamed({label: "actual", "prediction": "predicted"}), [*CONFIGURATION, fold])


def tune(df: DataFrame, candidates: Sequence[Candidate], years: Sequence[int], holdout: str, threads: int = 4) -> DataFrame:
    """Errors of every configuration on every expanding fold.

    Folds are by target time; random folds would leak. Fits are distributed
    jobs, the driver only loops over configurations, a few at a time.
    """
    folds = written(expanding_folds(df, years, holdout), ("validation_period", "role"))

    def errors_of(task: tuple[Candidate, Mapping[str, float]]) -> DataFrame:
        c, params = task
        scored = predict_folds(folds, configured(c.estimator, params), [str(y) for y in years])
        return error_metrics(scored, ["validation_period"]).withColumns({
            "model_name": F.lit(c.name), "simplicity_rank": F.lit(c.simplicity),
            "selected_hyperparameters": F.lit(json.dumps(params, sort_keys=True))})

    with ThreadPoolExecutor(threads) as pool:
        return reduce(DataFrame.unionByName, pool.map(errors_of, [(c, p) for c in candidates for p in c.grid]))


def summarize(errors: DataFrame) -> DataFrame:
    """One row per configuration with mean errors over folds."""
    return fold_aggregate(errors, ["model_name", "simplicity_rank", "selected_hyperparameters"])


def best_configurations(errors: DataFrame) -> DataFrame:
    return best_per_family(summarize(errors))


def ablation(df: DataFrame, groups: Mapping[str, Sequence[str]], factory: Callable[[Sequence[str]], Pipeline],
             model_name: str, years: Sequence[int], holdout: str) -> DataFrame:
    """Fold errors of one model on cumulative feature groups."""
    folds = written(expanding_folds(df, years, holdout), ("validation_period", "role"))
    out = None
    for name, features in groups.items():
        scored = predict_folds(folds, factory(features), [str(y) for y in years])
        errors = error_metrics(scored, ["validation_period"]).withColumns({
            "model_name": F.lit(model_name), "feature_group": F.lit(name), "feature_count": F.lit(len(features))})
        out = errors if out is None else out.unionByName(errors)
    return out


def coefficients(models: DataFrame, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Standardised coefficients: signed, magnitude, sign, rank, largest correlation with another feature.

    ``models`` are rows of ``gram.fit`` over ``features``; one row per model and feature.
    """
    table = models.select("model_name", F.posexplode("standardized").alias("at", "signed_coefficient")).select(
        "model_name", F.get(F.array(*[F.lit(f) for f in features]), "at").alias("feature"), "signed_coefficient")
    sign = F.signum("signed_coefficient")
    ranked = table.withColumns({
        "importance": F.abs("signed_coefficient"),
        "coefficient_sign": F.when(sign > 0, "positive").when(sign < 0, "negative").otherwise("zero")})
    order = Window.partitionBy("model_name").orderBy(F.desc("importance"))
    return ranked.withColumn("coefficient_magnitude_rank", F.dense_rank().over(order)).join(
        max_abs_corr(df, features), "feature", "left")


def final_holdout(df: DataFrame, features: Sequence[str], start, end, *, step_s: int = HOUR,
                  value: str = "price_eur_mwh", label: str = "target_price_next_hour") -> tuple[DataFrame, DataFrame]:
    """Errors of the linear model and the naive baselines on the holdout, and by price regime.

    Split by target time; the holdout is scored once.
    """
    rows = df.withColumns({"target_ts": shift("ts", step_s), "label": F.col(label)})
    model = fit_linear(rows.filter(F.col("target_ts") < instant(start)), features)
    held = rows.filter((F.col("target_ts") >= instant(start)) & (F.col("target_ts") <= instant(end)))
    own = model.transform(held).select(
        F.lit("Ordinary Linear Regression").alias("model_name"), F.col("label").alias("actual"),
        F.col("prediction").alias("predicted"))
    naive = baselines_long(baselines(df.select("series_id", "ts", value), step_s=step_s, value=value)).join(
        held.select("series_id", "ts"), ["series_id", "ts"], "left_semi")
    both = own.unionByName(naive.select("model_name", "actual", "predicted")).filter(
        "actual IS NOT NULL AND predicted IS NOT NULL")
    labelled = both.withColumns({"feature_group": F.lit("all"), "validation_period": F.lit("holdout")})
    return error_metrics(both, ["model_name"]), regime_performance(labelled).filter("validation_period = 'holdout'")


def evaluate_exogenous(rows: DataFrame, features: Sequence[str], validation_start, test_start, *, persistence: str,
                       factory: Factory | None = None, history: DataFrame | None = None, horizons: Sequence[int] = tuple(range(1, 25)),
                       step_s: int = HOUR, min_pairs: int = 2) -> DataFrame:
    """Fit per horizon on train only; candidate, persistence and weekly as-of on identical pairs.

    The candidate is least squares for all horizons from one scan, or the
    estimator that ``factory`` makes for each horizon.

    ``rows`` has (series_id, issue, horizon, target_ts, label, features). A
    baseline without evidence for a pair leaves that pair out, and the candidate
    is also reported on exactly the pairs that the baseline has.
    """
    whole = with_last_target(rows, ["series_id", "issue"])
    parts = by_horizon(purged_split(whole, validation_start, test_start, F.col("last_target")), ("split",))
    training, held = parts.filter("split = 'train'"), parts.filter("split <> 'train'")
    keep = ["series_id", "issue", "target_ts", "split", "label", persistence]
    if factory is None:
        lists = {"all": list(features)}
        scored = score_linear_horizons(held, fit_linear_horizons(training, lists, horizons), lists, keep)
    else:
        scored = score_horizons(held, fit_horizons(training, factory, horizons), keep)
    if history is not None:
        weekly = weekly_asof(scored.select("series_id", "issue", "horizon", "target_ts"), history, step_s=step_s)
        scored = scored.join(weekly, ["series_id", "issue", "horizon", "target_ts"], "left")
    else:
        scored = scored.withColumn("weekly_value", F.lit(None).cast("double"))
    guesses = F.array(
        F.struct(F.lit("Candidate").alias("model_name"), F.col("prediction").alias("predicted")),
        F.struct(F.lit("Persistence").alias("model_name"), F.col(persistence).alias("predicted")),
        F.struct(F.lit("Weekly seasonal naive").alias("model_name"), F.col("weekly_value").alias("predicted")))
    long = scored.select("split", "horizon", F.col("label").alias("actual"), F.col("prediction").alias("candidate"), F.inline(guesses))
    has = is_finite("predicted")
    e, c = F.when(has, F.col("predicted") - F.col("actual")), F.when(has, F.col("candidate") - F.col("actual"))
    facts = long.groupBy("split", "model_name", "horizon").agg(
        F.count(e).alias("observations"), F.count("*").alias("eligible_issue_count"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg(F.abs(c)).alias("candidate_mae_on_same_pairs"),
        F.sqrt(F.avg(c * c)).alias("candidate_rmse_on_same_pairs"))
    enough = F.col("observations") >= min_pairs
    metrics = ("mae", "rmse", "bias", "candidate_mae_on_same_pairs", "candidate_rmse_on_same_pairs")
    return facts.withColumns({m: F.when(enough, F.col(m)) for m in metrics}).withColumn(
        "status", F.when(enough, "Available").otherwise("Insufficient available evidence"))


class Selection(NamedTuple):
    aggregate: DataFrame
    strategy: DataFrame
    test: DataFrame


# The training strategies.
STRATEGIES = ("full_expanding", "rolling_1y", "rolling_2y", "rolling_3y", "recency_weighted_90d", "recency_weighted_180d",
              "recency_weighted_365d", "recency_weighted_730d")


def _strategy_models(training: DataFrame, keys: Sequence[str], columns: Sequence[str], strategies: Sequence[str]) -> DataFrame:
    """Least squares per key, horizon and strategy from one scan; weights are those of the key's own issues."""
    keys = list(keys)
    latest = training.groupBy(*keys).agg(F.max("issue").alias("_latest"))
    dated = training.join(latest, keys)
    weights = {s: strategy_weight(s, "issue", "_latest") for s in strategies}
    origin = gram.origins(training, [*columns, "label"])
    sums = gram.moments(dated, [*keys, "horizon"], [*columns, "label"], weights, origin)
    return written(gram.fit(sums, [*keys, "horizon", "strategy"], columns, gram.linear_configs(columns, grids=False)[:1], origin))


def nested_selection(rows: DataFrame, features: Sequence[str], test_start, *, strategies: Sequence[str] = STRATEGIES,
                     step_s: int = HOUR, horizons: int = 24, min_train: int = 365 * 24) -> Selection:
    """Choose a training strategy per series on its seasonal rolling folds, refit once, test once.

    ``rows`` has (series_id, issue, horizon, target_ts, label, features). The
    folds of every series are rows of a table that is joined to its issues, so
    series with different years keep their own. Test rows are never read before
    the strategies are fixed. A series without a complete year is left out; no
    such series at all is fatal.
    """
    columns, keys = list(features), ["series_id"]
    whole = written(with_last_target(rows, ["series_id", "issue"]))
    before = whole.filter(F.col("last_target") < instant(test_start))
    issues = before.select("series_id", "issue").distinct()
    folds = written(rolling_folds(issues, test_start, keys, step_s=step_s, horizons=horizons, min_train=min_train))
    if not folds.limit(1).count():
        raise DataContractError("No complete year supports all seasonal folds")
    served = before.join(folds.select("series_id", "fold_id", "validation_start", "validation_end"), "series_id")
    training = served.filter(F.col("last_target") < F.col("validation_start"))
    validation = served.filter((F.col("issue") >= F.col("validation_start")) & (F.col("last_target") < F.col("validation_end")))
    models = _strategy_models(training, [*keys, "fold_id"], columns, strategies)
    scored = gram.score_models(validation, models, [*keys, "fold_id", "horizon"], columns, ["label"], ("strategy",)).withColumnsRenamed(
        {"label": "actual", "prediction": "predicted"})
    by = [*keys, "strategy"]
    scored = written(scored)
    errors = metrics_by_horizon(scored, [*by, "fold_id"], horizon="horizon").withColumnRenamed("horizon", "horizon_hours")
    aggregate = written(nested_aggregate(errors, extreme_metrics(scored, [*by, "fold_id"]), by))
    line = Window.partitionBy(*keys).orderBy("mean_rmse", "worst_fold_rmse", "mean_absolute_bias", "strategy")  # a handful per series
    chosen = written(aggregate.withColumn("_r", F.row_number().over(line)).filter("_r = 1").select(*keys, "strategy"))
    refit = _strategy_models(before.join(chosen.select(*keys), keys, "left_semi"), keys, columns, strategies).join(chosen, by)
    held = whole.filter(F.col("issue") >= instant(test_start))
    tested = gram.score_models(held, written(refit), [*keys, "horizon"], columns, ["label"], ("strategy",)).withColumnsRenamed(
        {"label": "actual", "prediction": "predicted"})
    test = metrics_by_horizon(tested, by, horizon="horizon").withColumnRenamed("horizon", "horizon_hours")
    return Selection(aggregate, chosen, test)


# --- isolation forest ---------------------------------------------------------------------------

def _path_length(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    many = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, depth + expected remaining length) of one random tree."""
    nodes: list[tuple] = []

    def split(rows: np.ndarray, depth: int) -> int:
        index = len(nodes)
        nodes.append(())
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes[index] = (-1, 0.0, -1, -1, depth + float(_path_length(len(rows))))
            return index
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        left = split(rows[rows[:, feature] < cut], depth + 1) if (rows[:, feature] < cut).any() else -1
        right = split(rows[rows[:, feature] >= cut], depth + 1)
        if left < 0:
            left = right
        nodes[index] = (feature, cut, left, right, 0.0)
        return index

    split(points, 0)
    return nodes


def isolation_forest(df: DataFrame, columns: Sequence[str], contamination: float, *, key: Sequence[str], trees: int = 100,
                     sample: int = 256, seed: int = 42) -> DataFrame:
    """Anomaly score of every row and the label of the ``contamination`` share with the highest score.

    Sampling is part of the method: every tree draws its own ``sample`` rows
    from the whole table, those with the smallest hash of tree and row key. The
    trees, a few hundred nodes each, are grown in parallel, one group per tree,
    and broadcast; every row is scored where it lies.
    """
    spark = df.sparkSession
    rows = df.filter(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in columns))
    total = rows.count()
    if total == 0:
        return rows.withColumns({"anomaly_score": F.lit(None).cast("double"), "is_anomaly": F.lit(False)})
    size = min(sample, total)
    # A row is sent to a tree only if its hash is likely to be among the smallest: some 4 x sample rows a tree.
    likely = int(min(1.0, 4.0 * size / total) * (1 << 40)) + 1

    def rank(tree):
        return F.pmod(F.xxhash64(F.lit(seed), tree, *[F.col(k) for k in key]), F.lit(1 << 40))

    drawn = rows.withColumn("_p", F.explode(F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), rank(t).alias("h"))),
        lambda p: p["h"] < likely)))
    drawn = drawn.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col("_p.tree").alias("_tree"), F.col("_p.h").alias("_h"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        chosen = pdf.sort_values(["_h", *columns])[list(columns)].to_numpy()[:size]
        nodes = _grow(chosen, rng, int(np.ceil(np.log2(max(size, 2)))))
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "length"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    grown = drawn.groupBy("_tree").applyInPandas(
        grow, "tree int, node int, feature int, cut double, left int, right int, length double")
    table = grown.toPandas().sort_values(["tree", "node"])  # trees x a few hundred nodes, whatever the table size
    forest = spark.sparkContext.broadcast([
        tuple(part[c].to_numpy() for c in ("feature", "cut", "left", "right", "length")) for _, part in table.groupby("tree")])
    normal = float(_path_length(size)) or 1.0

    @F.pandas_udf("double")
    def depth_score(*values: pd.Series) -> pd.Series:
        points = np.column_stack([v.to_numpy(dtype=float) for v in values])
        lengths = np.zeros(len(points))
        for feature, cut, left, right, length in forest.value:
            at = np.zeros(len(points), dtype=int)
            open_ = feature[at] >= 0
            while open_.any():
                here = at[open_]
                goes = points[open_, feature[here]] < cut[here]
                at[open_] = np.where(goes, left[here], right[here])
                open_ = feature[at] >= 0
            lengths += length[at]
        return pd.Series(np.power(2.0, -(lengths / len(forest.value)) / normal))

    # Scored once, read for the cut and for the result.
    scored = written(rows.withColumn("anomaly_score", depth_score(*[F.col(c).cast("double") for c in columns])))
    cut = exact_quantiles(scored.select("anomaly_score"), [], "anomaly_score", [1.0 - contamination]).first()["quantiles"][0]
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(cut))
