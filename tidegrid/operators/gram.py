"""Linear models from sums of products.

One scan adds up, per key (a fold, a year, a horizon, a series), the products
of every two columns. Whatever is linear in the rows follows from these sums
alone: ordinary, ridge, lasso and elastic-net fits of any configuration and
any subset of the columns, and correlations. Sums of disjoint keys add up, so
expanding folds come from yearly sums. Fits run in parallel, one group per key;
a group is a matrix, whatever the number of rows behind it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.session import written

#: Keys whose sums a task holds before it passes them on.
HELD_KEYS = 2_000
#: Sweeps of the coordinate descent, and the relative change that ends it.
SWEEPS, TOLERANCE = 20_000, 1e-9


class Config(NamedTuple):
    """One configuration: penalty ``alpha`` (None: none), share of the absolute part, and the columns it may use."""

    model_name: str
    simplicity_rank: int
    params: str
    alpha: float | None
    l1_ratio: float
    feature_group: str
    columns: tuple[str, ...]
    epsilon: float | None = None


# The searched grids, by family.
RIDGE_ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
LASSO_ALPHAS = (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0)
ELASTIC_ALPHAS = (0.0001, 0.001, 0.01, 0.1, 1.0)
ELASTIC_RATIOS = (0.1, 0.25, 0.5, 0.75, 0.9)
HUBER_EPSILONS = (1.35, 1.75)
HUBER_ALPHAS = (0.0001, 0.01)


def linear_configs(columns: Sequence[str], group: str = "Full", grids: bool = True) -> list[Config]:
    """The linear families with their grids, or with one standard setting each."""
    def made(name, rank, penalty, share, beyond=None, **params):
        return Config(name, rank, json.dumps(params, sort_keys=True), penalty, share, group, tuple(columns), beyond)

    ridge, lasso = (RIDGE_ALPHAS, LASSO_ALPHAS) if grids else ((1.0,), (1.0,))
    elastic = [(a, r) for a in ELASTIC_ALPHAS for r in ELASTIC_RATIOS] if grids else [(1.0, 0.5)]
    huber = [(e, a) for e in HUBER_EPSILONS for a in HUBER_ALPHAS] if grids else [(1.35, 0.0001)]
    return [made("Ordinary Linear Regression", 1, None, 0.0),
            *[made("Ridge Regression", 2, a, 0.0, alpha=a) for a in ridge],
            *[made("Lasso Regression", 3, a, 1.0, alpha=a) for a in lasso],
            *[made("Elastic Net", 4, a, r, alpha=a, l1_ratio=r) for a, r in elastic],
            *[made("Huber Regressor", 5, a, 0.0, e, alpha=a, epsilon=e) for e, a in huber]]


# --- sums ------------------------------------------------------------------------------

def origins(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """A level of every column that its products are taken about, so that large levels cost no digits."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return {c: float(means[c]) if means[c] is not None and np.isfinite(means[c]) else 0.0 for c in columns}


def key_rows(batch: pd.DataFrame, keys: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Each key of a batch and the places of its rows."""
    if not keys:
        yield (), np.arange(len(batch))
        return
    for key, at in batch.groupby(list(keys), sort=False, dropna=False).indices.items():
        yield key if isinstance(key, tuple) else (key,), at


def moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str], weights: Mapping[str, Column] | None = None,
            origin: Mapping[str, float] | None = None, variant: str = "strategy") -> DataFrame:
    """keys, i, j (i <= j) and value: sums of the products of columns i and j over the rows of a key.

    Column 0 is the constant 1, the others follow in order, each less its
    ``origin``. Rows with a null or infinite value in any column are left out.
    Every task adds up its own rows first, so a key of any size is a few
    hundred numbers from each task. ``weights`` names several weightings of the
    same rows, whose sums come from the same scan under the key ``variant``; a
    null weight or 0 leaves a row out.
    """
    keys, size = list(keys), len(columns) + 1
    level = np.array([0.0, *[(origin or {}).get(c, 0.0) for c in columns]])
    one, other = np.triu_indices(size)
    kinds = dict(df.dtypes)
    names = [*keys, variant] if weights else keys
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *([f"{variant} string"] if weights else []), "i int", "j int", "value double"])
    scales = {f"__w{n}": name for n, name in enumerate(weights or {})}

    def rows_of(held: dict) -> pd.DataFrame:
        out = {k: [x for name in held for x in [name[n]] * len(one)] for n, k in enumerate(names)}
        return pd.DataFrame({**out, "i": np.tile(one, len(held)), "j": np.tile(other, len(held)),
                             "value": np.concatenate([m[one, other] for m in held.values()])})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            values = np.column_stack([np.ones(len(batch)), batch[list(columns)].to_numpy(float)]) - level
            good = np.isfinite(values).all(axis=1)
            batch, values = batch[good].reset_index(drop=True), values[good]
            factors = {(name,): np.nan_to_num(batch[w].to_numpy(float)) for w, name in scales.items()} or {(): None}
            for key, at in key_rows(batch, keys):
                x = values[at]
                for name, factor in factors.items():
                    sums = x.T @ x if factor is None else (x * factor[at, None]).T @ x
                    if factor is None or sums[0, 0] > 0:
                        held[key + name] = held[key + name] + sums if key + name in held else sums
            if len(held) > HELD_KEYS:
                yield rows_of(held)
                held = {}
        if held:
            yield rows_of(held)

    chosen = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns],
                       *[weights[name].cast("double").alias(n) for n, name in scales.items()])
    return chosen.mapInPandas(add, schema).groupBy(*names, "i", "j").agg(F.sum("value").alias("value"))


def expanded(sums: DataFrame, folds: DataFrame, keys: Sequence[str], period: str = "year", fold: str = "validation_period") -> DataFrame:
    """Sums of a fold's training rows: those of its keys' periods before it. ``folds`` holds keys and fold."""
    keys = list(keys)
    joined = sums.join(folds, keys) if keys else sums.join(F.broadcast(folds), F.col(period) < F.col(fold).cast("int"))
    return joined.filter(F.col(period) < F.col(fold).cast("int")).groupBy(*keys, fold, "i", "j").agg(F.sum("value").alias("value"))


def _matrix(group: pd.DataFrame, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    i, j = group["i"].to_numpy(int), group["j"].to_numpy(int)
    out[i, j] = out[j, i] = group["value"].to_numpy(float)
    return out


# --- fits ------------------------------------------------------------------------------

class Centred(NamedTuple):
    rows: float
    mean: np.ndarray
    scale: np.ndarray
    gram: np.ndarray  # of the centred and scaled features, divided by the rows
    cross: np.ndarray  # with the centred label, divided by the rows
    label_mean: float


def centred(sums: np.ndarray, use: np.ndarray, label: int) -> Centred:
    """Standardise by the sums; a column that does not vary gets no weight."""
    n = sums[0, 0]
    mean, level = sums[0, use] / n, sums[0, label] / n
    cover = sums[np.ix_(use, use)] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cover), 0.0))
    floor = 1e-9 * np.sqrt(np.maximum(np.diag(sums)[use] / n, 0.0)) + 1e-300
    scale = np.where(spread > floor, spread, np.inf)
    return Centred(n, mean, scale, cover / np.outer(scale, scale), (sums[use, label] / n - mean * level) / scale, level)


def descend(gram: np.ndarray, cross: np.ndarray, hard: np.ndarray, soft: np.ndarray) -> np.ndarray:
    """Minima of w'Gw / 2 - c'w + hard |w| + soft w'w / 2, one column per pair of penalties, by coordinate descent."""
    size = len(cross)
    out = np.zeros((size, len(hard)))
    diagonal = np.diag(gram)
    live = np.arange(len(hard))
    step = TOLERANCE * max(float(np.abs(cross).max(initial=0.0)), 1e-300)
    fixed = diagonal > 0
    for _ in range(SWEEPS):
        w, most = out[:, live], np.zeros(len(live))
        for j in np.flatnonzero(fixed):
            rest = cross[j] - gram[j] @ w + diagonal[j] * w[j]
            new = np.sign(rest) * np.maximum(np.abs(rest) - hard[live], 0.0) / (diagonal[j] + soft[live])
            most = np.maximum(most, np.abs(new - w[j]))
            w[j] = new
        out[:, live] = w
        live = live[most > step]
        if not len(live):
            break
    return out


def solve(sums: np.ndarray, columns: Sequence[str], configs: Sequence[Config]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Coefficients, standardised coefficients (both over ``columns``) and intercept of every configuration.

    ``sums`` is over 1, the columns and the label, in this order.
    """
    out: list = [None] * len(configs)
    label = len(columns) + 1
    for names in dict.fromkeys(c.columns for c in configs):
        use = np.array([columns.index(c) + 1 for c in names], dtype=int)
        c = centred(sums, use, label)
        same = [k for k, x in enumerate(configs) if x.columns == names]
        path = [k for k in same if configs[k].alpha is not None and configs[k].l1_ratio > 0]
        found = {}
        if path:
            alpha, share = (np.array([getattr(configs[k], f) for k in path]) for f in ("alpha", "l1_ratio"))
            found = dict(zip(path, descend(c.gram, c.cross, alpha * share, alpha * (1 - share)).T, strict=True))
        for k in same:
            if k in found:
                w = found[k]
            elif configs[k].alpha is None:
                w = np.linalg.pinv(c.gram, rcond=1e-11, hermitian=True) @ c.cross
            else:
                w = np.linalg.solve(c.gram + np.diag(np.full(len(use), configs[k].alpha / c.rows)), c.cross)
            scaled, plain = np.zeros(len(columns)), np.zeros(len(columns))
            scaled[use - 1], plain[use - 1] = w, w / c.scale
            out[k] = (plain, scaled, float(c.label_mean - plain[use - 1] @ c.mean))
    return out


MODEL_COLUMNS = ("model_name string, simplicity_rank int, selected_hyperparameters string, feature_group string, "
                 "feature_count int, train_rows double, coefficients array<double>, standardized array<double>, intercept double")


def fit(sums: DataFrame, keys: Sequence[str], columns: Sequence[str], configs: Sequence[Config],
        origin: Mapping[str, float] | None = None, label: str = "label") -> DataFrame:
    """One row per key and configuration: coefficients in the order of ``columns``, and the intercept.

    ``sums`` are the moments of (*columns, label). Scales are those of the
    key's own rows, with the population deviation. Penalties: ridge adds
    alpha w'w to the sum of squares; lasso and elastic net add alpha (l1 |w| +
    (1 - l1) w'w / 2) to half the mean of squares. A key without rows has no
    models. Huber configurations are fitted by ``fit_huber``.
    """
    keys, columns = list(keys), list(columns)
    wanted = [c for c in configs if c.epsilon is None]
    kinds = dict(sums.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), MODEL_COLUMNS])
    level = np.array([(origin or {}).get(c, 0.0) for c in columns])
    label_level = (origin or {}).get(label, 0.0)

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        matrix = _matrix(group, len(columns) + 2)
        solved = solve(matrix, columns, wanted) if matrix[0, 0] > 0 else []
        rows = [[*[group[k].iloc[0] for k in keys], c.model_name, c.simplicity_rank, c.params, c.feature_group, len(c.columns),
                 matrix[0, 0], plain.tolist(), scaled.tolist(), intercept + label_level - float(plain @ level)]
                for c, (plain, scaled, intercept) in zip(wanted, solved, strict=False)]
        return pd.DataFrame(rows, columns=[*keys, *(c.split()[0] for c in MODEL_COLUMNS.split(", "))])

    if not keys:
        return sums.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(fitted, schema)
    return sums.groupBy(*keys).applyInPandas(fitted, schema)


def predicted(columns: Sequence[str], coefficients: str = "coefficients", intercept: str = "intercept") -> Column:
    """The prediction of a row that carries a model's coefficients."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    products = F.zip_with(values, F.col(coefficients), lambda x, b: F.when(b == 0, 0.0).otherwise(x * b))
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x) + F.col(intercept)


def score_models(rows: DataFrame, models: DataFrame, keys: Sequence[str], columns: Sequence[str], keep: Sequence[str],
                 carry: Sequence[str] = ("model_name", "simplicity_rank", "selected_hyperparameters", "feature_group", "feature_count")) -> DataFrame:
    """Predictions of every row by all models of its key: keys, keep, carry and prediction.

    ``models`` must be a written table, whose size then decides on a broadcast.
    """
    keys = list(keys)
    of = models.select(*keys, *carry, "coefficients", "intercept")
    facts = rows.select(*dict.fromkeys([*keys, *keep, *columns]))
    joined = facts.join(of, keys) if keys else facts.withColumn("__one", F.lit(0)).join(of.withColumn("__one", F.lit(0)), "__one")
    return joined.select(*keys, *[k for k in keep if k not in keys], *carry, predicted(columns).alias("prediction"))


# --- Huber -----------------------------------------------------------------------------

def fit_huber(train: DataFrame, keys: Sequence[str], columns: Sequence[str], configs: Sequence[Config], start: DataFrame, *,
              label: str = "label", rounds: int = 100, tolerance: float = 1e-7) -> DataFrame:
    """Huber fits with a scale of their own, by reweighted sums: one scan per round for all keys and configurations.

    Minimises sum(s + H(r / s) s) + alpha w'w over w (of the standardised
    columns) and s, where H is quadratic up to epsilon. Rows beyond epsilon
    weigh epsilon s / |r|. ``start`` holds unpenalised models of the keys with
    the names of ``fit``. The models of a round, one row per key and
    configuration, pass through the driver; keys must be few (folds).
    """
    keys, columns = list(keys), list(columns)
    wanted = [c for c in configs if c.epsilon is not None]
    kinds = dict(train.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), MODEL_COLUMNS])
    spark = train.sparkSession
    if not wanted:
        return spark.createDataFrame([], schema)
    facts = written(train.select(*keys, *columns, label))
    mean = origins(facts, [*columns, label])
    plain = moments(facts, keys, [*columns, label], origin=mean)
    name_of = lambda row: tuple(getattr(row, k) for k in keys)
    base = {name: _matrix(part, len(columns) + 2) for name, part in
            ((n if isinstance(n, tuple) else (n,), p) for n, p in plain.toPandas().groupby(keys, dropna=False))}
    level, label_level = np.array([mean[c] for c in columns]), mean[label]
    first = {name_of(r): (np.array(r.coefficients), r.intercept) for r in start.collect()}
    state = {}
    for name, sums in base.items():
        for k, c in enumerate(wanted):
            coefficients, intercept = first[name]
            used = np.isin(columns, c.columns)
            state[name, k] = [np.where(used, coefficients, 0.0), intercept + float(np.where(used, coefficients, 0.0) @ level) - label_level, None]
    use_of = [np.array([columns.index(x) + 1 for x in c.columns]) for c in wanted]
    pending = set(state)
    for turn in range(rounds):
        if not pending:
            break
        sent = spark.sparkContext.broadcast({s: (state[s][0], state[s][1], state[s][2]) for s in pending})
        size = len(columns) + 2
        one, other = np.triu_indices(size)

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict = {}
            for batch in batches:
                values = np.column_stack([np.ones(len(batch)), batch[[*columns, label]].to_numpy(float) - [*level, label_level]])
                good = np.isfinite(values).all(axis=1)
                batch, values = batch[good].reset_index(drop=True), values[good]
                for name, at in key_rows(batch, keys):
                    x = values[at]
                    for k, c in enumerate(wanted):
                        if (name, k) not in sent.value:
                            continue
                        b, b0, s = sent.value[name, k]
                        r = np.abs(x[:, -1] - b0 - x[:, 1:-1] @ b)
                        outside = r > c.epsilon * s if s is not None else np.zeros(len(r), bool)
                        w = np.where(outside, c.epsilon * (s or 0.0) / np.maximum(r, 1e-300), 1.0)
                        new = [(x * w[:, None]).T @ x, float((r[~outside] ** 2).sum()), float(outside.sum())]
                        old = held.get((name, k))
                        held[name, k] = new if old is None else [a + n for a, n in zip(old, new, strict=True)]
            for (name, k), (sums, inner, out) in held.items():
                yield pd.DataFrame({**{x: [name[n]] for n, x in enumerate(keys)}, "k": [k], "inner": [inner], "outside": [out],
                                    "sums": [sums[one, other].tolist()]})

        shape = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "k int, inner double, outside double, sums array<double>"])
        parts = facts.mapInPandas(add, shape).select(*keys, "k", "inner", "outside", F.posexplode("sums").alias("at", "value"))
        total = parts.groupBy(*keys, "k", "at").agg(F.sum("value").alias("value"), F.sum("inner").alias("inner"), F.sum("outside").alias("outside"))
        done = set()
        for name, part in total.toPandas().groupby([*keys, "k"], dropna=False):
            name, k = tuple(name[:-1]), int(name[-1])
            part = part.sort_values("at")
            sums = np.zeros((size, size))
            sums[one, other] = sums[other, one] = part["value"].to_numpy()
            n = base[name][0, 0]
            alpha, epsilon, use = wanted[k].alpha, wanted[k].epsilon, use_of[k]
            b, b0, s = state[name, k]
            inner, out = part["inner"].iloc[0], part["outside"].iloc[0]
            room = n - out * epsilon**2
            s_new = float(np.sqrt(max(inner, 0.0) / room)) if room > 0 else (s or 0.0) / 2
            if s is None:  # the first round only finds a scale
                state[name, k][2] = max(s_new, 1e-12)
                continue
            c = centred(base[name], use, size - 1)  # scales of the unweighted rows
            live = np.isfinite(c.scale)  # a constant column stays out
            rows, scale = np.concatenate([[0], use[live]]), c.scale[live]
            unit = np.concatenate([[1.0], scale])
            left = sums[np.ix_(rows, rows)] / np.outer(unit, unit) + np.diag(np.concatenate([[0.0], np.full(len(scale), alpha * s)]))
            w = np.linalg.lstsq(left, sums[rows, size - 1] / unit, rcond=1e-13)[0]
            new = np.zeros(len(columns))
            new[use[live] - 1] = w[1:] / scale
            moved = max(float(np.abs((new - b)[use[live] - 1] * scale).max(initial=0.0)), abs(s_new - s))
            state[name, k] = [new, float(w[0]), max(s_new, 1e-12)]
            if moved < tolerance * max(float(np.abs(w).max()), s_new, 1e-12):
                done.add((name, k))
        sent.destroy()
        pending -= done
    rows = []
    for (name, k), (b, b0, _) in state.items():
        c = wanted[k]
        scale = centred(base[name], np.arange(1, len(columns) + 1), len(columns) + 1).scale
        rows.append((*name, c.model_name, c.simplicity_rank, c.params, c.feature_group, len(c.columns), float(base[name][0, 0]),
                     b.tolist(), (b * np.where(np.isfinite(scale), scale, 0.0)).tolist(), b0 + label_level - float(b @ level)))
    return spark.createDataFrame(rows, schema)


# --- correlations ----------------------------------------------------------------------

def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b and correlation of every two columns over the rows that have both, from one scan of matrix products.

    Null where fewer than two such rows exist or one column does not vary.
    """
    names, origin = list(columns), origins(df, columns)
    level = np.array([origin[c] for c in names])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, len(names), len(names)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - level
            known = np.isfinite(x).astype(float)
            x = np.where(known > 0, x, 0.0)
            held += np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        i, j = np.triu_indices(len(names), 1)
        flip = np.transpose(held, (0, 2, 1))
        sums = {"n": held[0][i, j], "x": held[1][i, j], "y": flip[1][i, j], "xx": held[2][i, j], "yy": flip[2][i, j], "xy": held[3][i, j]}
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, sums.values())],
                                         names=["i", "j", *sums])

    sums = ("n", "x", "y", "xx", "yy", "xy")
    parts = df.select(*[F.col(c).cast("double") for c in names]).mapInArrow(add, "i int, j int, " + ", ".join(f"{s} double" for s in sums))
    total = parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums])
    var = lambda a, aa: F.greatest(F.col(aa) - F.col(a) * F.col(a) / F.col("n"), F.lit(0.0))
    spread = F.sqrt(var("x", "xx") * var("y", "yy"))
    flat = (var("x", "xx") <= 1e-14 * F.col("xx")) | (var("y", "yy") <= 1e-14 * F.col("yy"))
    value = F.when((F.col("n") >= 2) & ~flat & (spread > 0), (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.nullif(spread, F.lit(0.0)))
    name = F.array(*[F.lit(c) for c in names])
    return total.select(F.get(name, "i").alias("a"), F.get(name, "j").alias("b"), F.when(value > 1, 1.0).when(value < -1, -1.0).otherwise(value).alias("correlation"))
