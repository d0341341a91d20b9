"""Second-order histogram boosting of many models at once.

Feature values become numbers of quantile bins. A level of a tree needs, for
every open node, feature and bin, the sums of gradients and hessians; the best
split maximises the regularised gain. All models (configurations and folds)
grow their trees of a round together. Rows that fit into ``LOCAL_ROWS`` are
broadcast and the models are spread over tasks; more rows stay where they are,
and one aggregation per level adds up the histograms of all models. Both ways
run the same steps.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.session import written

BINS = 64
#: Rows that may be broadcast so that models instead of rows are spread over tasks.
LOCAL_ROWS = 200_000
#: Rows of a block, and rounds after which the margins are written.
BLOCK_ROWS, KEPT_ROUNDS = 20_000, 10


class Boost(NamedTuple):
    """One configuration; ``reg_lambda`` 0 gives plain gradient boosting of squared errors."""

    model_name: str
    simplicity_rank: int
    feature_group: str
    columns: tuple[str, ...]
    rounds: int = 100
    rate: float = 0.3
    depth: int = 6
    reg_lambda: float = 1.0
    min_child: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0
    seed: int = 42
    params: str = "{}"


def boosted_family(plain: Sequence[str], second_order: Sequence[str]) -> list[Boost]:
    """Gradient boosting and second-order boosting with their grids; the first of each is the untuned reference."""
    def made(base: Boost, **axes):
        rows = [{}]
        for name, values in axes.items():
            rows = [{**r, name: v} for r in rows for v in values]
        return [base, *(base._replace(**r, params=json.dumps(r, sort_keys=True)) for r in rows)]

    # The searched grids.
    return [
        *made(Boost("Gradient Boosting", 7, "Time + Price + Load + Generation", tuple(plain), 100, 0.1, 3, 0.0),
              rounds=[100, 200], rate=[0.03, 0.05], depth=[2, 3]),
        *made(Boost("XGBoost", 8, "Time + Price History", tuple(second_order)),
              rounds=[300, 500], rate=[0.03, 0.05], depth=[2, 3], subsample=[0.8], colsample=[0.8]),
    ]


# --- trees -----------------------------------------------------------------------------

class Tree(NamedTuple):
    """A complete binary tree: children of node i are 2i + 1 and 2i + 2; feature -1 ends a path."""

    feature: np.ndarray
    cut: np.ndarray  # bins up to it go left
    value: np.ndarray

    def leaf(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node in which every row ends after at most ``depth`` steps."""
        at = np.zeros(len(bins), dtype=np.int64)
        for _ in range(depth):
            inner = self.feature[at] >= 0
            right = bins[np.arange(len(bins)), np.maximum(self.feature[at], 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


def empty_tree(depth: int) -> Tree:
    size = 2 ** (depth + 1) - 1
    return Tree(np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size))


def histogram(bins: np.ndarray, nodes: np.ndarray, gradients: np.ndarray, first: int, width: int, columns: np.ndarray) -> np.ndarray:
    """Sums of gradients and counts (the hessians of squared errors) by node of a level, column and bin."""
    inside = nodes >= first
    place = (nodes[inside] - first)[:, None] * len(columns) + np.arange(len(columns))
    flat = (place * BINS + bins[inside][:, columns]).ravel()
    size = width * len(columns) * BINS
    weights = np.repeat(gradients[inside], len(columns))
    return np.stack([np.bincount(flat, weights, size), np.bincount(flat, minlength=size).astype(float)]).reshape(2, width, len(columns), BINS)


def split(sums: np.ndarray, config: Boost) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node of a level: best gain (-inf without one), column place, cut, and the node's leaf value."""
    g, h = sums
    lam = config.reg_lambda
    left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
    all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
    score = lambda a, b: np.where(b + lam > 0, a * a / np.where(b + lam > 0, b + lam, 1.0), 0.0)
    gain = score(left_g, left_h) + score(all_g - left_g, all_h - left_h) - score(all_g, all_h)
    least = max(config.min_child, 1e-9)
    gain = np.where((left_h >= least) & (all_h - left_h >= least), gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    # equal gains up to rounding go to the first column and bin, whatever the order of summation
    best = flat.max(axis=1, initial=-np.inf)
    with np.errstate(invalid="ignore"):
        at = np.argmax(flat >= (best - 1e-9 * np.abs(best))[:, None], axis=1)
    total_g, total_h = all_g[:, 0, 0], all_h[:, 0, 0]
    value = np.where(total_h + lam > 0, -total_g / np.where(total_h + lam > 0, total_h + lam, 1.0), 0.0)
    return np.where(best > 1e-9, best, -np.inf), at // BINS, at % BINS, value


def drawn_columns(config: Boost, turn: int) -> np.ndarray:
    """The columns of a round's tree."""
    many = len(config.columns)
    if config.colsample >= 1:
        return np.arange(many)
    rng = np.random.default_rng([config.seed, turn])
    return np.sort(rng.permutation(many)[: max(1, int(many * config.colsample))])


def drawn_rows(config: Boost, turn: int, hashes: np.ndarray) -> np.ndarray:
    """The rows of a round's tree, by a hash of row and round."""
    if config.subsample >= 1:
        return np.ones(len(hashes), dtype=bool)
    x = hashes.astype(np.uint64) ^ np.uint64((config.seed * 0x9E3779B97F4A7C15 + turn * 0xC2B2AE3D27D4EB4F) % 2**64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x >> np.uint64(40)).astype(float) / 2.0**24 < config.subsample


def grow(config: Boost, turn: int, sums: Callable[[Tree, int, int, np.ndarray], np.ndarray]) -> Tree:
    """One tree, level by level; ``sums(tree, first, width, columns)`` gives the histogram of a level."""
    tree, columns = empty_tree(config.depth), drawn_columns(config, turn)
    for level in range(config.depth + 1):
        first, width = 2**level - 1, 2**level
        settle(tree, first, columns, config, sums(tree, first, width, columns), level < config.depth)
    return tree


def settle(tree: Tree, first: int, columns: np.ndarray, config: Boost, level_sums: np.ndarray, open_: bool) -> None:
    """Write a level's leaf values and, while the tree may go deeper, its splits."""
    gain, place, cut, value = split(level_sums, config)
    width = len(gain)
    tree.value[first : first + width] = value * config.rate
    if open_:
        good = np.isfinite(gain)
        tree.feature[first : first + width] = np.where(good, columns[place], -1)
        tree.cut[first : first + width] = cut


def train_here(config: Boost, bins: np.ndarray, labels: np.ndarray, hashes: np.ndarray) -> tuple[float, list[Tree]]:
    """All rounds of one model over rows in memory."""
    base = float(labels.mean())
    margin, trees = np.full(len(labels), base), []
    for turn in range(config.rounds):
        use = drawn_rows(config, turn, hashes)
        own, gradients = bins[use], (margin - labels)[use]
        tree = grow(config, turn, lambda t, first, width, columns, own=own, gradients=gradients: histogram(
            own, _reached(t, own, first), gradients, first, width, columns))
        margin += tree.value[tree.leaf(bins, config.depth)]
        trees.append(tree)
    return base, trees


def _reached(tree: Tree, bins: np.ndarray, first: int) -> np.ndarray:
    """The node of the level that starts at ``first``; a row that ended above it gets -1."""
    at = tree.leaf(bins, int(first + 1).bit_length() - 1)
    return np.where(at >= first, at, -1)


# --- rows ------------------------------------------------------------------------------

def thresholds(rows: DataFrame, columns: Sequence[str]) -> dict[str, np.ndarray]:
    """Bin bounds of every column from one pass of quantile sketches: a value goes to the number of bounds below it."""
    sketch = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), [i / BINS for i in range(1, BINS)], 10_000).alias(c) for c in columns]).first()
    return {c: np.unique(np.array(sketch[c] or [], dtype=float)) for c in columns}


BLOCK = "size int, bins binary, labels binary, hashes binary, members binary"


def blocks(rows: DataFrame, columns: Sequence[str], bounds: dict[str, np.ndarray], label: str, masks: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The rows as a written table of blocks: bins, labels, row hashes, and which of ``masks`` (boolean columns) hold."""
    edges = [bounds[c] for c in columns]
    width = len(columns)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.iloc[at : at + BLOCK_ROWS]
                bins = np.empty((len(part), width), dtype=np.uint8)
                for n in range(width):
                    bins[:, n] = np.searchsorted(edges[n], part.iloc[:, n].to_numpy(float), side="left")
                member = part.iloc[:, width + 2 :].to_numpy(bool)
                yield pd.DataFrame({"size": [len(part)], "bins": [bins.tobytes()], "labels": [part["__label"].to_numpy(float).tobytes()],
                                    "hashes": [part["__hash"].to_numpy(np.int64).tobytes()], "members": [member.tobytes()]})

    chosen = rows.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("__label"),
                         F.xxhash64(*key).alias("__hash"), *[F.col(m).alias(f"__{m}") for m in masks])
    return written(chosen.na.drop().mapInPandas(pack, BLOCK))


def _unpacked(row, width: int, masks: int):
    n = row["size"]
    return (np.frombuffer(row["bins"], np.uint8).reshape(n, width), np.frombuffer(row["labels"], float),
            np.frombuffer(row["hashes"], np.int64), np.frombuffer(row["members"], bool).reshape(n, masks))


TREES = "model int, round int, base double, feature array<int>, cut array<int>, value array<double>"


def _tree_rows(model: int, base: float, trees: Sequence[Tree], first: int = 0) -> list[tuple]:
    return [(model, first + n, base, t.feature.tolist(), t.cut.tolist(), t.value.tolist()) for n, t in enumerate(trees)]


def train(table: DataFrame, width: int, models: Sequence[tuple[Boost, int]], masks: int, columns: Sequence[str],
          local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Trees of every model; ``models`` pairs a configuration with the mask that marks its training rows.

    The trees, rounds x models x a few nodes each, are the result; a model
    whose mask holds no row has none.
    """
    spark = table.sparkSession
    places = [np.array([columns.index(c) for c in config.columns]) for config, _ in models]
    if (table.agg(F.sum("size")).first()[0] or 0) <= local_rows:
        parts = [_unpacked(r, width, masks) for r in table.collect()]
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None
        sent = spark.sparkContext.broadcast((joined, models, places))

        def fit(numbers: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows, configs, own = sent.value
            for batch in numbers:
                for m in batch["model"]:
                    config, mask = configs[m]
                    if rows is None or not rows[3][:, mask].any():
                        continue
                    use = rows[3][:, mask]
                    base, trees = train_here(config, rows[0][use][:, own[m]], rows[1][use], rows[2][use])
                    yield pd.DataFrame(_tree_rows(int(m), base, trees), columns=[c.split()[0] for c in TREES.split(", ")])

        # long models first, each in a task of its own
        order = sorted(range(len(models)), key=lambda m: -models[m][0].rounds * 2 ** models[m][0].depth)
        numbers = spark.createDataFrame([(m,) for m in order], "model int").repartition(min(len(models), 64))
        return written(numbers.mapInPandas(fit, TREES))
    return _train_apart(table, width, models, masks, places)


def _train_apart(table: DataFrame, width: int, models: Sequence[tuple[Boost, int]], masks: int, places: list[np.ndarray]) -> DataFrame:
    """Rows stay in their blocks: one aggregation per level for all models; margins are written every few rounds."""
    spark = table.sparkSession

    def sums_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, many = np.zeros(masks), np.zeros(masks)
        for batch in batches:
            for _, row in batch.iterrows():
                _, labels, _, member = _unpacked(row, width, masks)
                total, many = total + labels @ member, many + member.sum(axis=0)
        yield pd.DataFrame({"mask": np.arange(masks), "total": total, "many": many})

    means = {r.mask: r.total / r.many for r in table.mapInPandas(sums_of, "mask int, total double, many double").groupBy("mask").agg(
        F.sum("total").alias("total"), F.sum("many").alias("many")).filter("many > 0").collect()}
    live = [m for m, (_, mask) in enumerate(models) if mask in means]
    bases = {m: float(means[models[m][1]]) for m in live}
    start = {m: bases[m] for m in live}

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(margins=[np.repeat([[start[m] for m in live]], n, axis=0).tobytes() for n in batch["size"]])

    state = written(table.mapInPandas(begin, f"{BLOCK}, margins binary"))
    done, recent = {m: [] for m in live}, {m: [] for m in live}

    def advanced(row, bins, trees):
        margins = np.frombuffer(row["margins"], float).reshape(row["size"], len(live)).copy()
        for n, m in enumerate(live):
            for tree in trees[m]:
                margins[:, n] += tree.value[tree.leaf(bins[:, places[m]], models[m][0].depth)]
        return margins

    for turn in range(max((models[m][0].rounds for m in live), default=0)):
        active = [m for m in live if turn < models[m][0].rounds]
        trees = {m: empty_tree(models[m][0].depth) for m in active}
        for level in range(max(models[m][0].depth for m in active) + 1):
            first, wide = 2**level - 1, 2**level
            deep = [m for m in active if level <= models[m][0].depth]
            sent = spark.sparkContext.broadcast((recent, trees, deep))

            def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                old, growing, wanted = sent.value
                held: dict[int, np.ndarray] = {}
                for batch in batches:
                    for _, row in batch.iterrows():
                        bins, labels, hashes, member = _unpacked(row, width, masks)
                        margins = advanced(row, bins, old)
                        for m in wanted:
                            config, mask = models[m]
                            use = member[:, mask] & drawn_rows(config, turn, hashes)
                            own = bins[use][:, places[m]]
                            sums = histogram(own, _reached(growing[m], own, first), (margins[:, live.index(m)] - labels)[use], first, wide,
                                             drawn_columns(config, turn))
                            held[m] = held[m] + sums if m in held else sums
                for m, sums in held.items():
                    used = np.flatnonzero(sums[1].ravel())
                    yield pd.DataFrame({"model": m, "at": used, "g": sums[0].ravel()[used], "h": sums[1].ravel()[used]})

            added = state.mapInPandas(count, "model int, at long, g double, h double").groupBy("model", "at").agg(
                F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()  # open nodes x columns x bins of every model
            for m in deep:
                columns = drawn_columns(models[m][0], turn)
                sums = np.zeros((2, wide * len(columns) * BINS))
                part = added[added["model"] == m]
                sums[:, part["at"].to_numpy()] = part[["g", "h"]].to_numpy().T
                settle(trees[m], first, columns, models[m][0], sums.reshape(2, wide, len(columns), BINS), level < models[m][0].depth)
            sent.destroy()
        for m in active:
            done[m].append(trees[m])
            recent[m].append(trees[m])
        if (turn + 1) % KEPT_ROUNDS == 0:
            kept = spark.sparkContext.broadcast(recent)

            def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    yield batch.assign(margins=[advanced(row, _unpacked(row, width, masks)[0], kept.value).tobytes() for _, row in batch.iterrows()])

            state = written(state.mapInPandas(move, f"{BLOCK}, margins binary"))
            recent = {m: [] for m in live}
    return written(spark.createDataFrame([r for m in live for r in _tree_rows(m, bases[m], done[m])], TREES))


def validation_errors(table: DataFrame, width: int, models: Sequence[tuple[Boost, int]], held: Sequence[int], masks: int,
                      columns: Sequence[str], trees: DataFrame) -> DataFrame:
    """Moments of the errors of every model on the rows of its validation mask: model, n, sums of |e|, e and e², and of the labels."""
    spark = table.sparkSession
    places = [np.array([columns.index(c) for c in config.columns]) for config, _ in models]
    ensembles: dict[int, tuple[float, list[Tree]]] = {}
    for r in trees.orderBy("model", "round").toLocalIterator():
        ensembles.setdefault(r.model, (r.base, []))[1].append(Tree(np.array(r.feature), np.array(r.cut), np.array(r.value)))
    sent = spark.sparkContext.broadcast(ensembles)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                bins, labels, _, member = _unpacked(row, width, masks)
                for m, (base, own) in sent.value.items():
                    use = member[:, held[m]]
                    if use.any():
                        x, predicted = bins[use][:, places[m]], np.full(int(use.sum()), base)
                        for tree in own:
                            predicted += tree.value[tree.leaf(x, models[m][0].depth)]
                        yield pd.DataFrame({"model": m, "actual": labels[use], "predicted": predicted})

    return table.mapInPandas(score, "model int, actual double, predicted double")


def tune_boosted(df: DataFrame, configs: Sequence[Boost], years: Sequence[int], holdout: str, *, key: Sequence[str] = ("series_id", "ts"),
                 label: str = "label", target_ts: str = "target_ts", local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Scored validation rows of every configuration on every expanding fold: the configuration's names, fold, actual, predicted.

    Bins come from the rows before the holdout; a row's bin does not depend on
    its label.
    """
    columns = list(dict.fromkeys(c for x in configs for c in x.columns))
    before = written(df.filter(F.col(target_ts) < F.lit(holdout).cast("timestamp")).select(
        *dict.fromkeys([*key, *columns, label]), F.year(target_ts).alias("__year")))
    masks = {f"train_{y}": F.col("__year") < y for y in years} | {f"held_{y}": F.col("__year") == y for y in years}
    rows = before.withColumns(masks)
    table = blocks(rows, columns, thresholds(before, columns), label, list(masks), key)
    models = [(c, n) for c in configs for n in range(len(years))]
    trees = train(table, len(columns), models, len(masks), columns, local_rows)
    held = [len(years) + mask for _, mask in models]
    scored = validation_errors(table, len(columns), models, held, len(masks), columns, trees)
    names = df.sparkSession.createDataFrame(
        [(m, c.model_name, c.simplicity_rank, c.params, c.feature_group, len(c.columns), str(years[n])) for m, (c, n) in enumerate(models)],
        "model int, model_name string, simplicity_rank int, selected_hyperparameters string, feature_group string, feature_count int, validation_period string")
    return scored.join(F.broadcast(names), "model").drop("model")
