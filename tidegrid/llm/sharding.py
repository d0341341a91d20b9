"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` from a hash of the level, the child and the key, and the
smallest draw wins, so children receive rows in proportion to their weights.
Raising one child's weight only pulls rows into that child: what moves stays
within the subtrees whose weights changed, and below the others nothing moves.
A shard that is added as a region of its own takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import cells, unit
from tidegrid.session import written

#: Shards of a rack and racks of a region in the standard tree.
RACK, REGION = 4, 3


def standard_tree(shards: int, base: int | None = None) -> list[list[list[float]]]:
    """Weights by region, rack and shard for ``shards`` shards of weight 1.

    The first ``base`` shards (default: all) fill racks of 4 and regions of 3
    racks; each further one is a region of its own.
    """
    base = shards if base is None else min(base, shards)
    racks = [[1.0] * min(RACK, base - i) for i in range(0, base, RACK)]
    regions = [racks[i : i + REGION] for i in range(0, len(racks), REGION)]
    return regions + [[[1.0]] for _ in range(shards - base)]


def _draw(level: str, parent: Column, weights: list[list[float]], key: Column) -> Column:
    """The winning child of ``parent`` (an index into ``weights``)."""
    width = max(len(w) for w in weights)
    flat = F.array(*[F.lit(float(w[i]) if i < len(w) else 0.0) for w in weights for i in range(width)])
    offers = []
    for child in range(width):
        weight = F.get(flat, (parent * width + child).cast("int"))
        score = -F.log(unit(F.lit(level), parent.cast("long"), F.lit(child), key)) / weight
        offers.append(F.when(weight > 0, F.struct(score.alias("score"), F.lit(child).alias("child"))))
    return F.array_min(F.array(*offers)).getField("child")


def shard_of(df: DataFrame, key: str, tree: list[list[list[float]]], into: str) -> DataFrame:
    """Add the shard (numbered through the tree in order) that ``key`` descends to.

    A null key is a key like any other. Helper columns are dropped; names that
    begin with ``__`` are reserved.
    """
    racks = [rack for region in tree for rack in region]
    before = [sum(len(r) for r in tree[:i]) for i in range(len(tree))]
    first = [sum(len(r) for r in racks[:i]) for i in range(len(racks))]
    total = [[sum(map(sum, region)) for region in tree]]
    within = [[sum(rack) for rack in region] for region in tree]
    out = df.withColumn("__region", _draw("region", F.lit(0), total, F.col(key)))
    out = out.withColumn("__rack", F.get(F.array(*map(F.lit, before)), F.col("__region"))
                         + _draw("rack", F.col("__region"), within, F.col(key)))
    out = out.withColumn(into, (F.get(F.array(*map(F.lit, first)), F.col("__rack"))
                                + _draw("shard", F.col("__rack"), racks, F.col(key))).cast("int"))
    return out.drop("__region", "__rack")


def with_slots(df: DataFrame, group: str, order: list[str], into: str, groups: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    A group is cut into cells by a hash of the order columns; a cell's first
    number is the sum of the counts before it, so no task sees a whole group.
    ``df`` is read twice and should be a written table. Equal rows get
    consecutive numbers in any order.
    """
    n = cells(df.count(), groups)
    celled = df.withColumn("__cell", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = celled.groupBy(group, "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    rank = F.row_number().over(Window.partitionBy(group, "__cell").orderBy(*order)) - 1
    return (celled.withColumn("__rank", rank).join(starts, [group, "__cell"])
            .withColumn(into, (F.col("__first") + F.col("__rank")).cast("long"))
            .drop("__cell", "__first", "__rank"))


def assign_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the shard after one more is added.

    Null text has size 8 and the checksum of no bytes; null ids share a shard;
    repeated rows are rows of their own; an empty table gives none. Other
    columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    rows = shard_of(rows, "doc_id", standard_tree(shards), "shard")
    rows = shard_of(rows, "doc_id", standard_tree(shards + 1, shards), "grown_shard")
    return with_slots(written(rows), "shard", ["doc_id", "text_crc32", "size"], "slot", shards)


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Write every column of ``docs`` as Parquet, one folder per shard, a few files each."""
    placed = shard_of(docs, "doc_id", standard_tree(shards), "shard")
    placed.repartition("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(16))).write.partitionBy("shard").parquet(path)
