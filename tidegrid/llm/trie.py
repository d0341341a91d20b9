"""Trie of conversation prefixes by splitters and a skeleton.

A conversation is a path: the 16-byte digests of its turns, one after another,
so paths sort as the trie is walked and a node is a prefix of a path. Splitters
from a sample of the paths cut this order into shards; they travel to every
task. A node that is no prefix of a splitter has all its members in one shard,
and the task that walks the sorted shard finishes it. The prefixes of the
splitters are the skeleton: each shard gives partial aggregates for those that
it meets, which are reduced by node and summed up along the splitter paths.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import join_small, word_count
from tidegrid.session import written

WIDTH = 16
#: Turns per shard, on average, and sampled paths per shard.
SHARD_TURNS, SAMPLED = 20_000, 8
#: Bytes of sampled paths that the driver takes; a longer order gets longer shards instead, which are streamed.
SAMPLE_BYTES = 64_000_000
#: Bytes of a list of conversations that leaves a task as one row.
CHUNK_BYTES = 65_536


def conversation_paths(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, path and words (per turn) of every rebuilt conversation.

    Conversation c takes the first h turns of conversation c - c % every, with
    h = crc32(c) % heads, before its own turns after the first h. Turns stand in
    their order, null first; equal ones by role, then by the digest of role and
    text. Null role and text are empty. Rows without conv_id belong to no
    conversation.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), role.alias("role"), digest.alias("t"), word_count(F.col("text")).cast("int").alias("w")).alias("turn"))
    based = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).repartition("base")
    grouped = based.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    first = grouped.filter("conv_id = base").select("base", F.slice("turns", 1, heads - 1).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    rebuilt = grouped.join(first, "base", "left").withColumn("h", h.cast("int")).withColumn(
        "turns", F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h")), own))
    path = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x.t)), ""))
    return rebuilt.select("conv_id", path.alias("path"), F.transform("turns", lambda x: x.w).alias("words"))


def splitters(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> list[tuple[bytes, int]]:
    """Paths with their conversations that cut the order of paths into shards of about ``shard_turns`` turns.

    Equal paths are told apart by conversation, so copies may be cut as well.
    """
    convs, turns = paths.agg(F.count("*"), F.sum(F.size("words") + 1)).first()
    if not convs:
        return []
    size = turns * (WIDTH + 8) / convs
    wanted = min(SAMPLED * (turns // shard_turns), int(SAMPLE_BYTES / size))
    if wanted < SAMPLED:
        return []
    drawn = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, wanted / convs)))
    sample = sorted((bytes(r.path), r.conv_id) for r in paths.filter(drawn).select("path", "conv_id").collect())
    return sample[SAMPLED // 2 :: SAMPLED]


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their beginning."""
    if a == b:
        return len(a) // WIDTH
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * WIDTH] == b[: middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
EMITTED = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()),
                     *((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string()),
                     ("words", pa.int64()), ("shard", pa.int64()), ("seq", pa.int64()), ("ids", pa.string())])
EMITTED_SQL = ("kind string, key binary, parent_key binary, " + ", ".join(f"{c} long" for c in NODE)
               + ", ends_sha256 string, words long, shard long, seq long, ids string")


class _Node:
    __slots__ = ("least", "convs", "children", "leaves", "saved", "words", "ends", "chain", "parent_key", "held", "seq")

    def __init__(self, words: int, chain=None, parent_key=None):
        self.least, self.convs, self.children, self.leaves, self.saved, self.words = None, 0, 0, 0, 0, words
        self.ends: list[str] | None = []  # conversations that end here and are not yet in a digest or chunk
        self.chain, self.parent_key = chain, parent_key  # of a skeleton node
        self.held: list[tuple] = []  # finished children, waiting for the least member
        self.seq = 0


class _Shard:
    """The walk over one shard: conversations come in order of path and number."""

    def __init__(self, number: int, cuts: list[tuple[bytes, int]], emit):
        self.number, self.emit = number, emit
        self.edges = [cuts[i][0] for i in (number - 1, number) if 0 <= i < len(cuts)]
        self.path, self.digests = b"", {}
        root = hashlib.md5()
        self.stack = [_Node(0, root)]
        spine = root.copy()
        self.row("spine", key=spine.digest(), depth=0)
        lower = cuts[number - 1][0] if number else b""
        for d in range(len(lower) // WIDTH):
            spine.update(lower[d * WIDTH : (d + 1) * WIDTH])
            self.row("spine", key=spine.digest(), depth=d + 1)

    def row(self, kind: str, **values) -> None:
        self.emit(tuple(kind if c == "kind" else self.number if c == "shard" else values.get(c) for c in EMITTED.names))

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        shared = _common(path, self.path) if len(self.stack) > 1 or not path else 0
        while len(self.stack) > shared + 1:
            self.finish()
        if shared < len(path) // WIDTH:
            skeleton = max((_common(path, e) for e in self.edges), default=0)
            for d in range(shared, len(path) // WIDTH):
                chain, above = None, self.stack[-1]
                if d < skeleton:
                    chain = above.chain.copy()
                    chain.update(path[d * WIDTH : (d + 1) * WIDTH])
                self.stack.append(_Node(words[d], chain, above.chain.digest() if above.chain else None))
        self.path = path
        node = self.stack[-1]
        node.convs += 1
        node.least = conv if node.least is None else min(node.least, conv)
        node.ends.append(str(conv))
        if len(node.ends) * 12 >= CHUNK_BYTES:
            self.flush(node)

    def flush(self, node: _Node) -> None:
        """Conversations that end at a skeleton node leave as a chunk, those of another go into its digest."""
        if not node.ends:
            return
        text = ",".join(node.ends)
        if node.chain:
            self.row("ends", key=node.chain.digest(), seq=node.seq, ids=text)
        else:
            digest = self.digests.setdefault(id(node), hashlib.sha256())
            digest.update((("," if node.seq else "") + text).encode())
        node.seq += 1
        node.ends = []

    def finish(self) -> None:
        node = self.stack.pop()
        depth, above = len(self.stack), self.stack[-1] if self.stack else None
        self.flush(node)
        if above:
            above.convs += node.convs
            above.least = node.least if above.least is None else min(above.least, node.least)
        if node.chain:
            self.row("partial", key=node.chain.digest(), parent_key=node.parent_key, conv_id=node.least, depth=depth,
                     n_convs=node.convs, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, words=node.words)
            return
        for values in node.held:
            self.row("node", parent_conv_id=node.least, **values)
        leaves, saved = node.leaves or 1, node.saved + (node.convs - 1) * node.words
        above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
        digest = self.digests.pop(id(node), None) or hashlib.sha256()
        values = {"conv_id": node.least, "depth": depth, "n_convs": node.convs, "n_children": node.children, "n_leaves": leaves,
                  "saved_tokens": saved, "ends_sha256": digest.hexdigest()}
        if above.chain:
            self.row("node", parent_key=node.parent_key, **values)
        else:
            above.held.append(values)

    def close(self) -> None:
        while self.stack:
            self.finish()


def _walk(rows: Iterator[pa.RecordBatch], cuts: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    shard = None

    def batch() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), EMITTED, strict=True)], schema=EMITTED)
        out.clear()
        return done

    for some in rows:
        for number, conv, path, words in zip(*(some.column(c).to_pylist() for c in ("shard", "conv_id", "path", "words")), strict=True):
            if shard is None or shard.number != number:
                if shard:
                    shard.close()
                shard = _Shard(number, cuts, out.append)
            shard.add(conv, path, words)
            if len(out) >= 20_000:
                yield batch()
    if shard:
        shard.close()
    if out:
        yield batch()


def _digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of every node, which come in order."""
    key, digest = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])
    for some in rows:
        for k, ids in zip(some.column("key").to_pylist(), some.column("ids").to_pylist(), strict=True):
            if k != key:
                if digest:
                    yield done()
                key, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if digest:
        yield done()


def _skeleton(emitted: DataFrame) -> DataFrame:
    """The finished skeleton nodes with their keys."""
    nodes = written(emitted.filter("kind = 'partial'").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.max("words").alias("words"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]))
    inner = nodes.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("inner"))
    own = nodes.join(inner, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0)))
    own = own.withColumns({"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"),
                           "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")})
    # A node on several splitter paths counts on the first; sums from the ends of the paths upwards add up by node.
    spine = emitted.filter("kind = 'spine'").select("shard", "key", "depth").withColumn(
        "first", F.row_number().over(Window.partitionBy("key").orderBy("shard")) == 1)
    onward = Window.partitionBy("shard").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    along = spine.join(own.select("key", "n_leaves", "saved_tokens"), "key")
    sums = along.select("key", *[F.sum(F.when(F.col("first"), F.col(c)).otherwise(0)).over(onward).alias(c) for c in ("n_leaves", "saved_tokens")])
    sums = sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")])
    chunks = emitted.filter("kind = 'ends'").select("key", "shard", "seq", "ids").repartition("key").sortWithinPartitions("key", "shard", "seq")
    ends = chunks.mapInArrow(_digests, "key binary, ends_sha256 string")
    above = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return own.drop("n_leaves", "saved_tokens", "inner").join(sums, "key").join(ends, "key", "left").join(above, "parent_key", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def prefix_trie(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv_id, path, words): distinct beginnings, from the root.

    conv_id is the smallest member; n_leaves and saved_tokens are sums over the
    node's subtree; ends_sha256 digests the members that end at the node. A
    conversation without turns is a member of the root only; an empty table
    gives no node. conv_id must be unique and not null. A conversation is one
    row, 20 bytes a turn. Copies of one conversation may fill many shards; only
    the digest of their numbers is read in order by one task, in chunks.
    """
    spark: SparkSession = paths.sparkSession
    paths = written(paths)
    cuts = spark.sparkContext.broadcast(splitters(paths, shard_turns))

    def route(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows:
            places = zip(some.column("path").to_pylist(), some.column("conv_id").to_pylist(), strict=True)
            shard = pa.array([bisect_right(cuts.value, p) for p in places], pa.int64())
            yield pa.RecordBatch.from_arrays([shard, *some.columns], names=["shard", *some.schema.names])

    routed = paths.mapInArrow(route, "shard long, conv_id long, path binary, words array<int>")
    ordered = routed.repartition("shard").sortWithinPartitions("shard", "path", "conv_id")
    emitted = written(ordered.mapInArrow(lambda rows: _walk(rows, cuts.value), EMITTED_SQL))
    skeleton = written(_skeleton(emitted))
    names = [*NODE, "ends_sha256"]
    above = skeleton.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("__above"))
    local = join_small(emitted.filter("kind = 'node'"), above, ["parent_key"], "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "__above"))
    return local.select(names).unionByName(skeleton.select(names))
