"""Benchmark decontamination by SimHash over item-sized windows.

An item is its bag of 5-word shingles in lower case. A document is read in
windows of the item's number of words. A window has a SimHash of 128 bits, the
sign per bit of its weighted shingle hashes. Fingerprints are cut into ten
blocks; of ``radius`` differing bits some block holds at most ``radius // 10``,
so every item is indexed under all block values that close to its own, and a
window that looks up its ten blocks meets every item of its size within the
radius. A document with such a window is a candidate for the item, and all its
windows of that size are verified by weighted Jaccard similarity of the bags.

Two kinds of windows need no fingerprint. Without any shingle of an item of its
size a window has similarity 0. And moving a window to its first such shingle
only adds shared ones, so windows start at shingles of items.

At similarity 0.75 two windows differ in 22 of 128 bits on average, with a
deviation of 4.3, two unrelated ones in 64. Within radius 29 an index key is
shared by one in eight of unrelated pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import WORD, join_small
from tidegrid.session import written

SHINGLE, SIMILARITY, RADIUS = 5, 0.75, 29
#: Longs of a fingerprint, and blocks that each is cut into.
LONGS, BLOCKS = 2, 5
#: Shingles of items that are held by every executor at a time; a larger benchmark takes several passes.
PASS_SHINGLES = 500_000


def shingle_hashes(text: Column) -> tuple[Column, Column]:
    """The words of a text in lower case, and (over them as column ``__words``) their shingle hashes."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    hashes = F.slice(F.transform("__words", lambda w, i: F.xxhash64(w, *[
        F.get("__words", i + d) for d in range(1, SHINGLE)])), 1, F.greatest(F.size("__words") - (SHINGLE - 1), F.lit(0)))
    return words, hashes


def _numbered(bag: Column) -> Column:
    """A bag as a set: the second, third ... equal element gets a hash of its own."""
    again = lambda h, i: F.size(F.filter(F.slice(bag, 1, i), lambda x: x == h))
    return F.when(F.size(F.array_distinct(bag)) == F.size(bag), bag).otherwise(F.transform(
        bag, lambda h, i: F.when(again(h, i) > 0, F.xxhash64(h, again(h, i))).otherwise(h)))


def _shifted(x: Column, by: Column, ones: int) -> Column:
    return F.call_function("shiftrightunsigned", x, by.cast("int")).bitwiseAND(F.lit(ones).cast("long"))


def simhash(df: DataFrame, bag: str, into: str, lane: int) -> DataFrame:
    """Add the SimHash of an array of hashes, a shingle weighing as often as it occurs.

    The bits are counted side by side in lanes of ``lane`` bits of a long, so
    bags must be smaller than 2**(lane - 1). A null bag has no fingerprint.
    """
    ones = sum(1 << (lane * j) for j in range(64 // lane))
    lanes = F.transform(F.sequence(F.lit(0), F.lit(lane - 1)), lambda k: F.aggregate(
        bag, F.lit(0).cast("long"), lambda acc, h: acc + _shifted(h, k, ones)))
    count = lambda b: _shifted(F.get("__lanes", F.pmod(b, F.lit(lane))), b - F.pmod(b, F.lit(lane)), (1 << lane) - 1)
    sign = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(
        F.call_function("shiftleft", (2 * count(b) > F.size(bag)).cast("long"), b)))
    # named twice, bag and lanes are worked out once a row and not for each bit
    lanes = F.when(F.size(bag) >= 0, lanes)
    return df.withColumn("__lanes", lanes).withColumn(into, F.when(F.size("__lanes") > 0, sign)).drop("__lanes")


def fingerprinted(df: DataFrame, bag: str, into: str, lane: int) -> DataFrame:
    """Add the SimHash of a bag as columns ``into`` 0, 1 ..., each of 64 bits, from hashes of their own."""
    out = simhash(df, bag, f"{into}0", lane)
    for j in range(1, LONGS):
        out = simhash(out.withColumn("__bag", F.transform(bag, lambda h, j=j: F.xxhash64(h, F.lit(j)))), "__bag", f"{into}{j}", lane)
        out = out.drop("__bag")
    return out


def blocks() -> list[tuple[int, int, int]]:
    """Long, offset and mask of the blocks that cover a fingerprint."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return [(j, a, (1 << (b - a)) - 1) for j in range(LONGS) for a, b in zip(edges, edges[1:], strict=False)]


def _keys(n_words: str, into: str, flip: Column | int = 0) -> Column:
    """One number for each block: window size, block and value, with the bits of ``flip`` turned over."""
    flip = F.lit(flip).cast("long") if isinstance(flip, int) else flip
    room = max(mask for _, _, mask in blocks()) + 1
    return F.array(*[
        (F.col(n_words).cast("long") * len(blocks()) + i) * room + _shifted(F.col(f"{into}{j}"), F.lit(offset), mask).bitwiseXOR(flip)
        for i, (j, offset, mask) in enumerate(blocks())])


def _index(items: DataFrame, radius: int) -> DataFrame:
    """key, item (its hash) and fingerprint: every item under all block values that some block of a near fingerprint has."""
    near, wide = radius // len(blocks()), max(mask for _, _, mask in blocks())
    flips = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(wide).cast("long")), lambda x: F.bit_count(x) <= near)
    prints = [f"i{j}" for j in range(LONGS)]
    return items.select("n_words", "item", *prints, F.explode(flips).alias("flip")).select(
        "item", *prints, F.explode(_keys("n_words", "i", F.col("flip"))).alias("key"))


def item_table(bench: DataFrame) -> DataFrame:
    """item_id, n_words and the bag of shingle hashes; items of fewer than five words have none and are left out."""
    words, hashes = shingle_hashes(F.col("text"))
    return (bench.select("item_id", F.lit(0).alias("__x"), words.alias("__words"))
            .select("item_id", F.size("__words").alias("n_words"), hashes.alias("bag")))


def _windows(texts: DataFrame, items: DataFrame) -> DataFrame:
    """dk (a hash of id and text), doc_id, start, n_words and window (the shingle hashes) of every window to fingerprint.

    Words go through the join with nothing but their place. The few documents
    with a hit are then read again, found by a hash of id and text; a wrong
    match there would only add windows.
    """
    anchors = items.select("n_words", F.explode(F.array_distinct("bag")).alias("h")).groupBy("h").agg(
        F.collect_set("n_words").alias("sizes"))
    words, hashes = shingle_hashes(F.col("text"))
    keyed = texts.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("dk"))
    # the outer form adds no filter on the array's size, which Spark would work out from the text once more per word
    places = (keyed.select("dk", words.alias("__words")).select("dk", hashes.alias("hashes"))
              .select("dk", F.posexplode_outer("hashes").alias("start", "h")))
    # one part of the benchmark is bounded by PASS_SHINGLES, which the caller sees to
    near = places.join(F.broadcast(anchors), "h").select("dk", "start", F.explode("sizes").alias("n_words"))
    hits = written(near.groupBy("dk").agg(F.collect_set(F.struct("start", "n_words")).alias("hits")))
    again = join_small(keyed, hits, ["dk"]).select("dk", "doc_id", "hits", words.alias("__words")).select(
        "dk", "doc_id", "hits", hashes.alias("hashes"))
    # named twice, ``hashes`` is worked out once a document and not inside the lambda
    cut = F.transform("hits", lambda x: F.struct(
        x["start"].alias("start"), x["n_words"].alias("n_words"), F.slice("hashes", x["start"] + 1, F.least(
            x["n_words"] - (SHINGLE - 1), F.size("hashes") - x["start"])).alias("window")))
    return again.select("dk", "doc_id", F.explode_outer(cut).alias("w")).select("dk", "doc_id", "w.*")


def _one_pass(texts: DataFrame, items: DataFrame, lane: int, similarity: float, radius: int) -> DataFrame:
    windows = written(fingerprinted(_windows(texts, items), "window", "w", lane))
    named = written(fingerprinted(items.withColumn("item", F.xxhash64("item_id", "bag")), "bag", "i", lane))
    index = written(_index(named, radius))
    prints = [f"w{j}" for j in range(LONGS)]
    # equal windows of a document look up once
    probes = windows.select("dk", "n_words", *prints).distinct().select(
        "dk", "n_words", *prints, F.explode(_keys("n_words", "w")).alias("key"))
    apart = sum(F.bit_count(F.col(f"w{j}").bitwiseXOR(F.col(f"i{j}"))) for j in range(LONGS))
    near = written(join_small(probes, index, ["key"]).filter(apart <= radius).select("dk", "n_words", "item").distinct())
    # one part of the benchmark is bounded by PASS_SHINGLES
    pairs = join_small(windows, near, ["dk", "n_words"]).join(F.broadcast(named.select("item", "item_id", "bag")), "item")
    pairs = written(pairs.select("doc_id", "item_id", "start", _numbered(F.col("window")).alias("a"),
                                 _numbered(F.col("bag")).alias("b")))
    shared = F.size(F.array_intersect("a", "b"))
    pairs = pairs.withColumn("similarity", shared / (F.size("a") + F.size("b") - shared))
    return pairs.filter(F.col("similarity") >= similarity).select("doc_id", "item_id", "start", "similarity")


def contaminated(docs: DataFrame, bench: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, n_windows, similarity (the best) and start (word, the first of the best) of documents with items.

    Null and empty texts and items hold nothing; items of fewer than five words
    are too short to tell and never found; equal items are found each; rows with
    equal ids count together; an empty table gives none; other columns are not
    read. A window at the end of a document may be shorter than the item; texts
    of any length are searched whole, a very long one by one task. A document is
    missed only if each of its windows like the item lies beyond the radius.
    """
    items = written(item_table(bench)).filter(F.size("bag") > 0)
    shingles, longest = items.agg(F.sum(F.size("bag")), F.max(F.size("bag"))).first()
    passes = max(1, -(-(shingles or 0) // PASS_SHINGLES))
    lane = 8 if (longest or 0) < 128 else 16 if (longest or 0) < 1 << 14 else 32
    found = None
    for k in range(passes):
        some = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) if passes > 1 else items
        part = _one_pass(docs, some, lane, similarity, radius)
        found = part if found is None else found.union(part)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start").alias("start")))
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"), best.alias("best")).select(
        "doc_id", "item_id", "n_windows", (-F.col("best.s")).alias("similarity"), F.col("best.start").cast("long").alias("start"))
