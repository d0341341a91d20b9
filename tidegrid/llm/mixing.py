"""Mixing sources to target weights.

The words of a source, its documents one after another, are packed into blocks
of a fixed number of words. Every source gets as many slots as its target has
blocks; each slot draws its output shard by hash, so the source counts of the
shards are multinomial with the source totals held. Slot ``k`` of a source is
mapped through a pseudorandom permutation of the source's block numbers, one
for each pass over them, and the blocks are joined by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import WORD, cells, join_small, word_count
from tidegrid.session import written

#: Primes just below 10**12; coprime to every smaller number of blocks.
PRIMES = (999999999989, 999999999961, 999999999959)
#: Slots that one row of the slot table expands to at most.
RUN = 16_384


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5,
            cap: float = 2.0) -> DataFrame:
    """Add ``sid``, ``weight`` and ``target`` to a table of source and source_size.

    Sources are numbered by code point, null last, and take the weights in
    turn. They share ``share`` times all words by weight; a target stops at
    ``cap`` times its source, and the excess is shared again until none is
    above. Only one row of sums per round comes to the driver. The sources are
    numbered in ranges of the order with offsets, so there may be as many as
    documents.
    """
    parts = cells(sizes.count(), least=1)
    dealt = written(sizes.withColumn("__null", F.col("source").isNull()).repartitionByRange(parts, "__null", "source").withColumn(
        "__part", F.spark_partition_id()))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = dealt.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    order = Window.partitionBy("__part").orderBy("__null", "source")
    sizes = dealt.withColumn("__at", F.row_number().over(order) - 1).join(F.broadcast(before), "__part")
    sid = F.col("__at") + F.col("__before")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = written(sizes.select("source", "source_size", sid.alias("sid")).withColumn(
        "weight", F.get(turn, F.pmod(F.col("sid"), F.lit(len(weights))))))
    limit = F.col("source_size") * F.lit(cap)
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        # of the sources that the present level lifts to their limit, and of the rest
        full = (limit <= F.lit(level) * F.col("weight")) if capped >= 0 else F.lit(False)
        held, free, count = rows.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.coalesce(F.sum(full.cast("int")), F.lit(0))).first()
        if count == capped or not free:
            break
        level, capped = (share * total - held) / free, count
    return rows.withColumn("target", F.least(limit, F.lit(float(level)) * F.col("weight")))


def permuted(k: Column, size: Column, *salt: Column) -> Column:
    """The ``k``-th element of a pseudorandom permutation of 0 .. size - 1.

    Two multiplications by primes above ``size`` with hashed shifts, in exact
    decimals, since the products pass 64 bits.
    """
    out, size = k.cast("decimal(18,0)"), size.cast("decimal(18,0)")
    for i, prime in enumerate(PRIMES):
        shift = F.pmod(F.xxhash64(F.lit(i), *salt), F.lit(10**12)).cast("decimal(18,0)")
        out = ((out * F.lit(prime).cast("decimal(18,0)") + shift) % size).cast("decimal(18,0)")
    return out.cast("long")


def _streams(docs: DataFrame, weights, share, cap, block, words: bool) -> tuple[DataFrame, DataFrame]:
    """The documents with their place in their source's words, and the sources."""
    sized = written(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.xxhash64("doc_id", "text").alias("h"), *([F.col("text")] if words else [])))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(targets(sizes, weights, share, cap).withColumn(
        "blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long")).withColumn(
        "slots", F.when(F.col("source_size") > 0, F.round(
            F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")))
    known = sources.select(F.coalesce("source", F.lit("")).alias("__s"), F.col("source").isNull().alias("__null"),
                           "sid", "source_size", "target")
    rows = join_small(sized.withColumn("__s", F.coalesce("source", F.lit(""))).withColumn(
        "__null", F.col("source").isNull()), known, ["__s", "__null"]).drop("__s", "__null")
    n = cells(sized.count())
    rows = rows.withColumn("cell", F.pmod(F.col("h"), F.lit(n)).cast("int"))
    sums = rows.groupBy("sid", "cell").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("sid").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("sid", "cell", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("sid", "cell").orderBy("h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(firsts.hint("merge"), ["sid", "cell"])
              .withColumn("start", F.col("__first") + F.col("__inside")).drop("__first", "__inside", "cell"))
    return placed, sources


def _slots(sources: DataFrame, shards: int) -> DataFrame:
    """sid, k, shard and block of every slot; long sources are expanded by many rows, in as many tasks."""
    total = sources.agg(F.sum("slots")).first()[0] or 0
    tasks = max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RUN))
    runs = sources.filter("slots > 0").select(
        "sid", "slots", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / RUN))).alias("run"))
    runs = runs.repartition(tasks, "sid", "run")  # a number that is asked for is not joined again to fewer
    slots = runs.select("sid", "blocks", F.explode(F.sequence(
        F.col("run") * RUN, F.least(F.col("slots"), (F.col("run") + 1) * RUN) - 1)).alias("k"))
    turn = F.floor(F.col("k") / F.col("blocks"))
    return slots.select("sid", "k", F.pmod(F.xxhash64(F.lit("shard"), "sid", "k"), F.lit(shards)).alias("shard"),
                        permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.col("sid"), turn).alias("block"))


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document has words in, with its range of the document's words."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block") * block, F.col("start"))
    end = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    return cut.withColumn("from", (begin - F.col("start")).cast("int")).withColumn("words", (end - begin).cast("int"))


def mix_counts(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5,
               cap: float = 2.0, block: int = 64, shards: int = 64) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of each document, in all and by shard.

    ``taken`` is the sum over the slots of all shards, ``shard_words`` has a
    (shard, words) entry for each shard that the draw gives words of it to.

    Null text has no words; a null source is a source; repeated rows are rows of
    their own; an empty table gives none. No block is used more than ``cap``
    times (a whole number), so no document is either. Other columns are not
    read. The drawing depends on ids, texts and sources only.
    """
    placed, sources = _streams(docs, weights, share, cap, block, False)
    placed = written(placed)
    # as large as the mix: never broadcast, however small its packed form looks
    used = _slots(sources, shards).groupBy("sid", "block", "shard").agg(F.count("*").alias("times")).hint("merge")
    drawn = (_pieces(placed, block).select("sid", "block", "row", "words").join(used, ["sid", "block"])
             .groupBy("row", "shard").agg(F.sum(F.col("words") * F.col("times")).alias("words")))
    taken = drawn.groupBy("row").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct(
        F.col("shard").cast("int").alias("shard"), F.col("words").cast("long").alias("words")))).alias("shard_words")).hint("merge")
    none = F.array().cast("array<struct<shard:int,words:bigint>>")
    return placed.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("shard_words", none).alias("shard_words"), "source", "sid", "h")


def whole_copies(counts: DataFrame) -> DataFrame:
    """h and times: how often each text of ``mix_counts`` is taken as a whole, and rows (with that h).

    Within a source, documents stand by size, largest first, and the fractions
    of copies are added up; a document gets one more copy where the sum passes
    a whole number. The copies before any document then differ from the
    fractions by less than one, so the words of a source differ from the words
    that the mix takes of it by less than its largest document. Documents
    without words are not taken. Equal rows share their copies.
    """
    unit_ = 1 << 30
    rows = counts.filter("size > 0").select("sid", "size", "h", F.floor(F.col("taken") / F.col("size")).alias("whole"), F.floor(
        F.pmod(F.col("taken"), F.col("size")) / F.col("size") * unit_).cast("long").alias("part"))
    order = [F.col("sid"), F.desc("size"), F.col("h")]
    dealt = written(rows.repartitionByRange(cells(rows.count(), least=1), *order).withColumn("cell", F.spark_partition_id()))
    sums = dealt.groupBy("sid", "cell").agg(F.sum("part").alias("__sum"))
    earlier = Window.partitionBy("sid").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("sid", "cell", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__first"))
    line = Window.partitionBy("sid", "cell").orderBy(F.desc("size"), "h").rowsBetween(Window.unboundedPreceding, 0)
    upto = dealt.withColumn("__upto", F.sum("part").over(line)).join(firsts.hint("merge"), ["sid", "cell"]).withColumn(
        "__upto", F.col("__upto") + F.col("__first") + F.pmod(F.xxhash64(F.lit("copies"), "sid"), F.lit(unit_)))
    more = F.floor(F.col("__upto") / unit_) - F.floor((F.col("__upto") - F.col("part")) / unit_)
    return upto.groupBy("h").agg(F.sum(F.col("whole") + more).cast("int").alias("times"), F.count("*").cast("int").alias("rows"))


def mix_texts(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5,
              cap: float = 2.0, block: int = 64, shards: int = 64) -> DataFrame:
    """The mixed words: shard, sid, k, part, doc_id and text of every slot's pieces.

    A block that spans documents comes as several parts, in order.
    """
    placed, sources = _streams(docs, weights, share, cap, block, True)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    pieces = _pieces(placed, block).select(
        "sid", "block", F.col("start").alias("part"), "doc_id",
        F.array_join(F.slice(words, F.col("from") + 1, F.col("words")), " ").alias("text"))
    return _slots(sources, shards).join(pieces, ["sid", "block"]).select("shard", "sid", "k", "part", "doc_id", "text")

