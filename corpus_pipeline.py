"""The corpus pipeline: every stage takes the documents that the one before it kept.

A stage is given (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's documents. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import join_small, table
from tidegrid.llm.decontamination import contaminated
from tidegrid.llm.jaccard import dropped_copies, near_duplicates
from tidegrid.llm.mixing import mix_counts, whole_copies
from tidegrid.llm.rules import judge
from tidegrid.llm.token_store import stored_tokens
from tidegrid.session import scratch_scope, written


def _boxed(docs: DataFrame) -> DataFrame:
    """The documents' columns as one, so that no name can clash, and what the joins need."""
    return docs.select(F.struct("*").alias("__doc"), F.coalesce("doc_id", F.lit(0)).alias("__id"),
                       F.col("doc_id").isNull().alias("__null"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, by themselves and by their host.

    Null and empty texts have no words and go; a null source is the host of
    empty name; null and repeated ids and equal rows are rows of their own; an
    empty table gives none; texts of any length are measured whole.
    """
    rows = docs.select(F.struct("*").alias("__doc"), "doc_id", "text", "source")
    return judge(rows, keep_columns=["__doc"]).filter("kept").select("__doc.*")


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; equal rows count as copies.

    Texts without words are copies of nothing and all stay; a row without an id
    stays only if its group has none with one; ties go to the smallest hash of
    the text; an empty table gives none.
    """
    with scratch_scope():
        gone = written(dropped_copies(near_duplicates(docs)[0]), keep=True)
    gone = gone.select(
        F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__null"), "h", "spare")
    keys = ["__id", "__null", "h"]
    rows = _boxed(docs).withColumn("h", F.xxhash64("__doc.text"))
    kept = join_small(rows, gone, keys, "left_anti").select("__doc.*")
    spare = gone.filter("spare")
    if spare.limit(1).count():  # one of several equal rows
        kept = kept.union(join_small(rows, spare.drop("spare"), keys).dropDuplicates(keys).select("__doc.*"))
    return kept


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is like a benchmark item; rows with one id (or none) are told apart by their text.

    Null, empty and short texts hold no window and stay; equal rows go or stay
    together; an empty table, or an empty benchmark, removes nothing.
    """
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    with scratch_scope():
        found = contaminated(rows, table(spark, sf_dir, "benchmark")).select(
            F.coalesce("doc_id.doc_id", F.lit(0)).alias("__id"), F.col("doc_id.doc_id").isNull().alias("__null"), "doc_id.h").distinct()
        hits = written(found, keep=True)
    boxed = _boxed(docs).withColumn("h", F.xxhash64("__doc.text"))
    return join_small(boxed, hits, ["__id", "__null", "h"], "left_anti").select("__doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, as whole rows; the words of a source miss those taken by less than its largest document.

    Null, empty and wordless texts are not taken; a null source is a source;
    equal rows share their copies as evenly as they go; an empty table gives
    none; columns pass unread, whatever their names.
    """
    with scratch_scope():
        times = written(whole_copies(mix_counts(docs)).filter("times > 0"), keep=True)
    times = times.withColumnsRenamed({"times": "__times", "rows": "__rows"})
    rows = docs.select(F.struct("*").alias("__doc"), F.xxhash64("doc_id", "text").alias("h"))
    met = join_small(rows, times, ["h"])
    copies = met.filter("__rows = 1").select("__doc", "__times")
    if times.filter("__rows > 1").limit(1).count():
        place = F.row_number().over(Window.partitionBy("h").orderBy("__rows"))
        share = F.floor(F.col("__times") / F.col("__rows")) + (place <= F.pmod("__times", F.col("__rows"))).cast("int")
        copies = copies.union(met.filter("__rows > 1").select("__doc", share.cast("int").alias("__times")).filter("__times > 0"))
    return copies.select("__doc", F.explode(F.sequence(F.lit(1), "__times"))).select("__doc.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and where each document stands in them.

    A null or empty text is its end id alone; equal rows are written one after
    another, a null id first; an empty table gives none.
    """
    return stored_tokens(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicate_join", near_duplicate_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: SQL has no tokenizer and no such hashes; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch_scope():
            docs = written(stage(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
