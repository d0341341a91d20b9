"""The operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.chat import calls_of, link_calls, other_turns
from tidegrid.llm.common import table
from tidegrid.llm.decontamination import contaminated
from tidegrid.llm.jaccard import near_duplicates
from tidegrid.llm.mixing import mix_counts
from tidegrid.llm.registry import query
from tidegrid.llm.rules import judge
from tidegrid.llm.runs import periodic_runs
from tidegrid.llm.scoring import backoff_scores
from tidegrid.llm.secrets import find_secrets
from tidegrid.llm.sharding import assign_shards
from tidegrid.llm.sql import DECONTAMINATION, JACCARD, RULES, RUNS, SUBSTRINGS, TRIE, URLS
from tidegrid.llm.substrings import remove_repeats
from tidegrid.llm.token_store import stored_tokens
from tidegrid.llm.trie import conversation_paths, prefix_trie
from tidegrid.llm.urls import judge_urls, rules_table


@query("op1_secrets")
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")


@query("op2_jaccard_join", JACCARD)
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


@query("jaccard_link_counts")
def jaccard_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = near_duplicates(table(spark, sf_dir, "documents"), count_links=True)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


@query("op3_substring_dedup", SUBSTRINGS)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard_words")


@query("op5_quality_rules", RULES)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_decontamination", DECONTAMINATION)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_tool_calls")
def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return link_calls(*calls_of(conversations)).unionByName(other_turns(conversations))


@query("op8_token_store")
def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tokens(table(spark, sf_dir, "documents"))


@query("op9_hash_tree")
def op9_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op10_lm_scores")
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs", RUNS)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), rewrite=True).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@query("op12_prefix_trie", TRIE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(conversation_paths(table(spark, sf_dir, "conversations")))


@query("op13_url_filters", URLS)
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_table(spark))
