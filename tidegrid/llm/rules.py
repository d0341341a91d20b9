"""Quality rules: per document, and for the host that it comes from.

Every document is measured in its own row. Rule failures are then counted by
host, each rate is shrunk towards the rates of all hosts by a beta prior
fitted to them by moments, and the verdicts on hosts are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import WORD, join_small
from tidegrid.session import written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = r"[#*$%&|<>]"
BLANKS = r"[^\x20\x09-\x0D]"


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the five measures; text columns and all others stay.

    ``n_repeat_words``: the starts of 3-word windows whose hash occurs again in
    the text, found by one sort; each covers the words up to the next start, 3
    at most.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("__words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"))
    out = out.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(BLANKS)))
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    out = out.withColumn("__windows", F.when(F.size("__words") >= 3, F.slice(F.transform(
        "__words", lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2))),
        1, F.greatest(F.size("__words") - 2, F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("__sorted", F.when(
        F.size(F.array_distinct("__windows")) < F.size("__windows"),
        F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, i, d: F.coalesce(F.get("__sorted", i + d).getField("h") == x.getField("h"), F.lit(False))
    out = out.withColumn("__starts", F.array_sort(F.transform(F.filter(
        "__sorted", lambda x, i: same(x, i, 1) | (same(x, i, -1) & (i > 0))), lambda x: x.getField("i"))))
    cover = F.transform("__starts", lambda s, i: F.least(F.lit(3), F.coalesce(F.get("__starts", i + 1) - s, F.lit(3))))
    out = out.withColumn("n_repeat_words", F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x))
    return out.drop("__words", "__lines", "__windows", "__sorted", "__starts")


def rule_columns(min_words: int = 50, repeat_pct: int = 50, symbol_pct: int = 20, dup_lines: int = 20) -> dict:
    """The rules: name and failure. The first is the base rule, which rejects a document by itself."""
    return {
        "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_pct * F.col("n_words")),
        "symbols_failed": 100 * F.col("n_symbols") > symbol_pct * F.col("word_chars"),
        "lines_failed": F.col("n_dup_lines") > dup_lines,
    }


def host_verdicts(rows: DataFrame, rules: list[str], max_rate: float = 0.5) -> DataFrame:
    """host and ``host_ok``: false if a rule's shrunk failure rate is above ``max_rate``.

    For each rule, mean m and variance v of the host rates give the prior's
    strength m (1 - m) / v - 1 (at least 10 documents; rates that don't differ, or one
    host alone, give 10**6, that is the common rate). A host's rate is then
    (failures + m strength) / (documents + strength).
    """
    counts = rows.groupBy("host").agg(F.count("*").alias("n"), *[
        F.sum(F.col(r).cast("long")).alias(r) for r in rules])
    counts = written(counts)
    moments = counts.agg(*[f(F.col(r) / F.col("n")).alias(f"{r}_{k}") for r in rules
                           for k, f in (("m", F.avg), ("v", F.var_pop))]).first()
    ok = F.lit(True)
    for rule in rules:
        mean, var = moments[f"{rule}_m"] or 0.0, moments[f"{rule}_v"] or 0.0
        strength = max(10.0, mean * (1 - mean) / var - 1) if var > 1e-12 else 1e6
        ok = ok & ((F.col(rule) + mean * strength) / (F.col("n") + strength) <= max_rate)
    return counts.select("host", ok.alias("host_ok"))


def judge(docs: DataFrame, host: str = "source", max_rate: float = 0.5,
          keep_columns: list[str] | None = None) -> DataFrame:
    """Measures, base_failed and kept for every document.

    Null text has no words and fails; a null host is a host of its own (the
    empty name); repeated rows are judged alike; an empty table gives none.
    ``keep_columns`` are returned instead of doc_id; their names must not be
    those of a result.
    """
    rules = rule_columns()
    own = keep_columns or ["doc_id"]
    rows = measured(docs.select(*own, F.col("text"), F.coalesce(F.col(host), F.lit("")).alias("host")))
    for name, failed in rules.items():
        rows = rows.withColumn(name, failed)
    rows = written(rows.select(*own, "host", *MEASURES, *rules))
    verdicts = host_verdicts(rows.select("host", *rules), list(rules), max_rate)
    return join_small(rows, written(verdicts), ["host"]).withColumn(
        "kept", ~F.col("base_failed") & F.col("host_ok")).drop("host")
