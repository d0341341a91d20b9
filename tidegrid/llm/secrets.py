"""Secret scans: known formats, and random strings found by character Markov models.

Two first-order models over the characters of a token, one of random strings
and one of ordinary identifiers, give each transition a log-likelihood ratio.
A token whose transitions add up to more than the threshold is reported. Both
are counted from labelled samples; the table of ratios has one value for each
pair of ASCII characters, whatever the size of the samples.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
#: Fixed formats of the base rules.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: What the models judge.
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
#: Ordinary ones to learn from: letters, then a short number at most, so that random strings don't pass for them.
IDENTIFIER = r"(?<![A-Za-z0-9+/_-])[A-Za-z_-]{5,}[0-9_-]{0,5}(?![A-Za-z0-9+/])"
#: Documents whose words the identifier model is fitted on, and digests for the random one, about.
SAMPLE_DOCS = 20_000
#: Natural-log likelihood ratio that a random string has at least.
THRESHOLD = 12.0
SMOOTHING = 10.0
_ASCII = 128
_SPANS = "array<struct<start:int,stop:int,value:string>>"


def spans(text: Column, pattern: str) -> Column:
    """Start, stop (code points, end exclusive) and value of every match, from the gaps between matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("all"))
    walked = F.aggregate(F.filter(pairs, lambda p: p["hit"].isNotNull()), empty, lambda acc, p: F.struct(
        (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("at"),
        F.concat(acc["all"], F.array(F.struct(
            (acc["at"] + F.length(p["gap"])).alias("start"),
            (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("stop"), p["hit"].alias("value")))).alias("all")))
    return F.when(text.rlike(pattern), walked["all"]).otherwise(F.array().cast(_SPANS))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with __text and one array of spans for each base kind."""
    out = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    text = F.col("__text")
    out = out.withColumn("__assign", F.filter(
        spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 12))
    return out.withColumn("__access", spans(text, ACCESS)).withColumn("__hex", spans(text, HEX))


def samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled strings of the corpus: value and random.

    Random: what the base rules found, and digests of the sampled texts in base
    64, about ``sample_docs`` in all. Ordinary: the identifiers of the sampled
    documents outside base spans. A hash of id and text picks about
    ``sample_docs`` documents.
    """
    n = docs.count()
    share, digests = max(1, n // max(1, sample_docs)), max(1, sample_docs // max(1, n))
    picked = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0)
    rows = base_spans(picked)
    values = lambda c: F.transform(c, lambda s: s["value"])
    secret = F.transform("__assign", lambda s: F.regexp_extract(s["value"], ASSIGN, 2))
    digest = F.transform(F.sequence(F.lit(1), F.lit(digests)), lambda i: F.regexp_replace(F.base64(F.unhex(
        F.sha2(F.concat(F.sha2("__text", 256), i.cast("string")), 256))), "=", ""))
    cleared = F.regexp_replace(F.regexp_replace("__text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    # the outer form adds no filter on the array's size, for which Spark would match the text once more
    random = rows.select(F.explode_outer(F.concat(secret, values("__access"), values("__hex"), digest)).alias("value"))
    plain = rows.select(F.explode_outer(F.regexp_extract_all(cleared, F.lit(IDENTIFIER), F.lit(0))).alias("value"))
    return random.withColumn("random", F.lit(True)).union(plain.withColumn("random", F.lit(False))).filter("value is not null")


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of every transition, at 128 * first + second.

    Equal strings count once. A transition's probability is smoothed with ``SMOOTHING`` times that of its
    second character, and that by one count for each of 66 characters.
    """
    chars = F.split("value", "")
    pairs = (labelled.distinct()
             .select("random", F.explode_outer(F.zip_with(
                 chars, F.slice(chars, 2, F.greatest(F.length("value"), F.lit(1))),
                 lambda a, b: F.struct(F.ascii(a).alias("a"), F.ascii(b).alias("b")))).alias("p"))
             .filter((F.col("p.a") < _ASCII) & (F.col("p.b") < _ASCII)))
    counts = {(r.random, r.a, r.b): r.n for r in pairs.groupBy("random", "p.a", "p.b").agg(F.count("*").alias("n")).collect()}
    first, second, every = Counter(), Counter(), Counter()
    for (label, a, b), n in counts.items():
        first[label, a] += n
        second[label, b] += n
        every[label] += n

    def prob(label: bool, a: int, b: int) -> float:
        alone = (second[label, b] + 1) / (every[label] + 66)
        return (counts.get((label, a, b), 0) + SMOOTHING * alone) / (first[label, a] + SMOOTHING)

    return [math.log(prob(True, a, b) / prob(False, a, b)) for a in range(_ASCII) for b in range(_ASCII)]


def ratio(value: Column, model: list[float]) -> Column:
    """Summed log-likelihood ratio of an ASCII string's transitions."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    codes = F.transform(F.split(value, ""), F.ascii)
    return F.aggregate(
        codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(
            acc["last"] >= 0, F.coalesce(F.get(table, acc["last"] * _ASCII + c), F.lit(0.0))).otherwise(0.0)).alias("sum")),
    )["sum"]


def uncovered(token: Column, base: Column, least: int = 16) -> Column:
    """Start, stop and value of the pieces of a token outside the base spans (in order), of ``least`` characters or more."""
    none = F.array().cast("array<struct<start:int,stop:int>>")
    piece = lambda a, b: F.when(a < b, F.array(F.struct(a.alias("start"), b.alias("stop")))).otherwise(none)
    over = F.filter(base, lambda b: (b["start"] < token["stop"]) & (token["start"] < b["stop"]))
    walked = F.aggregate(over, F.struct(token["start"].alias("at"), none.alias("all")), lambda acc, b: F.struct(
        F.greatest(acc["at"], b["stop"]).alias("at"), F.concat(acc["all"], piece(acc["at"], b["start"])).alias("all")))
    left = F.filter(F.concat(walked["all"], piece(walked["at"], token["stop"])), lambda p: p["stop"] - p["start"] >= least)
    cut = lambda p: F.substr(token["value"], p["start"] - token["start"] + 1, p["stop"] - p["start"])
    return F.transform(left, lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), cut(p).alias("value")))


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Spans of the base kinds and of random strings in every whole text.

    Null text is empty; rows with equal ids are scanned one by one; an empty
    table gives none; other columns are not read. What a base span covers is
    left to it; the pieces of a token beside base spans are judged on their own.
    Positions in a text take time with the square of its number of matches.
    """
    rows = base_spans(docs.select("doc_id", "text"))
    base = F.concat(*[F.transform(f"__{k}", lambda s: F.struct(
        s["start"].alias("start"), F.lit(i).alias("kind"), s["stop"].alias("stop")))
        for i, k in enumerate(KINDS[:3])])
    rows = rows.withColumn("__base", F.array_sort(base)).withColumn("__tokens", spans(F.col("__text"), TOKEN))
    pieces = F.flatten(F.transform("__tokens", lambda t: uncovered(t, F.col("__base"))))
    rows = rows.withColumn("__random", F.filter(pieces, lambda t: ratio(t["value"], model) > threshold))
    name = F.array(*map(F.lit, KINDS))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    every = F.array_sort(F.concat("__base", F.transform("__random", lambda s: F.struct(
        s["start"].alias("start"), F.lit(3).alias("kind"), s["stop"].alias("stop")))))
    return rows.select(
        "doc_id", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(written("__base"), 256).alias("base_sha256"), written(every).alias("spans"))


def find_secrets(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """Train on the labelled strings of ``docs`` and scan them."""
    return scan(docs, train(samples(docs, sample_docs)), threshold)
