"""URL filters by host-suffix and path-prefix expressions.

A rule is an action, a host and a path. It fits its host and all subdomains
when the url's path starts with the rule's path; of the rules that fit, the
longest wins. Every url is expanded into the expressions a rule could have:
a suffix of its host's labels followed by a prefix of its path, one for each
shape (labels, path characters) that the rules have and the url is long enough
for. Expressions meet rules in an equi-join on the first 32 bits of their
digest; the full digest confirms, and rule precedence picks the winner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import join_small
from tidegrid.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """A short list of rules as a table of action, host and path."""
    rows = [F.struct(*[F.lit(value).alias(name) for name, value in zip(("action", "host", "path"), rule, strict=True)]) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without a ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _labels(host: Column) -> Column:
    """Labels of a host; 0 for an empty one."""
    return F.when(F.length(host) == 0, 0).otherwise(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def prepared(rules: DataFrame) -> DataFrame:
    """One row per expression: rule, action, labels, chars, short and digest.

    Hosts are lower-cased. A rule without a host, or whose path is neither
    empty nor begins with ``/``, fits no url and is left out; of equal
    expressions with both actions ``block`` stays; a null path is an empty one.
    """
    host = F.translate("host", UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    known = rules.select(host.alias("host"), path.alias("path"), "action").filter(
        (F.length("host") > 0) & F.col("action").isin("allow", "block") & ((F.col("path") == "") | F.col("path").startswith("/")))
    rule = F.concat("host", "path")
    merged = known.groupBy(rule.alias("rule"), _labels(F.col("host")).alias("labels"), F.length("path").alias("chars")).agg(
        F.max("action").alias("action"))
    return merged.withColumn("digest", _digest(F.col("rule"))).withColumn("short", _short(F.col("digest")))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id") -> DataFrame:
    """key, host, path, rule and verdict of every page, one row per input row.

    A null url, or one without ``://``, has an empty host and path, fits no
    rule and gets ``default``, as does every url that no rule fits; then rule is
    null. Null and repeated keys and repeated rows stay rows of their own, an
    empty table gives none, urls may be of any length, and other columns are
    not read. Equal rows of an input partition travel as one row with a count,
    so neither a frequent url nor a null key gathers in one task. The shapes of
    the rules, one pair of numbers for each, come to the driver.
    """
    known = written(prepared(rules))
    shapes = [(r.labels, r.chars) for r in known.select("labels", "chars").distinct().collect()]
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(key), "url").groupBy(key, "url", F.spark_partition_id().alias("part")).agg(
        F.count("*").cast("int").alias("times"))
    parts = rows.select(key, "url", "part", "times", host.alias("host"), path.alias("path"))
    if shapes:
        table = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in shapes])
        fitting = F.filter(table, lambda s: (s.labels <= _labels(F.col("host"))) & (s.chars <= F.length("path")))
        suffix = "substring_index(host, '.', -shape.labels)"
        spread = parts.withColumn("shape", F.explode_outer(fitting)).withColumn(
            "own", _digest(F.expr(f"concat({suffix}, substring(path, 1, shape.chars))")))
        met = join_small(spread.drop("shape").withColumn("short", _short(F.col("own"))),
                         known.select("short", "digest", "rule", "action"), ["short"], "left")
        confirmed = F.when(F.col("own") == F.col("digest"), F.struct(F.length("rule").alias("length"), "action", "rule"))
        judged = met.groupBy(key, "url", "part", "times", "host", "path").agg(F.max(confirmed).alias("best"))
    else:
        judged = parts.withColumn("best", F.lit(None).cast("struct<length: int, action: string, rule: string>"))
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
