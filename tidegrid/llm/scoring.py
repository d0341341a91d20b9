"""Stupid-backoff scores of documents against the rest of their corpus.

Count tables of 1- to ``order``-grams are partitioned by hash: every batch of
documents sends its distinct n-grams with their counts to the partitions, which
add them up and answer each batch with the totals of the n-grams it asked for.
The batch joins them to its exploded n-grams and sums per document.

S(w | context) = c(context w) / c(context) if c(context w) > 0, else
alpha * S(w | shorter context); for single words c(w) / N, and alpha / N for a
word that is nowhere else. Counts leave out the scored document itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import packed as P
from tidegrid.session import written

#: Raw bytes of text whose n-grams of one length make up a partition, about.
BUCKET_BYTES = 8_000_000
#: Bits of an n-gram's hash that are kept.
HASH_BITS = 48


def _grams(words: P.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, doc = P.ngrams(words, n)
    return hashes >> np.uint64(64 - HASH_BITS), doc


def _ask(order: int, bits: int):
    def ask(rows):
        for row in rows:
            for number, body in zip(row.column(0).to_pylist(), row.column(1).to_pylist(), strict=True):
                words = P.Words(P.undense(body))
                for n in range(1, order + 1):
                    grams, counts = np.unique(_grams(words, n)[0], return_counts=True)
                    bucket = (grams >> np.uint64(HASH_BITS - bits)).astype(np.int64)
                    cut = list(P.slices(bucket))
                    for i in range(0, len(cut), 128):
                        part = cut[i : i + 128]
                        yield P.record(
                            key=pa.array([(n << bits) | b for b, _, _ in part], pa.int32()),
                            batch=pa.array([number] * len(part), pa.int64()),
                            grams=pa.array([P.shrink_sorted(grams[a:z]) for _, a, z in part], pa.binary()),
                            counts=pa.array([P.shrink(counts[a:z].astype(np.uint32)) for _, a, z in part], pa.binary()))

    return ask


def _total(group: pd.DataFrame) -> pd.DataFrame:
    grams = [P.grow_sorted(b) for b in group["grams"]]
    edges = np.cumsum([0] + [len(g) for g in grams])
    grams = np.concatenate(grams)
    counts = np.concatenate([P.grow(b, np.uint32) for b in group["counts"]]).astype(np.uint64)
    order = np.argsort(grams)
    first = np.ones(len(grams), dtype=bool)
    first[1:] = grams[order][1:] != grams[order][:-1]
    sums = np.add.reduceat(counts[order], np.flatnonzero(first))
    total = np.empty(len(grams), dtype=np.uint64)
    total[order] = sums[np.cumsum(first) - 1]
    return pd.DataFrame({"batch": group["batch"], "key": group["key"],
                         "totals": [P.shrink(total[a:z]) for a, z in zip(edges, edges[1:], strict=False)]})


def _others(grams: np.ndarray, doc: np.ndarray, totals: np.ndarray, docs: int) -> np.ndarray:
    """For every place: how often its n-gram occurs in other documents."""
    order = np.argsort(grams)
    first = np.ones(len(grams), dtype=bool)
    first[1:] = grams[order][1:] != grams[order][:-1]
    which = np.cumsum(first) - 1
    total = totals[which].astype(np.int64)
    here = np.diff(np.append(np.flatnonzero(first), len(grams)))[which]  # in this batch
    own = np.ones(len(grams), dtype=np.int64)
    many = np.flatnonzero(here > 1)
    if len(many):
        _, back, times = np.unique(which[many] * docs + doc[order][many], return_inverse=True, return_counts=True)
        own[many] = times[back]
    out = np.empty(len(grams), dtype=np.int64)
    out[order] = total - own
    return out


def score_batch(words: P.Words, docs: int, order: int, totals: dict[int, np.ndarray], corpus_words: int,
                alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, natural log score and unbacked highest-order words of each document of a batch."""
    n_words = words.counts(docs)
    size = len(words.hashes)
    rest = np.maximum(corpus_words - n_words, 1).astype(float)[words.doc]
    place = np.arange(size) - np.searchsorted(words.doc, words.doc)  # in the document
    best = np.zeros(size)
    found = np.zeros(size, dtype=np.int64)
    lower = np.zeros(size, dtype=np.int64)  # of the n - 1 words that end here
    for n in range(1, order + 1):
        grams, doc = _grams(words, n)
        other = _others(grams, doc, totals.get(n, np.empty(0, np.uint64)), docs)
        here = np.zeros(size, dtype=np.int64)
        ends = np.flatnonzero(place >= n - 1)
        here[ends] = other
        if n == 1:
            best = np.where(here > 0, np.log(np.maximum(here, 1) / rest), np.log(alpha / rest))
            found = np.ones(size, dtype=np.int64)
        else:
            context = np.ones(size, dtype=np.int64)
            context[1:] = np.maximum(lower[:-1], 1)
            seen = here > 0
            best = np.where(seen, np.log(np.maximum(here, 1) / context),
                            np.where(place >= n - 1, best + np.log(alpha), best))
            found = np.where(seen, n, found)
        lower = here
    score = np.bincount(words.doc, weights=best, minlength=docs) if size else np.zeros(docs)
    top = np.bincount(words.doc, weights=(found == order).astype(float), minlength=docs) if size else np.zeros(docs)
    return n_words, score, top.astype(np.int64)


def _score(order: int, bits: int, corpus_words: int, alpha: float):
    def score(rows):
        for row in rows:
            for ids, body, answers in zip(*(row.column(c) for c in ("ids", "body", "answers")), strict=True):
                ids = ids.as_py()
                words = P.Words(P.undense(body.as_py()))
                got = sorted(((a["key"], a["totals"]) for a in (answers.as_py() or [])), key=lambda a: a[0])
                totals = {n: np.concatenate([P.grow(t, np.uint64) for k, t in got if k >> bits == n])
                          for n in {k >> bits for k, _ in got}}
                n_words, total, top = score_batch(words, len(ids), order, totals, corpus_words, alpha)
                mean = [t / n if n else None for t, n in zip(total.tolist(), n_words.tolist(), strict=True)]
                yield P.record(doc_id=pa.array(ids, pa.int64()), n_words=pa.array(n_words, pa.int64()),
                               log_score=pa.array(total, pa.float64()), mean_log_score=pa.array(mean, pa.float64()),
                               n_highest=pa.array(top, pa.int64()))

    return score


def backoff_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4) -> DataFrame:
    """doc_id, n_words, log_score (natural log, summed), mean_log_score, n_highest (words scored by full context).

    Null and empty texts have no words, score 0 and a null mean; copies count
    for each other; rows with equal ids are documents of their own; an empty
    table gives none; other columns are not read.
    """
    table = written(P.batch_table(docs))
    size, corpus_words = table.agg(F.sum("size"), F.sum("words")).first()
    bits = P.bucket_bits(size or 0, BUCKET_BYTES, most=28)
    asked = table.select("batch", "body").mapInArrow(
        _ask(order, bits), "key int, batch long, grams binary, counts binary")
    answers = asked.groupBy("key").applyInPandas(_total, "batch long, key int, totals binary")
    answers = answers.groupBy("batch").agg(F.collect_list(F.struct("key", "totals")).alias("answers"))
    return table.join(answers, "batch", "left").select("ids", "body", "answers").mapInArrow(
        _score(order, bits, int(corpus_words or 0), alpha),
        "doc_id long, n_words long, log_score double, mean_log_score double, n_highest long")
