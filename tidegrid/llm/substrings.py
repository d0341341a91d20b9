"""Substring deduplication by super-k-mer partitioning.

A window is a run of 35 words. Consecutive windows with the same minimiser (the
smallest hash of the 5-word runs inside) form a super-k-mer; it travels as one
packed string to the bucket of its minimiser, and equal windows have equal
minimisers, so they meet. In a bucket, one sort counts the windows exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import packed as P
from tidegrid.session import written

#: Raw bytes of packed strings that a bucket holds, about.
BUCKET_BYTES = 12_000_000


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def super_kmers(words: P.Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and minimiser of every super-k-mer of a batch."""
    size = len(words.hashes) - window + 1
    none = np.empty(0, np.int64)
    if size <= 0:
        return none, none, np.empty(0, np.uint64)
    total = np.zeros(len(words.hashes) - seed + 1, dtype=np.uint64)
    for j in range(seed):
        total += words.hashes[j : j + len(total)] * P._ODD[j]
    least = _minima(P.mix(total), window - seed + 1)
    valid = words.doc[:size] == words.doc[window - 1 :]
    first = valid.copy()
    first[1:] &= ~(valid[:-1] & (least[1:] == least[:-1]) & (words.doc[1:size] == words.doc[: size - 1]))
    begin = np.flatnonzero(first)
    number = np.cumsum(first) - 1
    length = np.bincount(number[valid], minlength=len(begin)) if len(begin) else none
    return begin, length + window - 1, least[begin]


def _send(window: int, seed: int, bits: int):
    def send(rows):
        for row in rows:
            for number, body in zip(row.column(0).to_pylist(), row.column(1).to_pylist(), strict=True):
                words = P.Words(P.undense(body))
                begin, length, least = super_kmers(words, window, seed)
                if not len(begin):
                    continue
                key = P.mix(P.range_hashes(words.hashes, begin, begin + length, 1) ^ length.astype(np.uint64))
                bucket = (P.mix(least) >> np.uint64(64 - bits)).astype(np.int64)
                # equal strings of a batch travel once, with all their places
                order = np.lexsort((begin, key, bucket))
                bucket, key, begin, length = bucket[order], key[order], begin[order], length[order]
                fresh = np.ones(len(key), dtype=bool)
                fresh[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
                first_word = np.searchsorted(words.doc, words.doc[begin])  # of the document
                out = ([], [], [], [], [])
                for b, lo, to in P.slices(bucket):
                    new = fresh[lo:to]
                    heads = np.flatnonzero(new) + lo
                    text = b"\n".join(words.data[words.starts[i] : words.ends[i + n - 1]]
                                      for i, n in zip(begin[heads].tolist(), length[heads].tolist(), strict=True))
                    meta = np.stack([np.cumsum(new) - 1, words.doc[begin[lo:to]],
                                     begin[lo:to] - first_word[lo:to]], 1).astype(np.uint32)
                    for column, value in zip(out, (b, number, P.dense(text), P.shrink(meta.ravel()), to - lo), strict=True):
                        column.append(value)
                    if len(out[0]) >= 64:
                        yield _bucket_rows(out)
                        out = ([], [], [], [], [])
                if out[0]:
                    yield _bucket_rows(out)

    return send


def _bucket_rows(out):
    return P.record(bucket=pa.array(out[0], pa.int32()), batch=pa.array(out[1], pa.int64()),
                    body=pa.array(out[2], pa.binary()), places=pa.array(out[3], pa.binary()),
                    n=pa.array(out[4], pa.int32()))


def _count(window: int):
    def count(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("batch", kind="stable").reset_index(drop=True)
        bodies = [P.undense(b) for b in group["body"]]
        words = P.Words(b"\n".join(bodies))
        strings = np.array([b.count(b"\n") + 1 for b in bodies])
        offset = np.concatenate([[0], np.cumsum(strings)])
        places = [P.grow(b, np.uint32).reshape(-1, 3).astype(np.int64) for b in group["places"]]
        weight = np.concatenate([np.bincount(p[:, 0], minlength=n) for p, n in zip(places, strings, strict=True)])
        size = len(words.hashes) - window + 1
        at = np.flatnonzero(words.doc[:size] == words.doc[window - 1 :])
        one, two = (P.range_hashes(words.hashes, at, at + window, k) for k in (1, 2))
        order = np.argsort(one)
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        again = np.zeros(len(at), dtype=bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        again |= weight[words.doc[at]] > 1
        # runs of covered words in every string, relative to its start
        cover = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        np.add.at(cover, at[again], 1)
        np.add.at(cover, at[again] + window, -1)
        covered = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
        # a run ends with its string: strings stand side by side
        first_of = np.searchsorted(words.doc, np.arange(offset[-1] + 1))
        edge = np.zeros(len(words.hashes) + 1, dtype=bool)
        edge[first_of] = True
        starts = np.flatnonzero(covered[1:-1] & (~covered[:-2] | edge[:-1]))
        ends = np.flatnonzero(covered[1:-1] & (~covered[2:] | edge[1:])) + 1
        string = words.doc[starts]
        rows = []
        for i, p in enumerate(places):
            lo, to = np.searchsorted(string, [offset[i], offset[i + 1]])
            if lo == to:
                continue
            own = string[lo:to] - offset[i]
            begin, length = starts[lo:to] - first_of[string[lo:to]], ends[lo:to] - starts[lo:to]
            left, right = np.searchsorted(own, p[:, 0], side="left"), np.searchsorted(own, p[:, 0], side="right")
            times = right - left
            run = np.repeat(left - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            found = np.stack([np.repeat(p[:, 1], times), np.repeat(p[:, 2], times) + begin[run], length[run]], 1)
            rows.append((group["batch"][i], P.shrink(found.astype(np.uint32).ravel())))
        return pd.DataFrame(rows, columns=["batch", "found"])

    return count


def _keep(rows):
    for row in rows:
        for ids, body, found in zip(row.column("ids"), row.column("body"), row.column("found"), strict=True):
            ids = ids.as_py()
            texts = P.undense(body.as_py()).split(b"\n")
            spans = [P.grow(b, np.uint32).reshape(-1, 3) for b in (found.as_py() or [])]
            spans = np.concatenate(spans).astype(np.int64) if spans else np.empty((0, 3), np.int64)
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            n_words, n_removed, kept = [], [], []
            edges = np.searchsorted(spans[:, 0], np.arange(len(ids) + 1))
            for i, text in enumerate(texts):
                n = text.count(b" ") + 1 if text else 0
                own = spans[edges[i] : edges[i + 1]]
                if len(own):
                    cover = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(cover, own[:, 1], 1)
                    np.add.at(cover, own[:, 1] + own[:, 2], -1)
                    stay = np.cumsum(cover[:-1]) == 0
                    parts = text.split(b" ")
                    text = b" ".join([parts[j] for j in np.flatnonzero(stay).tolist()])
                    n_removed.append(n - int(stay.sum()))
                else:
                    n_removed.append(0)
                n_words.append(n)
                kept.append(text.decode("utf-8", "surrogatepass"))
            yield P.record(doc_id=pa.array(ids, pa.int64()), n_words=pa.array(n_words, pa.int64()),
                           n_removed=pa.array(n_removed, pa.int64()),
                           kept_sha256=pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in kept], pa.string()),
                           kept_text=pa.array(kept, pa.string()))


def remove_repeats(docs: DataFrame, window: int = 35, seed: int = 5) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (words by one space).

    A word is removed if a window of ``window`` words over it starts anywhere
    else too, in any document, the same one included. Null text has no words; a
    document shorter than the window keeps all; rows with equal ids or texts
    are documents of their own; an empty table gives none; other columns are
    not read. Long texts are cut into super-k-mers like any other.
    """
    table = written(P.batch_table(docs))
    total = table.agg(F.sum("size")).first()[0] or 0
    bits = P.bucket_bits(3 * total, BUCKET_BYTES)
    sent = table.select("batch", "body").mapInArrow(
        _send(window, seed, bits), "bucket int, batch long, body binary, places binary, n int")
    found = sent.groupBy("bucket").applyInPandas(_count(window), "batch long, found binary")
    found = found.groupBy("batch").agg(F.collect_list("found").alias("found"))
    return table.join(found, "batch", "left").select("ids", "body", "found").mapInArrow(
        _keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
