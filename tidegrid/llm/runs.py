"""Periodic runs of words, found by recompression.

The words of a batch of documents become numbers, and the sequence is
compressed to a grammar by turns: a round of blocks names every maximal
repetition of one symbol, a round of pairs names every left symbol that a right
one follows. Names depend on contents only, so equal stretches get equal names
but for a few symbols at their ends, on every level. The longest common
extension of two places therefore climbs while both stand at the edge of equal
nodes and descends at the first difference: a few steps per level.

A run of period q and length of at least max(24, 3q) holds a stretch of
max(24, 3q) - q places that equal the place q further, so it covers a point of
the grid with that step. For every period the points of its grid whose two
words are equal are extended to both sides by the grammar. All points of all
periods add up to n log n, in arrays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.packed import mix

#: Words that close a batch; a longer document is a batch of its own.
BATCH_WORDS = 250_000
#: Least length of a run, and least number of its periods.
LEAST, TIMES = 24, 3
#: Grid points that are compared at a time.
POINTS = 400_000


class Level:
    """One round: the symbols before it, the node above each, and the first symbol of each node."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, blocks: bool):
        self.symbols, self.blocks = symbols, blocks
        self.first = np.append(starts, len(symbols)).astype(np.int32)
        self.up = (np.cumsum(np.bincount(starts, minlength=len(symbols))) - 1).astype(np.int32)


def _named(keys: np.ndarray, base: int) -> tuple[np.ndarray, int]:
    distinct, names = np.unique(keys, return_inverse=True)
    return names.ravel() + base, base + len(distinct)


def grammar(symbols: np.ndarray, ends: int) -> list[Level]:
    """The rounds over ``symbols``; numbers below ``ends`` part documents, occur once and stay by themselves."""
    levels, names, turn = [], int(symbols.max()) + 1, 0
    symbols = symbols.astype(np.int64)
    while True:
        changed = False
        for blocks in (True, False):
            if blocks:
                starts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
                sizes = np.diff(np.append(starts, len(symbols)))
                above, many = symbols[starts], sizes > 1
                keys = (above[many].astype(np.uint64) << np.uint64(32)) | sizes[many].astype(np.uint64)
            else:
                right = (mix(symbols.astype(np.uint64) + np.uint64(turn * 2654435761 + 1)) & np.uint64(1)).astype(bool)
                word = symbols >= ends
                head = np.append(word[:-1] & ~right[:-1] & word[1:] & right[1:], False)
                starts = np.flatnonzero(~np.append(False, head[:-1]))
                above, many = symbols[starts], head[starts]
                keys = (above[many].astype(np.uint64) << np.uint64(32)) | symbols[starts[many] + 1].astype(np.uint64)
            if not len(keys):
                continue
            changed = True
            levels.append(Level(symbols.astype(np.int32), starts, blocks))
            above[many], names = _named(keys, names)
            symbols = above
        turn += 1
        word = symbols >= ends
        if not changed and not (word[1:] & word[:-1]).any():
            return [*levels, Level(symbols.astype(np.int32), np.arange(len(symbols)), False)]


def extension(levels: list[Level], i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How many symbols from ``i`` and ``j`` on, to the right (step 1) or the left (-1), are equal; i < j.

    Each place moves over equal symbols on a level until both are at the edge
    of a node, then climbs; at a difference it descends. Documents are parted by
    symbols that occur once, so every walk ends at one.
    """
    out = np.empty(len(i), dtype=np.int64)
    who, a, b, start = np.arange(len(i)), i.astype(np.int64), j.astype(np.int64), i.astype(np.int64)
    waiting: list[list[np.ndarray]] = []  # per level: who stopped there on the way up

    def walk(level: Level, who, a, b, climb: bool):
        """Move over equal symbols; give back those at an edge (when climbing) and those at a difference."""
        edge, stopped = [], []
        while len(who):
            same = level.symbols[a] == level.symbols[b]
            stopped.append((who[~same], a[~same], b[~same]))
            who, a, b = who[same], a[same], b[same]
            if not len(who):
                break
            ua, ub = level.up[a], level.up[b]
            if step > 0:
                begin, left_a, left_b = (level.first[ua] == a) & (level.first[ub] == b), level.first[ua + 1] - a, level.first[ub + 1] - b
            else:
                begin = (level.first[ua + 1] - 1 == a) & (level.first[ub + 1] - 1 == b)
                left_a, left_b = a - level.first[ua] + 1, b - level.first[ub] + 1
            if climb:
                edge.append((who[begin], a[begin], b[begin]))
                stay = ~begin
                who, a, b, left_a, left_b = who[stay], a[stay], b[stay], left_a[stay], left_b[stay]
            move = np.minimum(left_a, left_b) if level.blocks else 1
            a, b = a + step * move, b + step * move
        join = lambda parts: [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3
        return join(edge), join(stopped)

    top = len(levels) - 1
    for at, level in enumerate(levels):
        (who, a, b), stopped = walk(level, who, a, b, at < top)
        waiting.append(stopped)
        a, b = level.up[a].astype(np.int64), level.up[b].astype(np.int64)
        if not len(who):
            break
    who, a, b = waiting.pop()
    while waiting:
        below = levels[len(waiting) - 1]
        if step > 0:
            a, b = below.first[a].astype(np.int64), below.first[b].astype(np.int64)
        else:
            a, b = below.first[a + 1].astype(np.int64) - 1, below.first[b + 1].astype(np.int64) - 1
        _, (who, a, b) = walk(below, who, a, b, False)
        more = waiting.pop()
        who, a, b = np.concatenate([who, more[0]]), np.concatenate([a, more[1]]), np.concatenate([b, more[2]])
    out[who] = np.abs(a - start[who])
    return out


def _grid(lengths: np.ndarray, begins: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place and period of every grid point with equal words; documents stand longest first."""
    q, longest = 1, int(lengths[0]) // TIMES if len(lengths) else 0
    fitting = np.searchsorted(-lengths, -np.maximum(LEAST, TIMES * np.arange(longest + 2)), side="right")
    stops = begins + lengths
    span = np.where(fitting > 0, stops[np.maximum(fitting, 1) - 1], 0)  # words of the documents that are long enough
    periods = np.arange(longest + 2)
    steps = np.maximum(LEAST - periods, (TIMES - 1) * periods)
    points = np.maximum(0, -(-(span - periods) // np.maximum(steps, 1)))
    total = np.cumsum(points)
    while q <= longest:
        to = max(q + 1, int(np.searchsorted(total, total[q - 1] + POINTS, side="right")))
        to = min(to, longest + 1)
        many = points[q:to]
        period = np.repeat(periods[q:to], many)
        inside = np.arange(len(period)) - np.repeat(np.cumsum(many) - many, many)
        place = inside * steps[period]
        same = symbols[place] == symbols[place + period]
        yield place[same], period[same]
        q = to


def find_runs(docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """start, length and smallest period of every run of each sequence of word numbers, by start, then period."""
    order = sorted(range(len(docs)), key=lambda d: -len(docs[d]))
    order = [d for d in order if len(docs[d]) >= LEAST]
    found: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    if not order:
        return found
    ends = len(order) + 1
    lengths = np.array([len(docs[d]) for d in order], dtype=np.int64)
    begins = np.cumsum(lengths + 1) - lengths  # a parting symbol stands before each document and at the end
    symbols = np.empty(int(lengths.sum()) + ends, dtype=np.int64)
    symbols[np.append(begins - 1, len(symbols) - 1)] = np.arange(ends)
    for begin, d in zip(begins.tolist(), order, strict=True):
        symbols[begin : begin + len(docs[d])] = docs[d] + ends
    levels, kept = None, []
    for place, period in _grid(lengths, begins, symbols):
        inside = (symbols[place] >= ends) & (
            np.searchsorted(begins, place, side="right") == np.searchsorted(begins, place + period, side="right"))
        place, period = place[inside], period[inside]
        if not len(place):
            continue
        levels = levels or grammar(symbols, ends)
        forward, backward = extension(levels, place, place + period, 1), extension(levels, place, place + period, -1)
        start, length = place - backward + 1, forward + backward - 1 + period
        good = length >= np.maximum(LEAST, TIMES * period)
        kept.append(np.unique(np.stack([start[good], length[good], period[good]]), axis=1))
    if not kept:
        return found
    start, length, period = np.concatenate(kept, axis=1)
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    least = np.append(True, (np.diff(start) != 0) | (np.diff(length) != 0)) if len(start) else np.empty(0, bool)
    start, length, period = start[least], length[least], period[least]
    by = np.lexsort((period, start))
    owner = np.searchsorted(begins, start[by], side="right") - 1
    for o, s, n, q in zip(owner.tolist(), start[by].tolist(), length[by].tolist(), period[by].tolist(), strict=True):
        found[order[o]].append((s - int(begins[o]), n, q))
    return found


def periodic(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words with the tail that the contract makes periodic for some ids; a null id changes nothing."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    at = np.arange(n)
    return words[np.where(at >= a, a + (at - a) % p, at)]


LONGS = ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli")
TEXTS = ("runs_sha256", "collapsed_sha256")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ARROW = pa.schema([*((c, pa.int64()) for c in LONGS), *((c, pa.string()) for c in TEXTS), ("runs", pa.list_(RUN))])
SCHEMA = (", ".join([*(f"{c} long" for c in LONGS), *(f"{c} string" for c in TEXTS)])
          + ", runs array<struct<start: long, length: long, period: long>>")


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, texts, size = [], [], 0
    for batch in rows:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            words = (text.as_py() or b"").split()  # blank, tab, line feed, vertical tab, form feed, carriage return
            ids.append(doc_id.as_py())
            texts.append(words)
            size += len(words) + 1
            if size >= BATCH_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for s, n, q in runs:  # by start, then period: an equal exponent does not replace
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return best


def _results(rows: Iterator[pa.RecordBatch], rewrite: bool) -> Iterator[pa.RecordBatch]:
    for ids, texts in _batches(rows):
        coded = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
        numbers, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        cuts = np.cumsum([0, *map(len, texts)]).tolist()
        given = [numbers[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        docs = [periodic(d, i) for d, i in zip(given, ids, strict=True)] if rewrite else given
        out = []
        for doc_id, own, was, words, runs in zip(ids, docs, given, texts, find_runs(docs), strict=True):
            if runs or own is not was:
                keep = np.ones(len(own), dtype=bool)
                for s, n, q in runs:
                    keep[s + q : s + n] = False
                words = [known[w] for w in own[keep].tolist()]
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            s, n, q = _best(runs) or (None, None, None)
            out.append((doc_id, len(own), len(runs), s, n, q, 1000 * n // q if runs else None,
                        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(),
                        [{"start": s, "length": n, "period": q} for s, n, q in runs]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ARROW, strict=True)], schema=ARROW)


def periodic_runs(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """Runs of every text: n_runs, the run of greatest length / period, digests of all runs and of the kept words, and the runs.

    Words are parted by blank, tab, line feed, vertical tab, form feed and
    carriage return. A run has a smallest period q, a length of at least
    max(24, 3q) and cannot be extended; words of a run after its first q words
    are dropped from ``collapsed_sha256``. Ties go to the smallest start, then
    period. With ``rewrite`` the texts of some ids are made periodic first.
    Null and empty texts have no words and no runs; null and repeated ids and
    repeated rows are rows of their own; an empty table gives none; other
    columns are not read. A text of any length is handled whole, as one batch
    of its task; its memory is proportional to its words, and nothing is
    shuffled, so a lost executor costs its own batches only.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lambda batches: _results(batches, rewrite), SCHEMA)
