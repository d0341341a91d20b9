"""N-gram Jaccard join by token-combination prefixes.

A document is its set of distinct 5-word shingles ("tokens"), and two documents
link when 100 * intersection >= 75 * union. The global token order puts rare
tokens (in fewer than ``FREQUENT`` sets) first, then by hash. Of a set of n
tokens, a linked set shares at least ceil(3n / 4), so it shares a token of the
prefix, the first n - ceil(3n / 4) + 1.

* If the first shared token is rare, it is a rare token of both prefixes: rare
  prefix tokens are indexed alone. Tokens of one set only are never shared and
  not indexed.
* Else no rare token is shared and the first g + 1 shared tokens are frequent
  ones of the prefixes extended by g. Frequent tokens fall into g classes by
  hash, so two shared ones have a class in common: the pairs of frequent tokens
  of equal class are indexed. g depends on a band of sizes; linked sets lie in
  the same band or in neighbours, so a set is indexed for its own band and the
  one below.

Rare and frequent are told apart by counting all tokens in buckets. Copies in
one batch are one set. Of the sets that meet in the index, each is first compared
with one pivot, in two rounds. Sets with one pivot form blocks, and blocks in
which sets of different components still meet are compared as a whole, by matrix
products, so no link between components is left out and no pairs are shipped.
To count the links of each document, blocks that meet anywhere are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import packed as P
from tidegrid.llm.common import TEXT_ROWS
from tidegrid.operators.scale import salted_join
from tidegrid.session import arrow_rows, written, written_buckets

SHINGLE = 5
#: Sets from which a token is frequent; also the sets of a batch from which it is counted there and then.
FREQUENT = 32
#: Bytes of text whose tokens a bucket holds, about.
BUCKET_BYTES = 4_000_000
HASH_BITS = 48
#: Bytes of a token that a bucket ships; the bucket number holds the bits above them.
WIDTH = 5
#: Rounds in which every set is compared with one pivot before the rest is compared.
PIVOT_ROUNDS = 2
#: Tokens and sets that a block of the last comparison holds, about.
BLOCK_TOKENS, BLOCK_SETS = 1_200_000, 2048
_NODE_BITS = 16


def size_bands(limit: int) -> np.ndarray:
    """First sizes of the bands: a set at most 4/3 as large lies in the same or the next band."""
    edges = [1]
    while edges[-1] <= limit:
        edges.append(edges[-1] * 4 // 3 + 1)
    return np.array(edges, dtype=np.int64)


def shingle_sets(words: P.Words, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens (sorted by document, then hash), their documents, and the set sizes."""
    hashes, doc = P.ngrams(words, SHINGLE)
    counts = words.counts(docs)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        first = np.searchsorted(words.doc, short)
        whole = P.mix(P.range_hashes(words.hashes, first, first + counts[short], 1) + counts[short].astype(np.uint64))
        hashes, doc = np.concatenate([hashes, whole]), np.concatenate([doc, short])
    hashes = hashes >> np.uint64(64 - HASH_BITS)
    order = np.argsort(hashes)
    order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, doc, np.bincount(doc, minlength=docs)


#: Bytes of text whose n-grams are hashed at a time, and of packed tokens that a task merges by bucket before it ships them.
STRETCH_BYTES, MERGED_BYTES = 1_000_000, 48_000_000


def batch_sets(data: bytes, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, documents and sizes as ``shingle_sets``, and for every document the first one with the same set.

    Documents are hashed a stretch at a time, so that only the tokens
    themselves (10 bytes each) are held for the whole batch.
    """
    tokens, doc, sizes, signs = [np.empty(0, np.uint64)], [np.empty(0, np.uint16)], [np.empty(0, np.int64)], [np.empty((0, 3), np.uint64)]
    texts, at = data.split(b"\n"), 0
    while at < docs:
        to, held = at, 0
        while to < docs and (to == at or held + len(texts[to]) <= STRETCH_BYTES):
            held += len(texts[to])
            to += 1
        own, of, many = shingle_sets(P.Words(b"\n".join(texts[at:to])), to - at)
        edges = np.concatenate([[0], np.cumsum(many)])
        sign = np.zeros((to - at, 3), dtype=np.uint64)
        full = np.flatnonzero(many)
        if len(full):
            for k in range(2):
                sign[full, k] = np.add.reduceat(P.mix(own * P._ODD[k + 40]), edges[full])
        sign[:, 2] = many
        tokens.append(own)
        doc.append((of + at).astype(np.uint16))
        sizes.append(many)
        signs.append(sign)
        at = to
    _, first, back = np.unique(np.concatenate(signs), axis=0, return_index=True, return_inverse=True)
    return np.concatenate(tokens), np.concatenate(doc), np.concatenate(sizes), first[back.ravel()]


_TOKEN_SCHEMA = "bucket long, batches array<long>, tokens array<binary>, docs array<binary>, hot array<binary>, ids binary"


def _token_rows(bits: int):
    def rows_of(rows):
        held, size = {}, 0
        for number, ids, data, n in P.batches(rows, lower=True):
            tokens, doc, sizes, first = batch_sets(data, n)
            del data
            keep = first[doc] == doc
            tokens, doc = tokens[keep], doc[keep]
            # tokens of many sets of this batch are frequent whatever the others hold
            order = np.argsort(tokens)
            ordered = tokens[order]
            starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, np.int64)
            times = np.diff(np.append(starts, len(ordered)))
            hot_tokens = ordered[starts[times >= FREQUENT]]
            hot = np.zeros(len(tokens), dtype=bool)
            hot[order] = np.repeat(times >= FREQUENT, times)
            del order, ordered, starts, times, keep
            yield _token_record([(1 << 40) + number], [[(number, P.pack(tokens[hot], 6), P.shrink(doc[hot]), P.shrink(
                np.stack([sizes, first, [x is None for x, _ in ids]], 1).astype(np.uint32).ravel()))]],
                [P.shrink(np.array([(x or 0, h) for x, h in ids], dtype=np.int64).ravel())])
            tokens, doc = tokens[~hot], doc[~hot]
            bucket = (tokens >> np.uint64(HASH_BITS - bits)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            tokens, doc, bucket = tokens[order], doc[order], bucket[order]
            hot_bucket = (hot_tokens >> np.uint64(HASH_BITS - bits)).astype(np.uint32)
            cut = {b: (a, z) for b, a, z in P.slices(bucket)}
            hot_cut = {b: (a, z) for b, a, z in P.slices(hot_bucket)}
            for b in cut.keys() | hot_cut.keys():
                (a, z), (c, d) = cut.get(b, (0, 0)), hot_cut.get(b, (0, 0))
                piece = (number, P.pack(tokens[a:z], WIDTH), P.shrink(np.diff(doc[a:z], prepend=np.uint16(0))), P.pack(hot_tokens[c:d], WIDTH))
                held.setdefault(b, []).append(piece)
                size += sum(map(len, piece[1:])) + 200
            del tokens, doc, bucket, order, hot, cut, hot_cut
            if size > MERGED_BYTES:
                yield from _merged(held)
                held, size = {}, 0
            P.release()
        yield from _merged(held)
        P.release()

    return rows_of


def _merged(held: dict) -> Iterator[pa.RecordBatch]:
    """One row for each bucket, with the pieces of all its batches."""
    keys = sorted(held)
    for i in range(0, len(keys), 64):
        part = keys[i : i + 64]
        yield _token_record(part, [held.pop(b) for b in part], [None] * len(part))


def _token_record(bucket, pieces, ids):
    column = lambda k, kind: pa.array([[p[k] for p in of] for of in pieces], pa.list_(kind))
    return P.record(bucket=pa.array(bucket, pa.int64()), batches=column(0, pa.int64()), tokens=column(1, pa.binary()),
                    docs=column(2, pa.binary()), hot=column(3, pa.binary()), ids=pa.array(ids, pa.binary()))


_SHARED_SCHEMA = "batch long, bucket long, tokens binary, docs binary, info binary, ids binary"


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's tokens, those of several sets go back to their batches, marked if frequent."""
    pieces = [p for row in zip(*(group[c] for c in ("batches", "tokens", "docs", "hot")), strict=True) for p in zip(*row, strict=True)]
    if group["bucket"].iloc[0] >= 1 << 40:  # what a batch keeps for itself
        return pd.DataFrame([(batch, group["bucket"].iloc[0], tokens, docs, info, group["ids"].iloc[0]) for batch, tokens, docs, info in pieces],
                            columns=["batch", "bucket", "tokens", "docs", "info", "ids"])
    tokens = [P.unpack(p[1], WIDTH) for p in pieces]
    hot = [P.unpack(p[3], WIDTH) for p in pieces]
    edges = np.cumsum([0] + [len(t) for t in tokens])
    every = np.concatenate(tokens + hot)
    weight = np.ones(len(every), dtype=np.int64)
    weight[edges[-1]:] = FREQUENT
    order = np.argsort(every)
    new = np.ones(len(every), dtype=bool)
    new[1:] = every[order][1:] != every[order][:-1]
    sets = np.empty(len(every), dtype=np.int64)
    sets[order] = np.add.reduceat(weight[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    rows = []
    for i, own in enumerate(tokens):
        count = sets[edges[i] : edges[i + 1]]
        shared = count > 1
        if shared.any():
            docs = np.cumsum(P.grow(pieces[i][2], np.uint16).astype(np.int64))[shared]
            rows.append((pieces[i][0], group["bucket"].iloc[0], P.pack(own[shared], WIDTH),
                         P.shrink(np.diff(docs, prepend=0).astype(np.uint16)),
                         np.packbits(count[shared] >= FREQUENT).tobytes(), None))
    return pd.DataFrame(rows, columns=["batch", "bucket", "tokens", "docs", "info", "ids"])


_KIND_SCHEMA = "kind string, node long, n long, doc_id long, h long, key int, body binary, batch long"


def _index(bits: int, key_bits: int):
    def index(group: pd.DataFrame) -> pd.DataFrame:
        """Documents, sets that may have links, and index entries of one batch."""
        own = group["bucket"] >= 1 << 40
        info = group[own].iloc[0]
        batch = int(info["batch"])
        sizes, first, unnamed = P.grow(info["info"], np.uint32).reshape(-1, 3).astype(np.int64).T
        tokens, docs, often = [P.unpack(info["tokens"], 6)], [P.grow(info["docs"], np.uint16).astype(np.int64)], []
        often.append(np.ones(len(tokens[0]), dtype=bool))
        for bucket, t, d, marks in zip(*(group[~own][c] for c in ("bucket", "tokens", "docs", "info")), strict=True):
            t, low = P.unpack(t, WIDTH), np.uint64((1 << 8 * WIDTH) - 1)
            tokens.append((t & low) | ((np.uint64(bucket) << np.uint64(HASH_BITS - bits)) & ~low))
            docs.append(np.cumsum(P.grow(d, np.uint16).astype(np.int64)))
            often.append(np.unpackbits(np.frombuffer(marks, np.uint8), count=len(t)).astype(bool))
        tokens, docs, often = np.concatenate(tokens), np.concatenate(docs), np.concatenate(often)
        alone = sizes - np.bincount(docs, minlength=len(sizes))  # tokens of this set only; they come first
        prefix = sizes - (3 * sizes + 3) // 4 + 1
        live = (alone < prefix)[docs]
        tokens, docs, often = tokens[live], docs[live], often[live]
        order = np.lexsort((tokens, often, docs))
        tokens, docs, often = tokens[order], docs[order], often[order]
        edges = np.searchsorted(docs, np.arange(len(sizes) + 1))
        rank = np.arange(len(docs)) - edges[docs] + alone[docs]
        single = ~often & (rank < prefix[docs])
        keys, of = [P.mix(tokens[single])], [docs[single]]
        # sets whose prefix reaches frequent tokens
        bands = size_bands(int(sizes.max(initial=1)))
        band = np.searchsorted(bands, sizes, side="right") - 1
        reach = np.zeros(len(sizes), dtype=bool)
        reach[docs[often & (rank < prefix[docs])]] = True
        for step in (0, 1):
            level = band - step
            classes = np.where(level >= 0, bands[np.maximum(level, 0)] // 8, 0)
            use = often & reach[docs] & (level >= 0)[docs] & (rank < (prefix + classes)[docs])
            t, d, g, lv = tokens[use], docs[use], classes[docs[use]], level[docs[use]].astype(np.uint64)
            one = g == 0
            keys.append(P.mix(P.mix(t[one]) + lv[one] + np.uint64(1)))
            of.append(d[one])
            t, d, g, lv = t[~one], d[~one], g[~one], lv[~one]
            group_of = (P.mix(t) % g.astype(np.uint64)).astype(np.int64)
            order = np.lexsort((t, group_of, d))
            t, d, group_of, lv = t[order], d[order], group_of[order], lv[order]
            apart = 1
            while True:
                pair = (d[apart:] == d[:-apart]) & (group_of[apart:] == group_of[:-apart])
                if not pair.any():
                    break
                keys.append(P.mix(P.mix(t[:-apart][pair]) * P._ODD[50] + P.mix(t[apart:][pair]) + lv[apart:][pair]))
                of.append(d[apart:][pair])
                apart += 1
        keys, of = np.concatenate(keys), np.concatenate(of)
        bucket = (keys >> np.uint64(64 - key_bits)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        keys, of, bucket = keys[order], of[order], bucket[order]
        out = []
        node = (batch << _NODE_BITS) | first
        ids = P.grow(info["ids"], np.int64).reshape(-1, 2)
        for i in range(len(sizes)):
            out.append(("doc", int(node[i]) if sizes[i] else None, int(sizes[i]), None if unnamed[i] else int(ids[i, 0]),
                        int(ids[i, 1]), None, None, batch))
        for i in np.unique(docs).tolist():
            out.append(("set", int(node[i]), int(sizes[i]), None, None, None,
                        P.pack(np.sort(tokens[edges[i] : edges[i + 1]]), 6), batch))
        for b, a, z in P.slices(bucket):
            meta = np.stack([of[a:z], sizes[of[a:z]], alone[of[a:z]]], 1).astype(np.uint32)
            body = P.pack(keys[a:z], 8)
            out.append(("key", None, z - a, None, None, b, len(body).to_bytes(8, "little") + body + P.shrink(meta.ravel()), batch))
        columns = list(zip(*out, strict=True))
        whole = lambda i, dtype="Int64": pd.array(columns[i], dtype=dtype)  # noqa: E731  never through floats
        return pd.DataFrame({"kind": columns[0], "node": whole(1), "n": whole(2), "doc_id": whole(3), "h": whole(4),
                             "key": whole(5, "Int32"), "body": columns[6], "batch": whole(7, "int64")})

    return index


def _entries(group: pd.DataFrame):
    """Keys, nodes, sizes, shares of unshared tokens, components and blocks of a bucket's index rows.

    Without a known component or block, it is the node itself.
    """
    keys, nodes, sizes, shares, comps, blocks = [], [], [], [], [], []
    for batch, body, known in zip(group["batch"], group["body"], group["comps"], strict=True):
        to = 8 + int.from_bytes(body[:8], "little")
        keys.append(P.unpack(body[8:to], 8))
        of, size, alone = P.grow(body[to:], np.uint32).reshape(-1, 3).astype(np.int64).T
        node = (int(batch) << _NODE_BITS) | of
        comp = block = node
        if known is not None and len(known):
            place = P.grow(known, np.int64).reshape(-1, 3)
            at = np.minimum(np.searchsorted(place[:, 0], node), len(place) - 1)
            there = place[at, 0] == node
            comp, block = np.where(there, place[at, 1], node), np.where(there, place[at, 2], node)
        nodes.append(node)
        sizes.append(size)
        shares.append(alone / size)
        comps.append(comp)
        blocks.append(block)
    return tuple(map(np.concatenate, (keys, nodes, sizes, shares, comps, blocks)))


def _pivots(turn: int):
    """For every set the pivot in another component that leads among those it meets at the keys of a bucket.

    Sets with few tokens of their own lie in the middle of their group and
    lead; a little chance, other in each turn, lets others lead as well.
    """

    def pivots(group: pd.DataFrame) -> pd.DataFrame:
        keys, nodes, sizes, shares, comps, _ = _entries(group)
        chance = (P.mix(nodes.astype(np.uint64) + np.uint64(turn)) >> np.uint64(11)).astype(float) / 2.0**53
        lead = shares + chance * 0.02 * turn
        order = np.lexsort((nodes, lead, keys))
        keys, nodes, sizes, comps, lead = (x[order] for x in (keys, nodes, sizes, comps, lead))
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        good = (comps[first] != comps) & (4 * np.minimum(sizes[first], sizes) >= 3 * np.maximum(sizes[first], sizes))
        node, lead, pivot = nodes[good], lead[first][good], nodes[first][good]
        order = np.lexsort((pivot, lead, node))
        one = np.ones(len(node), dtype=bool)
        one[1:] = node[order][1:] != node[order][:-1]
        order = order[one]
        return pd.DataFrame({"node": node[order], "lead": lead[order], "pivot": pivot[order]})

    return pivots


def _crossing(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of blocks (a block with itself, too) with a key whose sets lie in different components."""
    keys, _, _, _, comps, blocks = _entries(group)
    return _block_pairs(keys, comps, blocks)


def _block_pairs(keys: np.ndarray, comps: np.ndarray, blocks: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((blocks, keys))
    keys, comps, blocks = keys[order], comps[order], blocks[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    start = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    mixed = np.zeros(len(start), dtype=bool)
    mixed[which[comps != comps[start][which]]] = True
    once = new.copy()
    once[1:] |= blocks[1:] != blocks[:-1]
    use = once & mixed[which]
    keys, blocks = keys[use], blocks[use]
    found, apart = [np.stack([blocks, blocks], 1)], 1
    while apart < len(keys):
        same = keys[apart:] == keys[:-apart]
        if not same.any():
            break
        found.append(np.unique(np.stack([blocks[:-apart][same], blocks[apart:][same]], 1), axis=0))
        apart += 1
    both = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})


def _meeting(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of blocks (a block with itself, too) with a key of several sets."""
    keys, nodes, _, _, _, blocks = _entries(group)
    # a set is its own component here, so a key with two sets is mixed
    return _block_pairs(keys, nodes, blocks)


def _packed_blocks(rows: DataFrame) -> DataFrame:
    """block, and of its sets (node, n, comp, body) in the order of the nodes: places (node, n, comp and number of tokens) and tokens."""
    sets = F.sort_array(F.collect_list(F.struct("node", "n", "comp", "body")))
    place = lambda x: F.array(x["node"], x["n"], x["comp"], F.floor(F.octet_length(x["body"]) / 6).cast("long"))
    return rows.groupBy("block").agg(sets.alias("sets")).select(
        "block", F.flatten(F.transform("sets", place)).alias("places"), F.transform("sets", lambda x: x["body"]).alias("tokens"))


def _block(places: list, tokens: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, sizes, components and numbers of tokens of a block's sets, and the tokens."""
    return (*np.array(places, dtype=np.int64).reshape(-1, 4).T, P.unpack(b"".join(tokens), 6))


def common_counts(left: np.ndarray, left_of: np.ndarray, right: np.ndarray, right_of: np.ndarray, shape) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of 0/1 matrices."""
    every = np.intersect1d(left, right)
    out = np.zeros(shape, dtype=np.float32)
    for at in range(0, len(every), 4096):
        some = every[at : at + 4096]
        sides = []
        for tokens, of, rows in ((left, left_of, shape[0]), (right, right_of, shape[1])):
            use = (tokens >= some[0]) & (tokens <= some[-1])
            place = np.minimum(np.searchsorted(some, tokens[use]), len(some) - 1)
            hit = some[place] == tokens[use]
            matrix = np.zeros((rows, len(some)), dtype=np.float32)
            matrix[of[use][hit], place[hit]] = 1
            sides.append(matrix)
        out += sides[0] @ sides[1].T
    return out


def _linked_blocks(rows):
    """One link for each two components that any sets of two blocks link."""
    for row in rows:
        links = [np.empty((0, 2), np.int64)]
        for p, s, q, t in zip(*(row.column(c).to_pylist() for c in ("p", "s", "q", "t")), strict=True):
            (node, n, comp, length, left), (other, m, mate, size, right) = _block(p, s), _block(q, t)
            common = common_counts(left, np.repeat(np.arange(len(node)), length),
                                   right, np.repeat(np.arange(len(other)), size), (len(node), len(other)))
            good = (100 * common >= 75 * (n[:, None] + m[None, :] - common)) & (comp[:, None] != mate[None, :])
            i, j = np.nonzero(good)
            low, high = np.minimum(comp[i], mate[j]), np.maximum(comp[i], mate[j])
            _, first = np.unique(np.stack([low, high], 1), axis=0, return_index=True)
            links.append(np.stack([np.minimum(node[i], other[j])[first], np.maximum(node[i], other[j])[first]], 1))
        links = np.concatenate(links)
        yield P.record(a=pa.array(links[:, 0], pa.int64()), b=pa.array(links[:, 1], pa.int64()))


def _counted_blocks(rows):
    """Of each set of two blocks the documents of the sets that link with it, a block against itself without the set."""
    for row in rows:
        nodes, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b, p, s, q, t in zip(*(row.column(c).to_pylist() for c in ("a", "b", "p", "s", "q", "t")), strict=True):
            (node, n, copies, length, left), (other, m, more, size, right) = _block(p, s), _block(q, t)
            common = common_counts(left, np.repeat(np.arange(len(node)), length),
                                   right, np.repeat(np.arange(len(other)), size), (len(node), len(other)))
            good = 100 * common >= 75 * (n[:, None] + m[None, :] - common)
            if a == b:
                np.fill_diagonal(good, False)
            else:
                nodes.append(other)
                counts.append(copies @ good)
            nodes.append(node)
            counts.append(good @ more)
        nodes, counts = np.concatenate(nodes), np.concatenate(counts)
        some = counts > 0
        yield P.record(node=pa.array(nodes[some], pa.int64()), others=pa.array(counts[some], pa.int64()))


def _verify_blocks(pairs: DataFrame, places: DataFrame, sets: DataFrame) -> DataFrame:
    return written(_compared(pairs, places, sets).select("p", "s", "q", "t").mapInArrow(_linked_blocks, "a long, b long"))


def _compared(pairs: DataFrame, places: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of blocks a and b with the places and tokens of both."""
    pairs = written(pairs.distinct())
    used = pairs.select(F.explode(F.array("a", "b")).alias("block")).distinct()  # the others are compared already
    packed = written(_packed_blocks(sets.join(places.join(used, "block", "left_semi"), "node")))
    left = packed.select(F.col("block").alias("a"), F.col("places").alias("p"), F.col("tokens").alias("s"))
    right = packed.select(F.col("block").alias("b"), F.col("places").alias("q"), F.col("tokens").alias("t"))
    return pairs.join(right, "b").join(left, "a")


def _linked(rows):
    for row in rows:
        a, b = row.column("a").to_pylist(), row.column("b").to_pylist()
        keep, last, one = [], None, None
        for i, (n, m, s, t) in enumerate(zip(*(row.column(c).to_pylist() for c in ("k", "m", "s", "t")), strict=True)):
            if a[i] != last:
                last, one = a[i], P.unpack(s, 6)
            common = len(np.intersect1d(one, P.unpack(t, 6), assume_unique=True))
            keep.append(100 * common >= 75 * (n + m - common))
        yield P.record(a=pa.array([x for x, k in zip(a, keep, strict=True) if k], pa.int64()),
                       b=pa.array([x for x, k in zip(b, keep, strict=True) if k], pa.int64()))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    # every column has another name on both sides, so that the plans are equal and one shuffle of the sets serves both
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("body").alias("t"))
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("k"), F.col("body").alias("s"))
    return written(pairs.distinct().join(right, "b").join(left, "a").select("a", "b", "k", "m", "s", "t")
                   .mapInArrow(_linked, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """node and comp (the smallest node reachable) of every node with a link, by alternating stars.

    Each round is two aggregations and joins over the links; their number grows
    with the logarithm of the longest path.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v").distinct())
    state = None
    while True:
        least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # every neighbour points to the least one it can hear of
        reach = edges.join(least, "u")
        hooked = reach.select(F.col("v").alias("x"), F.col("m").alias("y")).union(
            reach.select(F.col("u").alias("x"), F.col("m").alias("y"))).filter("x != y").distinct()
        fresh = written(hooked.union(hooked.select("y", "x")).toDF("u", "v").distinct())
        now = fresh.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = fresh
        if tuple(now) == state:
            return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("comp")).withColumnRenamed("u", "node")
        state = tuple(now)


def _with_places(index: DataFrame, places: DataFrame | None) -> DataFrame:
    """Index rows with the components and blocks (node, comp, block) of their batch."""
    if places is None:
        return index.withColumn("comps", F.lit(None).cast("binary"))

    def gathered(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        return pd.DataFrame({"batch": [group["batch"].iloc[0]],
                             "comps": [P.shrink(group[["node", "comp", "block"]].to_numpy(np.int64).ravel())]})

    known = places.withColumn("batch", F.shiftright("node", _NODE_BITS)).groupBy("batch").applyInPandas(
        gathered, "batch long, comps binary")
    return index.join(known, "batch", "left")


def _blocked(sets: DataFrame, pivots: DataFrame, comps: DataFrame) -> DataFrame:
    """node, comp and block of every set: the sets of one pivot, cut so that a block stays small."""
    rows = (sets.select("node", "n").join(pivots, "node", "left").join(comps, "node", "left")
            .select("node", "n", F.coalesce("pivot", "node").alias("family"), F.coalesce("comp", "node").alias("comp")))
    parts = rows.groupBy("family").agg(F.greatest(
        F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_SETS)).cast("long").alias("parts")).filter("parts > 1")
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    # only families of several blocks are joined back, salted, since they are the large ones
    return salted_join(rows, parts, ["family"], "left").select("node", "comp", F.xxhash64("family", part).alias("block"))


def near_duplicates(docs: DataFrame, count_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, h, n, comp, component_id) and the links that were verified (nodes a, b).

    h is xxhash64 of the text, n the size of the set, comp the component's
    smallest node, null without shingles.

    component_id is the smallest doc_id reachable by links. Null text and text
    without words have no shingles and link with nothing, their own doc_id is
    the component; with one to four words the whole sequence is the shingle.
    Rows with equal ids are documents of their own; a null id is never the
    smallest unless all are null. An empty table gives none; other columns are
    not read. The links connect each component; within one, pairs that need no
    check were left out. With ``count_links`` the documents also have ``n_links``,
    the number of other documents that each links with, over all pairs; no pair
    is written.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(8, P.bucket_bits(size, BUCKET_BYTES))
    key_bits = P.bucket_bits(size, 16 * BUCKET_BYTES)
    tokens = docs.mapInArrow(_token_rows(bits), _TOKEN_SCHEMA)
    shared = tokens.groupBy("bucket").applyInPandas(_shared, _SHARED_SCHEMA)
    # joined by batch, and the sets by node, several times: in buckets, so that only the other side moves
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        kinds = written_buckets(shared.groupBy("batch").applyInPandas(_index(bits, key_bits), _KIND_SCHEMA), "batch", buckets, ("kind",))
    rows = kinds.filter("kind = 'doc'").select("doc_id", "h", "node", "n")
    sets = written_buckets(kinds.filter("kind = 'set'").select("node", "n", "body").repartition(buckets, "node"), "node", buckets)
    index = kinds.filter("kind = 'key'").select("key", "batch", "body")
    links = comps = first_pivots = None
    for turn in range(PIVOT_ROUNDS):
        places = comps if comps is None else comps.withColumn("block", F.col("node"))
        pivots = _with_places(index, places).groupBy("key").applyInPandas(
            _pivots(turn), "node long, lead double, pivot long")
        pivots = written(pivots.groupBy("node").agg(F.min(F.struct("lead", "pivot")).alias("best")).select("node", "best.pivot"))
        first_pivots = pivots if first_pivots is None else first_pivots
        found = _verify(pivots.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")), sets)
        links = found if links is None else links.union(found)
        comps = written(components(links))
    places = written(_blocked(sets, first_pivots, comps))
    crossing = _with_places(index, places).groupBy("key").applyInPandas(_crossing, "a long, b long")
    found = _verify_blocks(crossing, places, sets)
    links = links.union(found)
    if found.limit(1).count():
        comps = written(components(links))
    # the smallest id of every set, then of every component with links, whose sets may be many: salted
    own_id = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("__least"))
    linked = written(comps.join(own_id, "node"))
    least = linked.groupBy("comp").agg(F.min("__least").alias("__first"))
    named = salted_join(linked.select("node", "comp"), least, ["comp"])
    out = rows.join(own_id, "node", "left").join(named, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    columns = ["doc_id", "h", "n", "comp", F.coalesce("__first", "__least", "doc_id").alias("component_id")]
    if count_links:
        copies = written(rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies")))
        own = places.select("node", F.col("node").alias("comp"), "block")
        meeting = _with_places(index, own).groupBy("key").applyInPandas(_meeting, "a long, b long")
        weighed = places.join(copies, "node").select("node", F.col("copies").alias("comp"), "block")
        others = _compared(meeting, weighed, sets).select("a", "b", "p", "s", "q", "t").mapInArrow(
            _counted_blocks, "node long, others long").groupBy("node").agg(F.sum("others").alias("others"))
        counts = written(copies.join(others, "node", "left").select(
            "node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
        out = out.join(counts, "node", "left")
        columns.append(F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.select(*columns), links


def dropped_copies(rows: DataFrame) -> DataFrame:
    """doc_id and h of the documents that go when the first of each component stays, and ``spare``.

    ``rows`` is what ``near_duplicates`` returns. The first is the one with the
    smallest doc_id (null last) and hash. ``spare`` marks an id and hash that one
    row must keep while equal rows go.
    """
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))
    same = written(rows.filter("comp is not null").groupBy("comp", "doc_id", "h").agg(F.count("*").alias("n")))
    first = same.groupBy("comp").agg(F.min(place).alias("first"))
    spare = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    return same.join(first, "comp").withColumn("spare", spare).filter(~F.col("spare") | (F.col("n") > 1)).groupBy(
        "doc_id", "h").agg(F.max("spare").alias("spare"))
