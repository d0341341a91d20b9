"""Words, hashes and byte layouts for operators that ship packed batches of documents.

A batch is a few megabytes of whole documents, words joined by one space and
documents by a line feed (a word holds neither). Tasks work on one batch or one
bucket at a time with numpy; Spark moves one row per batch and bucket.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text and number of documents that close a batch; a longer document is a batch of its own.
BATCH_BYTES, BATCH_DOCS = 8_000_000, 60_000
_STEP = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20))
_TABLE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_ODD = _rng.integers(1, 2**63 - 1, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < size:
        base = int(_ODD[-1 - which])
        size = max(size, _STEP)
        pair = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            pair.append(np.cumprod(a, dtype=np.uint64))
        have = _powers[which] = (pair[0], pair[1])
    return have


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Hashes of the slices values[start:end], by differences of one running sum."""
    up, down = powers(which, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


class Words:
    """The words of a batch: ``doc`` numbers and 64-bit hashes, and where they stand in ``data``."""

    def __init__(self, data: bytes):
        self.data = data
        buf = np.frombuffer(data, dtype=np.uint8)
        cuts = np.flatnonzero((buf == 32) | (buf == 10))
        starts = np.concatenate([[0], cuts + 1])
        ends = np.concatenate([cuts, [len(buf)]])
        doc = np.concatenate([[0], np.cumsum(buf[cuts] == 10)]) if len(buf) else np.zeros(1, dtype=np.int64)
        real = ends > starts
        self.starts, self.ends, self.doc = starts[real], ends[real], doc[real].astype(np.int64)
        self.hashes = self._hash(buf)

    def _hash(self, buf: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        while at < len(out):  # a stretch of words at a time, so that temporary arrays stay small
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + _STEP, side="right")))
            piece = _TABLE[buf[low : self.ends[to - 1]]]
            out[at:to] = range_hashes(piece, self.starts[at:to] - low, self.ends[at:to] - low, 0)
            at = to
        return mix(out ^ (self.ends - self.starts).astype(np.uint64))

    def counts(self, docs: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=docs)


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of ``n`` words inside one document, in order."""
    size = len(words.hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        total += words.hashes[j : j + size] * _ODD[j]
    inside = words.doc[:size] == words.doc[n - 1 :]
    return mix(total[inside] ^ np.uint64(n)), words.doc[:size][inside]


def shrink(a: np.ndarray) -> bytes:
    """Compress an integer array, byte plane by byte plane."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def grow(b: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    if not size:
        return np.empty(0, dtype)
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel()


def pack(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(b, dtype=np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def slices(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """key, from and to of every run of a sorted array."""
    if len(sorted_keys):
        cuts = np.flatnonzero(np.diff(sorted_keys)) + 1
        edges = [0, *cuts.tolist(), len(sorted_keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            yield int(sorted_keys[a]), a, b


def dense(b: bytes, codec_level: int = 3) -> bytes:
    return len(b).to_bytes(8, "little") + pa.Codec("zstd", codec_level).compress(b, asbytes=True)


def undense(b: bytes) -> bytes:
    size = int.from_bytes(b[:8], "little")
    return pa.decompress(b[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def batches(batches_in: Iterator[pa.RecordBatch], lower: bool = False) -> Iterator[tuple[int, list, bytes, int]]:
    """Number, ids, packed text and documents of each batch of a task's rows (columns doc_id, text and perhaps h).

    With h, an id is the pair of doc_id and h.

    The number joins the partition and a count, so it is unique, and equal on
    a retry, since files are read in the same order again.
    """
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0
    for rows in batches_in:
        names = rows.column(0).to_pylist()
        if rows.num_columns > 2:
            names = list(zip(names, rows.column(2).to_pylist(), strict=True))
        for doc_id, text in zip(names, rows.column(1), strict=True):
            raw = text.as_py()
            raw = b"" if raw is None else raw.encode("utf-8", "surrogatepass")
            norm = b" ".join(raw.split())
            ids.append(doc_id)
            texts.append(norm.lower() if lower else norm)
            size += len(norm)
            if size >= BATCH_BYTES or len(ids) >= BATCH_DOCS:
                yield (part << 16) | seq, ids, b"\n".join(texts), len(ids)
                ids, texts, size, seq = [], [], 0, seq + 1
    if ids:
        yield (part << 16) | seq, ids, b"\n".join(texts), len(ids)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def shrink_sorted(a: np.ndarray) -> bytes:
    """Compress an ascending array of 64-bit numbers by its steps."""
    steps = np.diff(a, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + dense(planes, 1)


def grow_sorted(b: bytes) -> np.ndarray:
    width, planes = b[0], undense(b[1:])
    out = np.zeros((len(planes) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(planes, dtype=np.uint8).reshape(width, -1).T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


BATCH_SCHEMA = "batch long, ids array<long>, size long, words long, body binary"


def batch_table(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` as a table with one row per batch, texts compressed; null text has no words."""

    def pack_all(rows):
        for number, ids, data, _ in batches(rows):
            words = sum(t.count(b" ") + 1 for t in data.split(b"\n") if t)
            yield record(batch=pa.array([number], pa.int64()), ids=pa.array([ids], pa.list_(pa.int64())),
                         size=pa.array([len(data)], pa.int64()), words=pa.array([words], pa.int64()),
                         body=pa.array([dense(data)], pa.binary()))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack_all, BATCH_SCHEMA)


def release() -> None:
    """Give memory that numpy and Arrow have freed back to the system, so that an idle worker stays small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps it
        ctypes.CDLL(None).malloc_trim(0)


def bucket_bits(total_bytes: int, per_bucket: int, least: int = 6, most: int = 30) -> int:
    """Bits of a bucket number so that a bucket holds about ``per_bucket`` bytes."""
    return int(min(most, max(least, np.ceil(np.log2(max(1.0, total_bytes / per_bucket))))))
