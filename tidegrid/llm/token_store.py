"""Token files with direct access to every token.

An id is cut into chunks, low bits first. Level 0 holds the first chunk of
every id, level 1 the second chunk of the ids that go on, and so on. Beside a
level stands a bitmap with a bit for each chunk that is continued, and a rank
directory with the set bits before every 512. Token i is read from level 0 at
i; if its bit is set, the next chunk is at the rank of i in the next level.

A segment holds consecutive documents in ascending doc_id order:
``DAC1``, the length of a JSON header, the header, and the arrays it lists.
"""

from __future__ import annotations

import codecs
import json
import os
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm import packed as P
from tidegrid.llm.common import TEXT_ROWS
from tidegrid.session import arrow_rows, shared_dir, written

#: Bits of the levels; ids of byte_bpe_50k are below 2**16. Levels of whole bytes need no packing.
WIDTHS = (8, 8)
RANK_EVERY = 512
#: Tokens that close a segment; a longer document has a segment of its own.
SEGMENT_TOKENS = 2_000_000
END_ID = 2
#: Pieces whose ids a worker remembers, and the bytes of the longest of them.
CACHE_PIECES, CACHE_BYTES = 200_000, 100
#: Bytes of the texts that are looked up together.
GROUP_BYTES = 1_000_000
#: Letters of which a piece may be to go to the model directly, and marks that start a piece after such a letter.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
MARKS = ".,;:!?*#$%&"
#: Neighbouring white space, as Unicode has it.
BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
TOKENIZER = "byte_bpe_50k.json"


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    if width == 8:
        return values.astype(np.uint8)
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")


def _unpack_bits(buf: np.ndarray, width: int, n: int) -> np.ndarray:
    if width == 8:
        return buf[:n].astype(np.uint32)
    bits = np.unpackbits(buf, count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def encode_segment(doc_ids: list, sizes: list[int], tokens: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The bytes of a segment; a null id is marked in a mask."""
    if len(tokens) and int(tokens.max()) >= 1 << sum(widths):
        raise ValueError(f"id {int(tokens.max())} needs more than {sum(widths)} bits")
    arrays = [("ids", np.array([d or 0 for d in doc_ids], dtype="<i8")),
              ("null", np.packbits([d is None for d in doc_ids], bitorder="little")),
              ("starts", np.concatenate([[0], np.cumsum(sizes)]).astype("<i8"))]
    rest, levels = tokens.astype(np.uint32), []
    for k, width in enumerate(widths):
        more = (rest >> np.uint32(width)) > 0 if k + 1 < len(widths) else np.zeros(len(rest), dtype=bool)
        levels.append(len(rest))
        arrays.append((f"chunks{k}", _pack_bits(rest & np.uint32((1 << width) - 1), width)))
        if k + 1 < len(widths):
            blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_EVERY)) if len(more) else np.empty(0)
            arrays.append((f"more{k}", np.packbits(more, bitorder="little")))
            arrays.append((f"rank{k}", np.concatenate([[0], np.cumsum(blocks)]).astype("<u4")))
        rest = rest[more] >> np.uint32(width)
    head = json.dumps({"docs": len(doc_ids), "widths": list(widths), "levels": levels,
                       "arrays": [[n, a.dtype.str, a.nbytes] for n, a in arrays]}).encode()
    return b"".join([b"DAC1", len(head).to_bytes(4, "little"), head, *[a.tobytes() for _, a in arrays]])


class Segment:
    """A segment's bytes, read in place."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"DAC1":
            raise ValueError("not a token segment")
        to = 8 + int.from_bytes(raw[4:8], "little")
        self.head = json.loads(raw[8:to])
        self.arrays = {}
        for name, dtype, size in self.head["arrays"]:
            self.arrays[name] = np.frombuffer(raw[to : to + size], dtype=dtype)
            to += size
        self.starts = self.arrays["starts"]
        null = np.unpackbits(self.arrays["null"], count=self.head["docs"], bitorder="little")
        self.doc_ids = [None if x else int(d) for d, x in zip(self.arrays["ids"], null, strict=True)]

    def _chunk(self, level: int, i: int) -> int:
        width = self.head["widths"][level]
        low, to = i * width // 8, ((i + 1) * width + 7) // 8
        return int.from_bytes(self.arrays[f"chunks{level}"][low:to].tobytes(), "little") >> (i * width % 8) & ((1 << width) - 1)

    def token(self, i: int) -> int:
        """Token ``i``: at most one chunk per level, a bit and a rank are read."""
        value = shift = level = 0
        while True:
            value |= self._chunk(level, i) << shift
            shift += self.head["widths"][level]
            more = self.arrays.get(f"more{level}")
            if more is None or not more[i // 8] >> (i % 8) & 1:
                return value
            block = i // RANK_EVERY
            inside = more[block * RANK_EVERY // 8 : i // 8 + 1].copy()
            inside[-1] &= (1 << (i % 8)) - 1
            i = int(self.arrays[f"rank{level}"][block]) + int(np.bitwise_count(inside).sum())
            level += 1

    def tokens(self) -> np.ndarray:
        """All tokens, level by level from the last."""
        above = None
        for k in range(len(self.head["widths"]) - 1, -1, -1):
            n, width = self.head["levels"][k], self.head["widths"][k]
            values = _unpack_bits(self.arrays[f"chunks{k}"], width, n)
            if above is not None:
                more = np.unpackbits(self.arrays[f"more{k}"], count=n, bitorder="little").astype(bool)
                values[more] |= above << np.uint32(width)
            above = values
        return above.astype("<u4")


class Encoder:
    """Ids of whole texts from the tokenizers library.

    The byte-level pre-tokenizer never joins a character with a blank after it,
    nor a letter with a mark after it, so a text without neighbouring white
    space is cut before every blank, around every line feed and between a letter
    and a mark, and equal pieces of a group of texts are encoded once. A piece of
    letters is one piece to the pre-tokenizer too, so it goes to the model
    directly. Other texts, and all texts under a tokenizer of another kind, are
    encoded whole.
    """

    def __init__(self, path: str):
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        kind = json.loads(self.tokenizer.to_str())
        splitter, added = kind["pre_tokenizer"] or {}, kind["added_tokens"]
        self.by_words = (splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True)
                         and not splitter.get("add_prefix_space") and kind["normalizer"] is None
                         and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(rf"[ \n]|^[{LETTERS}]+$", t["content"]) for t in added))
        self.marks, self.ascii, self.latin = (np.zeros(256, dtype=bool) for _ in range(3))
        self.marks[list(set(MARKS.encode()).difference(*(t["content"].encode() for t in added)))] = True
        # the pieces that were met last, and before them
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        if self.by_words:
            shown = self.tokenizer.pre_tokenizer.pre_tokenize_str
            table = ["\ufffe"] * 256  # how the model's vocabulary shows a byte
            table[ord("\n")], table[ord(" ")] = "\n", shown(" a")[0][0][:-1]
            for letter in re.findall(f"[{LETTERS}]", "".join(map(chr, range(256)))):
                for byte, char in zip(letter.encode(), shown(letter)[0][0], strict=True):
                    table[byte] = char
                (self.ascii if letter.isascii() else self.latin)[byte] = True
            self.shown = "".join(table)

    def _encode(self, texts: list[str]) -> list[bytes]:
        # the fast form leaves out character offsets, which nothing here reads
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, texts: pa.LargeStringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The pieces of the texts, over the bytes that the texts lie in, and how many are before each text and the end."""
        _, edges, body = texts.buffers()
        edges = np.frombuffer(edges, dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
        data = np.frombuffer(body or b"", dtype=np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        cut = np.zeros(len(data), dtype=bool)
        if self.by_words:
            feed = data == ord("\n")
            cut |= feed
            cut |= data == ord(" ")
            cut[1:] |= feed[:-1]
            marks = np.flatnonzero(self.marks[data])
            marks = marks[marks > 0]
            before = data[marks - 1]
            cut[marks[self.ascii[before] | (self.latin[before] & (data[marks - 2] == 0xC3))]] = True
            for i in np.flatnonzero(pc.match_substring_regex(texts, BLANKS).to_numpy(zero_copy_only=False)):
                cut[edges[i] : edges[i + 1]] = False
        cut[edges[:-1][np.diff(edges) > 0]] = True
        starts = np.flatnonzero(cut)
        places = [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]
        return pa.Array.from_buffers(pa.large_binary(), len(starts), places), np.searchsorted(starts, edges)

    def _learn(self, pieces: pa.LargeBinaryArray) -> list[bytes]:
        """The ids of each piece, by the model or, where it is not of letters only, by the whole tokenizer."""
        names, tokenize = pieces.to_numpy(zero_copy_only=False).tolist(), self.model.tokenize
        letters = (pc.match_substring_regex(pieces.cast(pa.large_string()), rf"\A ?[{LETTERS}]+\z").to_pylist()
                   if self.by_words else [False] * len(names))
        plain = [n for n, x in zip(names, letters, strict=True) if x]
        short = [n for n, x in zip(names, letters, strict=True) if not x and len(n) <= CACHE_BYTES]
        ids = dict(zip(short, self._encode([n.decode() for n in short]), strict=True))
        if plain:
            words = codecs.charmap_decode(b"\n".join(plain), "strict", self.shown)[0].split("\n")
            ids.update(zip(plain, [array("I", [t.id for t in tokenize(w)]).tobytes() for w in words], strict=True))
        self.recent.update({n: x for n, x in ids.items() if len(n) <= CACHE_BYTES})
        return [ids[n] if n in ids else self._encode([n.decode()])[0] for n in names]

    def _ids(self, pieces: pa.LargeBinaryArray) -> list[bytes]:
        """The ids of each of the distinct pieces."""
        if len(self.recent) > CACHE_PIECES // 2:
            self.older, self.recent = self.recent, {}
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.recent.get, names))
        new = []
        for i, known in enumerate(found):
            if known is None:
                known = self.older.get(names[i])
                if known is None:
                    new.append(i)
                else:
                    found[i] = self.recent[names[i]] = known
        if new:
            for i, learned in zip(new, self._learn(pieces.take(pa.array(new, pa.int64()))), strict=True):
                found[i] = learned
        return found

    def encode_all(self, texts: pa.Array | list) -> list[bytes]:
        """The ids of every text, little-endian and 32 bits each; null is empty."""
        if not len(texts):
            return []
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        pieces, firsts = self._pieces(pc.fill_null(texts, ""))
        if not len(pieces):
            return [b""] * len(texts)
        coded = pieces.dictionary_encode()
        ids = pa.array(self._ids(coded.dictionary), pa.large_binary()).take(coded.indices)
        edges = np.frombuffer(ids.buffers()[1], dtype=np.int64, count=len(ids) + 1)[firsts].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [raw[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder; tasks that follow one another in a worker share its pieces."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _texts(rows):
    """doc_id and text, in groups of about GROUP_BYTES bytes."""
    for batch in rows:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ids):
            to = 1 + int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES))
            yield ids[at:to], texts[at:to]
            at = to


def _write(path: str, folder: str):
    def write(rows):
        from pyarrow import fs
        from pyspark import TaskContext

        encoder = _encoder(path)
        part, seq = TaskContext.get().partitionId(), 0
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        ids, sizes, tokens, total = [], [], [], 0

        def close():
            name = f"{part:06d}-{seq:06d}.dac"
            unfinished = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(unfinished) as out:
                out.write(encode_segment(ids, sizes, np.frombuffer(b"".join(tokens), dtype="<u4")))
            store.move(unfinished, f"{root}/{name}")  # a task that runs again replaces its file by an equal one
            return P.record(part=pa.array([part], pa.int64()), seq=pa.array([seq], pa.int64()),
                            name=pa.array([name], pa.string()), docs=pa.array([len(ids)], pa.int64()),
                            tokens=pa.array([total], pa.int64()))

        for doc_ids, texts in _texts(rows):
            for doc_id, own in zip(doc_ids, encoder.encode_all(texts), strict=True):
                own += END_ID.to_bytes(4, "little")
                ids.append(doc_id)
                sizes.append(len(own) // 4)
                tokens.append(own)
                total += len(own) // 4
                if total >= SEGMENT_TOKENS:
                    yield close()
                    ids, sizes, tokens, total, seq = [], [], [], 0, seq + 1
                    P.release()
            del texts
        if ids:
            yield close()
        ids, sizes, tokens = [], [], []
        P.release()

    return write


def _read(rows):
    for batch in rows:
        for content, start in zip(batch.column("content"), batch.column("start").to_pylist(), strict=True):
            segment = Segment(content.as_py())
            edges, raw = segment.starts, segment.tokens().tobytes()
            yield P.record(
                doc_id=pa.array(segment.doc_ids, pa.int64()), start=pa.array((edges[:-1] + start).tolist(), pa.int64()),
                n_tokens=pa.array(np.diff(edges).tolist(), pa.int64()),
                ids_crc32=pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False)], pa.int64()))
            del content, segment, edges, raw
        del batch
        P.release()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Encode ``docs`` in ascending doc_id order (null last, ties by a hash of the text) into segments in ``folder``.

    Returns the manifest: name, docs, tokens and start (tokens of all segments before).
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = (docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
               .repartitionByRange(parts, F.col("doc_id").asc_nulls_last(), "h")
               .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "h").select("doc_id", "text"))
    with arrow_rows(spark, TEXT_ROWS):
        manifest = written(ordered.mapInArrow(_write(str(tokenizer), folder), "part long, seq long, name string, docs long, tokens long"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts_first = manifest.groupBy("part").agg(F.sum("tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("first"))  # a row for each partition
    return (manifest.withColumn("before", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(parts_first, "part")
            .select("name", "docs", "tokens", (F.col("first") + F.col("before")).alias("start")))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    spark = manifest.sparkSession
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder)
             .select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"))
    return files.join(manifest.select("name", "start"), "name").select("content", "start").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the ids of every whole text, with the end id, and read them back.

    Null text is empty; rows with equal ids are documents of their own; an
    empty table gives none; other columns are not read. A long text is one
    document of one segment.
    """
    if not docs.limit(1).count():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    folder = folder if ":" in folder else f"file://{folder}"
    return read_tokens(write_tokens(docs, folder, tokenizer), folder)
