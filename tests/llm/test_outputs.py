"""Mixing, sharding, token files and tool calls: exact properties, round trips and odd rows."""

from __future__ import annotations

import json
import math
import random
import struct
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegrid.llm import packed, token_store
from tidegrid.llm.chat import TOOLS, calls_of, canonical, link_calls, other_turns, problems
from tidegrid.llm.mixing import mix_counts, mix_texts, permuted, whole_copies
from tidegrid.llm.sharding import assign_shards, shard_of, standard_tree, write_shards
from tidegrid.llm.token_store import Encoder, Segment, encode_segment, read_tokens, stored_tokens, write_tokens
from tidegrid.session import shared_dir, written

SCHEMA = "doc_id long, text string, source string, size string, start int, slot int, weight int"
ODD = [None, "", " ", "\n\n a  b \t c\n", "one two", "<|endoftext|> inside", "a\nb c\n", "nul\0 byte \0x", "é ü ß 你好 🙂",
       "tab\tand\x0bvertical", " leading", "trailing ", "it's we'll 12345 !!??"]


@pytest.fixture(scope="module")
def rows():
    texts = ODD + [" ".join(f"w{(i * j) % 97}" for j in range(5 + 7 * (i % 40))) for i in range(300)] + ["long " * 30_000]
    sources = ["b", "a", None, "Z", "é", ""]
    out = [(i, t, sources[min(i % 11, 5)], "s", 1, 2, 3) for i, t in enumerate(texts)]
    return out + [out[20], (None, "nameless row", "a", "", 0, 0, 0), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def count(text):
    return len((text or "").encode().split())


def test_mix_meets_its_targets(docs, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += count(r[1])
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, total, free = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not above:
            break
        target |= {s: 2.0 * sizes[s] for s in above}
        free -= above
    target |= {s: level * weight[s] for s in free}
    got = mix_counts(docs).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        assert sum(w for _, w in r.shard_words) == r.taken and all(0 <= s < 64 and w > 0 for s, w in r.shard_words)
    assert len({s for r in got for s, _ in r.shard_words}) == 64  # the draw spreads the words over the shards
    for s in order:
        assert abs(taken[s] - target[s]) <= 128
    again = mix_counts(docs.repartition(5)).collect()
    key = lambda r: repr((r.doc_id, r.size, r.taken))
    assert sorted(map(key, got)) == sorted(map(key, again))
    words = defaultdict(int)
    for r in mix_texts(docs).collect():
        words[r.doc_id] += count(r.text)
    want = defaultdict(int)
    for r in got:
        want[r.doc_id] += r.taken
    assert {k: v for k, v in want.items() if v} == dict(words)


def test_whole_copies_miss_a_source_by_less_than_a_document(docs):
    counts = mix_counts(docs).cache()
    rows = counts.collect()
    copies = {r.h: r for r in whole_copies(counts).collect()}
    size = {r.h: (r.source, r.size) for r in rows if r.size}
    assert set(copies) == set(size)
    for source in {r.source for r in rows}:
        taken = sum(r.taken for r in rows if r.source == source)
        whole = sum(copies[h].times * n for h, (s, n) in size.items() if s == source)
        assert abs(whole - taken) <= max((n for s, n in size.values() if s == source), default=0)
    assert all(0 <= r.times <= 2 * r.rows for r in copies.values())
    assert {(r.h, r.times) for r in whole_copies(mix_counts(docs.repartition(7))).collect()} == {(r.h, r.times) for r in copies.values()}


def test_every_document_may_be_a_source_of_its_own(spark):
    frame = spark.createDataFrame([(i, "w " * (1 + i % 5), f"s{i:05d}" if i else None) for i in range(3000)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mix_counts(frame).collect()}
    turns = [got[i].target / got[i].size for i in sorted(got, key=lambda i: (i == 0, i))]
    assert all(t == pytest.approx(2.0) for t in turns[::3]) and len({round(t * 1000) for t in turns[2::3]} - {2000}) >= 1


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutations_hit_every_block_once(spark, n):
    k = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(0)).alias("k")).collect()
    assert sorted(r.k for r in k) == list(range(n))


def test_shards(spark, docs, rows):
    got = assign_shards(docs).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = assign_shards(spark.range(48_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")))
    sizes = {r.shard: r["count"] for r in many.groupBy("shard").count().collect()}
    assert len(sizes) == 24 and max(sizes.values()) < 1.12 * 2000 and min(sizes.values()) > 0.88 * 2000
    moved = many.filter("grown_shard != shard").count()
    assert 0.85 * 48_000 / 25 < moved < 1.15 * 48_000 / 25


def descended(key, tree):
    """The shard of a key, by a walk down the tree with the hash that Spark documents (seed 42, chained, nulls passed over)."""

    def winner(level, parent, weights):
        scores = []
        for child, weight in enumerate(weights):
            h = 42
            for part in (level.encode(), struct.pack("<q", parent), struct.pack("<i", child), None if key is None else struct.pack("<q", key)):
                h = h if part is None else xxhash.xxh64_intdigest(part, seed=h)
            scores.append((-math.log(((h >> 11) + 0.5) / 2**53) / weight, child))
        return min(scores)[1]

    region = winner("region", 0, [sum(map(sum, r)) for r in tree])
    rack = winner("rack", region, [sum(r) for r in tree[region]])
    number = sum(len(r) for r in tree[:region]) + rack
    shard = winner("shard", number, tree[region][rack])
    return sum(len(r) for r in [r for region in tree for r in region][:number]) + shard


def test_descent_equals_a_walk_down_the_tree(spark, docs, rows):
    got = [(r.doc_id, r.shard, r.grown_shard) for r in assign_shards(docs).collect()]
    walk = lambda key: (key, descended(key, standard_tree(24)), descended(key, standard_tree(25, 24)))
    assert sorted(map(repr, got)) == sorted(repr(walk(r[0])) for r in rows)
    uneven = [[[1.0, 3.0], [0.5]], [[2.0], [1.0, 1.0, 4.0]], [[0.25]]]
    for r in shard_of(spark.range(3000), "id", uneven, "shard").collect():
        assert r.shard == descended(r.id, uneven)


def test_weights_move_rows_only_into_their_subtree(spark):
    tree = standard_tree(24)
    heavier = [[[2.0 if (i, j, k) == (1, 2, 3) else w for k, w in enumerate(rack)] for j, rack in enumerate(region)]
               for i, region in enumerate(tree)]
    rows = shard_of(shard_of(spark.range(20_000), "id", tree, "a"), "id", heavier, "b").filter("a != b").collect()
    assert rows and all(r.b // 12 == 1 for r in rows)  # into the region with the heavier shard
    assert all(r.b // 4 == 5 for r in rows if r.a // 12 == 1)  # inside it, into its rack
    assert all(r.b == 23 for r in rows if r.a // 4 == 5)  # inside that, into the shard


def test_written_shards_hold_every_row(spark, docs, rows):
    path = f"{shared_dir(spark)}/shards-test"
    write_shards(docs, path)
    assert spark.read.parquet(path).count() == len(rows)


def test_tokens_round_trip(spark, docs, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    encoded = [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows]
    got = sorted(stored_tokens(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is None, x))
    for r in got:
        assert r.start == at
        at += r.n_tokens
        want.append((r.doc_id, r.n_tokens, r.ids_crc32))
    crc = [(d, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for d, ids in encoded]
    assert sorted(map(repr, want)) == sorted(map(repr, crc))


def test_words_are_encoded_as_in_their_text():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, tokenizer = Encoder(path), Tokenizer.from_file(path)
    parts = [" ", "\n", "\t", "a", "Été", "ÿ", "ª", "1", ".", ",", "'s", " the", "ing", "漢", "\x85", "\xa0", "\0", "<|endoftext|>"]
    pick = np.random.default_rng(5)
    texts = ["".join(parts[i] for i in pick.integers(0, len(parts), n)) for n in pick.integers(0, 14, 20_000)]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode_all(texts) == want
    assert encoder.encode_all(texts[::-1]) == want[::-1]


def counted(encoder):
    """The texts that the encoder gives to the model or to the tokenizer from now on."""
    calls, model, whole = [], encoder.model, encoder._encode
    encoder.model = SimpleNamespace(tokenize=lambda w: calls.append(w) or model.tokenize(w))
    encoder._encode = lambda texts: calls.extend(texts) or whole(texts)
    return calls


def test_words_with_marks_are_encoded_once():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, tokenizer = Encoder(path), Tokenizer.from_file(path)
    calls = counted(encoder)
    texts = [f"{w}{m} {w}" for w in ("heron", "Été", "maß") for m in (".", ",", "!!", "***", "$$$", "%%%", "&&&", "###")]
    assert encoder.encode_all(texts) == [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(calls) == 6 + 8


def test_words_met_again_are_remembered(monkeypatch):
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    calls = counted(encoder)
    monkeypatch.setattr(token_store, "CACHE_PIECES", 40)
    spell = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    for i in range(50):
        encoder.encode_all(["again and again " + " ".join(spell(1000 + 10 * i + j) for j in range(10)), "base64/" * 20])
        assert len(encoder.recent) + len(encoder.older) <= 40 + 2 * 14
    assert calls.count("again") == calls.count("\u0120and") == 1
    assert not any(len(piece) > 100 for piece in [*encoder.recent, *encoder.older])


def test_pieces_are_encoded_as_in_their_text():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, tokenizer = Encoder(path), Tokenizer.from_file(path)
    assert [c for c in map(chr, range(0x3100)) if pc.match_substring_regex(pa.array([c * 2]), token_store.BLANKS)[0].as_py()] == \
        [c for c in map(chr, range(0x3100)) if c.isspace()]
    parts = [" ", "\n", "\x1c", "\u2028", "b", "é", "Ã", "×", "÷", "…", "ℓ", "7", ".", "***", "$", "&", "|", "#", "'", "'re", " 's", "<|endoftext|>", "endoftext", "🙂", "x" * 120]
    pick = np.random.default_rng(6)
    texts = ["".join(parts[i] for i in pick.integers(0, len(parts), n)) for n in pick.integers(0, 12, 20_000)]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode_all(texts) == want
    assert encoder.encode_all(pa.array([None, *texts, None])[7:]) == [*want, b""][6:]
    assert encoder.encode_all([]) == [] and encoder.encode_all([None, ""]) == [b"", b""]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    kind = json.loads(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).to_str())
    texts = ["a.b heron. a.b\n", " x y ", "heron, heron", "<|endoftext|>.", ""]
    for change in ({"pre_tokenizer": kind["pre_tokenizer"] | {"add_prefix_space": True}}, {"normalizer": {"type": "Lowercase"}},
                   {"added_tokens": kind["added_tokens"] + [kind["added_tokens"][0] | {"id": 50257, "content": "a.b"}]},
                   {"added_tokens": kind["added_tokens"] + [kind["added_tokens"][0] | {"id": 50257, "content": "x y"}]},
                   {"added_tokens": kind["added_tokens"] + [kind["added_tokens"][0] | {"id": 50257, "content": "ero"}]},
                   {"added_tokens": [kind["added_tokens"][0] | {"content": "heron", "lstrip": True}]}):
        path = tmp_path / "tokenizer.json"
        path.write_text(json.dumps(kind | change))
        tokenizer = Tokenizer.from_file(str(path))
        want = [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert Encoder(str(path)).encode_all(texts) == want


@pytest.mark.parametrize("widths", [(8, 8), (9, 7), (4, 4, 4, 4), (16,)])
def test_every_token_is_addressable(widths):
    rng = np.random.Generator(np.random.PCG64(3))
    tokens = (rng.pareto(0.4, 5000) % 50_257).astype(np.uint32)
    segment = Segment(encode_segment([5, None, 9], [0, 4000, 1000], tokens, widths))
    assert segment.doc_ids == [5, None, 9] and segment.starts.tolist() == [0, 0, 4000, 5000]
    assert (segment.tokens() == tokens).all()
    assert [segment.token(i) for i in range(len(tokens))] == tokens.tolist()
    with pytest.raises(ValueError):
        encode_segment([1], [1], np.array([1 << sum(widths)], dtype=np.uint32), widths)


def test_token_files_are_read_again(spark, docs, rows):
    folder = f"file://{shared_dir(spark)}/tokens-test"
    manifest = write_tokens(docs, folder)
    assert manifest.agg(F.sum("docs")).first()[0] == len(rows)
    assert read_tokens(manifest, folder).count() == len(rows)


def test_token_tasks_hold_few_texts(spark, docs, monkeypatch):
    """Texts come to Python in small batches, and a worker gives back what it freed after each segment and at its end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, during = spark.conf.get(key), []
    many = spark.range(5000, numPartitions=1).mapInArrow(
        lambda rows: (pa.RecordBatch.from_pydict({"id": [r.num_rows]}) for r in rows), "id long")

    def noted(df):
        during.append(written(many).agg(F.max("id")).first()[0])
        return written(df)

    monkeypatch.setattr(token_store, "written", noted)
    write_tokens(docs, f"file://{shared_dir(spark)}/tokens-few")
    assert during == [1000] and spark.conf.get(key) == before


def test_token_tasks_release_memory(tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(packed, "release", lambda: calls.append(1))
    monkeypatch.setattr(token_store, "SEGMENT_TOKENS", 100)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    rows = [pa.RecordBatch.from_pydict({"doc_id": [2 * i, 2 * i + 1], "text": ["some words " * 60, None]}) for i in range(3)]
    write = token_store._write(str(public_tokenizers.path("byte_bpe_50k.json")), f"file://{tmp_path}/t")
    assert [r.column("docs").to_pylist() for r in write(iter(rows))] == [[1], [2], [2], [1]] and len(calls) == 4
    calls.clear()
    files = [f.read_bytes() for f in sorted((tmp_path / "t").iterdir())]
    back = list(token_store._read(iter([pa.RecordBatch.from_pydict({"content": [f], "start": [0]}) for f in files])))
    assert [d for r in back for d in r.column("doc_id").to_pylist()] == list(range(6)) and len(calls) == 4


def test_empty_tables_give_none(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_counts(empty).count() == assign_shards(empty).count() == stored_tokens(empty).count() == 0


CALLS = "conv_id long, call_id string, turn long, name string, arguments string, refers array<string>, json string"


def test_calls_are_linked_ordered_and_checked(spark):
    good = '{"limit": 5, "query": "é x"}'
    calls = spark.createDataFrame([
        (1, "c", 1, "search", good, ["b", "a"], "x"), (1, "b", 3, "search", good, ["a"], "x"), (1, "a", 5, "search", good, [], "x"),
        (1, "a", 9, "lookup", "{}", None, "x"), (1, "d", 0, "search", '{"limit": 0, "more": 1}', ["zz"], "x"),
        (2, "p", 1, "search", good, ["q"], "x"), (2, "q", 2, "search", good, ["p"], "x"), (2, "r", 3, "search", "{", ["q"], "x"),
        (2, "s", 4, "who", "null", None, "x"), (None, "a", None, None, None, None, None), (3, None, 1, "search", good, [], "x"),
        (4, "self", 1, "search", good, ["self"], "x")], CALLS)
    results = spark.createDataFrame([(1, "a", 6, "first"), (1, "a", 7, "later"), (2, "p", 5, None), (9, "a", 1, "lost")],
                                    "conv_id long, call_id string, turn long, content string")
    got = {(r.conv_id, r.call_id): r for r in link_calls(calls, results).collect()}
    assert len(got) == 10
    assert [got["1", c].position for c in "dabc"] == [0, 1, 2, 3] and [got["1", c].level for c in "dabc"] == [0, 0, 1, 2]
    assert got["1", "a"].copies == 2 and json.loads(got["1", "a"].json)["result"] == "first"
    assert got["1", "d"].dangling == 1 and got["1", "d"].errors == "$.query: missing; $.limit: below minimum; $.more: unknown"
    assert {c: got["2", c].level for c in "pqrs"} == {"p": -1, "q": -1, "r": -1, "s": 0} and got["2", "s"].position == 0
    assert got["2", "p"].linked and got["2", "r"].errors == "$: not JSON" and got["2", "s"].errors == "$: unknown tool"
    assert got["4", "self"].level == -1 and not got["", "a"].valid
    assert got["1", "b"].json == '{"arguments":{"limit":5,"query":"é x"},"id":"b","name":"search","refers":["a"],"result":null}'
    assert link_calls(calls.limit(0), results.limit(0)).count() == 0


def test_links_equal_brute_force(spark):
    rng = random.Random(7)
    calls, results = [], []
    for conv in [*range(40), None]:
        n = rng.randint(1, 14)
        for i in range(n):
            earlier = rng.random() < 0.8  # else references go anywhere, so some close a cycle
            pool = [f"c{j}" for j in range(i if earlier else n)] + ["gone"]
            refers = rng.choices(pool, k=rng.randint(0, 3)) if rng.random() < 0.8 else None
            for turn in rng.sample(range(1000), 1 if rng.random() < 0.9 else 2):
                calls.append((conv, f"c{i}", turn, rng.choice(["search", "lookup", "measure", "none"]),
                              json.dumps({"query": "x" * rng.randint(0, 70), "limit": rng.randint(0, 130)}), refers, "x"))
            for turn in rng.sample(range(1000), rng.choice([0, 1, 1, 2])):
                results.append((conv, f"c{i}", turn, rng.choice([None, "é", "out"])))
    want = {}
    for conv in {c[0] for c in calls}:
        mine = [c for c in calls if c[0] == conv]
        first = {name: min((c for c in mine if c[1] == name), key=lambda c: c[2]) for name in {c[1] for c in mine}}
        needs = {name: {r for r in c[5] or [] if r in first} for name, c in first.items()}
        level = {}
        while free := [name for name in first if name not in level and needs[name] <= level.keys()]:
            level |= {name: 1 + max((level[r] for r in needs[name]), default=-1) for name in free}
        order = sorted(first, key=lambda name: (name not in level, level.get(name, 0), first[name][2], name))
        for name, c in first.items():
            answers = sorted((r for r in results if r[:2] == (conv, name)), key=lambda r: r[2])
            found = problems(json.loads(c[4]), TOOLS[c[3]]) if c[3] in TOOLS else ["$: unknown tool"]
            line = {"arguments": json.loads(c[4]), "id": name, "name": c[3], "refers": sorted(c[5] or []),
                    "result": answers[0][3] if answers else None}
            want["" if conv is None else str(conv), name] = (
                c[2], c[3], order.index(name), level.get(name, -1), bool(answers), len(set(c[5] or []) - first.keys()),
                sum(x[1] == name for x in mine), not found, "; ".join(found), canonical(line))
    frames = spark.createDataFrame(calls, CALLS).repartition(4), spark.createDataFrame(
        results, "conv_id long, call_id string, turn long, content string").repartition(3)
    got = {(r.conv_id, r.call_id): (r.turn, r.name, r.position, r.level, r.linked, r.dangling, r.copies, r.valid, r.errors, r.json)
           for r in link_calls(*frames).collect()}
    assert got == want
    assert {-1, 0, 1, 2} <= {w[3] for w in want.values()}


def test_calls_of_conversations_come_in_order(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(12)] + [(None, 1, None, None), (2, 1, "assistant", None)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    calls, results = calls_of(frame)
    got = {r.call_id: r for r in link_calls(calls, results).filter("conv_id = '1'").collect()}
    assert [got[f"call-{t}"].level for t in (1, 3, 5, 7, 9, 11)] == [0, 1, 1, 2, 2, 2]
    assert json.loads(got["call-3"].json)["result"] == "text 4" and not got["call-11"].linked


def test_every_turn_is_shown_whole(spark):
    long = " ".join(f"word{i}" for i in range(40))
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", f"first {long}"), (1, 2, "assistant", f"call {long}"), (1, 3, "user", f"answer {long}"),
             (1, 4, "user", "again"), (1, 4, "user", "again"), (1, 5, "assistant", "b one"), (1, 5, "assistant", "a \u00e9 \"two\""), (1, 6, "user", "y"),
             (1, 6, "user", "x"), (1, 7, "tool", " out\n"), (1, None, "assistant", "no number"), (1, 8, None, "no role"), (2, 0, "user", "only one"),
             (None, 1, "assistant", "nowhere"), (None, 2, "user", None)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    linked, other = link_calls(*calls_of(frame)).collect(), other_turns(frame).collect()
    shown = []
    for r in linked:
        line = json.loads(r.json)
        shown += [(r.conv_id, r.turn, "assistant", line["arguments"]["query"])]
        shown += [(r.conv_id, r.turn + 1, "user", line["result"])] if r.linked else []
    lines = [(r, json.loads(r.json)) for r in other]
    assert all(r.call_id is None and r.turn == line["turn"] for r, line in lines)
    shown += [(r.conv_id, r.turn, line["role"], line["text"]) for r, line in lines]
    want = {("" if c is None else str(c), *rest) for c, *rest in turns}
    assert sorted(map(repr, shown)) == sorted(map(repr, want))
    assert [r.copies for r, line in lines if line["text"] == "again"] == [2]
    assert other_turns(frame.limit(0)).count() == 0


def test_schemas_and_canonical_json():
    schema = {"type": "array", "items": {"type": "string", "enum": ["a", "b"], "minLength": 1}}
    assert problems(["a", 3, "c"], schema) == ["$[1]: not string", "$[2]: not in enum"]
    assert problems(True, {"type": "integer"}) == ["$: not integer"]
    assert canonical({"b": [1, {"z": None, "a": "ß"}], "a": 1}) == '{"a":1,"b":[1,{"a":"ß","z":null}]}'
    with pytest.raises(ValueError):
        canonical(float("nan"))
