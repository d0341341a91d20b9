"""The registered queries against SQL, and the pipeline against plain Python."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from oracle import compare, connect
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tidegrid.llm.registry import ORACLES, QUERIES
from tidegrid.session import written

SF_DIR = os.environ.get("TIDEGRID_LLM_SF_DIR", "/root/testdata/sf0.001")
driver_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


def test_every_operator_and_the_pipeline_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()


@driver_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    line, good = compare(spark, connect(SF_DIR), SF_DIR, name, QUERIES[name], ORACLES[name])
    assert good, line


def test_pipeline_equals_plain_python(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [prose(30) for _ in range(3)]
    clean = [prose(rng.randint(60, 200)) for _ in range(40)]
    near = [[*clean[0][:-2], "x", "y"], list(clean[1])]
    texts = [" ".join(w) for w in [*clean, *near, prose(40) + items[1] + prose(40), prose(20), ["same"] * 100]] + [None, ""]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 1) for i, t in enumerate(texts)]
    rows += [rows[5], (None, " ".join(prose(80)), None, None, 0, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)))
        seen.append((name, docs.collect()))
        if name != "token_output":
            assert docs.columns == columns
    by = dict(seen)
    ids = lambda name: sorted((r.doc_id for r in by[name]), key=lambda x: (x is None, x))
    assert ids("quality_rules") == sorted([*range(43), 5]) + [None]
    assert ids("near_duplicate_join") == [*range(40), 42, None]
    assert ids("benchmark_decontamination") == [*range(40), None]
    size = {r.doc_id: len(r.text.split()) for r in by["benchmark_decontamination"]}
    times = {d: sum(r.doc_id == d for r in by["mixing"]) for d in size}
    assert set(r.doc_id for r in by["mixing"]) <= set(size) and max(times.values()) <= 2
    from_source = lambda s: [d for d in size if d is not None and d % 3 == s]
    counts = corpus_pipeline.mix_counts(spark.createDataFrame([tuple(r) for r in by["benchmark_decontamination"]], schema)).collect()
    for s in range(3):  # every source within its largest document, and the mix within two blocks of its target
        taken = sum(r.taken for r in counts if r.source == f"src{s}")
        assert abs(sum(times[d] * size[d] for d in from_source(s)) - taken) <= max(size[d] for d in from_source(s))
        assert abs(taken - next(r.target for r in counts if r.source == f"src{s}")) <= 128
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    crc = lambda t: zlib.crc32(np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], dtype="<u4").tobytes())
    want = sorted(repr((r.doc_id, crc(r.text))) for r in by["mixing"])
    assert sorted(repr((r.doc_id, r.ids_crc32)) for r in by["token_output"]) == want
    assert {repr(tuple(r)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {
        repr(tuple(r)) for r in by["token_output"]}


def test_stages_of_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, h int, size string, __times int"
    spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None), (1, "", "en", "s", 0, 1, "x", 2), (1, "", "en", "s", 0, 1, "x", 2),
                                 (2, " \n ", "en", None, 0, 1, "x", 2)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).count() == 0 and stage(spark, empty, str(tmp_path)).columns == empty.columns
        left = stage(spark, odd, str(tmp_path))
        assert left.columns == odd.columns and left.count() == (0 if name in ("quality_rules", "mixing") else 4), name
    twins = spark.createDataFrame([(3, "one two three", lang, "s", 0, 0, "", 0) for lang in ("en", "de", "fr")], schema)
    taken = corpus_pipeline.mixing(spark, twins, str(tmp_path)).collect()  # equal id and text: copies are shared
    assert 3 <= len(taken) <= 6 and len({r.lang for r in taken}) == 3
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0


def test_decontamination_keeps_clean_rows_of_a_shared_id(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    item = prose(30)
    dirty = [" ".join(prose(20) + item + prose(20)) for _ in range(2)]
    clean = [" ".join(prose(60)) for _ in range(5)] + [None, ""]
    rows = [(None, dirty[0]), (7, dirty[1]), (7, dirty[1]), (0, clean[0])]
    rows += [(i, t) for t in clean for i in (None, 7)] + [(None, clean[1])]
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(repr(tuple(r)) for r in kept) == sorted(repr(r) for r in rows if r[1] not in dirty)
