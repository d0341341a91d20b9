"""Periodic runs, the conversation trie and url filters against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidegrid.llm.runs import find_runs, periodic_runs
from tidegrid.llm.trie import conversation_paths, prefix_trie, splitters
from tidegrid.llm.urls import RULES, judge_urls, rules_table


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(x):
    least = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i - s + q >= max(24, 3 * q):
                least.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    k, n = rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 23, 24, 30, 60, 200])
    x = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        unit = [rng.randrange(k) for _ in range(rng.randint(1, 20))]
        at = rng.randint(0, len(x))
        x[at:at] = (unit * rng.randint(2, 12))[: rng.randint(1, 12 * len(unit))]
    return x


@pytest.mark.parametrize("seed", range(60))
def test_runs_by_grammar_equal_plain_search(seed):
    rng = random.Random(seed)
    docs = [repetitive(rng) for _ in range(rng.randint(1, 12))]
    assert find_runs([np.array(d, dtype=np.int64) for d in docs]) == [plain_runs(d) for d in docs]


def test_run_digests_and_odd_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a " * 23, "a " * 24, "x\ty\x0bz\n" * 9 + "é", "long " * 300_000, "one\x00two " * 30]
    texts += [" ".join(f"w{i}" for i in repetitive(rng)) for _ in range(120)]
    rows = [(i, t, i, "s") for i, t in enumerate(texts)] + [(5, texts[5], 0, None), (None, texts[5], 0, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, start string").repartition(3)
    got = [r for r in periodic_runs(docs, rewrite=True).collect()]
    want = []
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            a, g = h // 10 % len(words), h // 10
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        runs = plain_runs(words) if len(words) < 10_000 else [(0, len(words), 1)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        want.append((doc_id, len(words), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept)))
    assert sorted(repr(tuple(r)[:9]) for r in got) == sorted(map(repr, want))
    assert sum(r.n_runs for r in got) > 40
    assert periodic_runs(docs.limit(0)).collect() == []


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, role or "", digest, text or ""))
    turns = {c: [(r[2], r[4]) for r in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        cost = (len(m) - 1) * (len(p[-1][1].encode().split()) if p else 0)
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += cost
    return sorted(repr((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
                        sha(",".join(map(str, ends[p]))))) for p, m in members.items())


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), 150):
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([turn, turn, turn, None, 0]), rng.choice(["user", "assistant", None, ""]),
                         rng.choice(["hello", "hello you", "", None, "a b\tc", "what?"])))
    rows += [(500 + c, t, "user", f"same {t}") for c in range(120) for t in range(4)]  # copies
    rows += [(900, t, "user", f"word {t % 3}") for t in range(150)]  # a long one
    return rows + rows[:7] + [(None, 1, "user", "nobody"), (None, None, None, None)]


@pytest.mark.parametrize(("seed", "shard_turns"), [(1, 20_000), (1, 40), (2, 8), (3, 300)])
def test_trie_equals_plain_python(spark, seed, shard_turns):
    rows = conversations(seed)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  "conv_id long, turn long, role string, text string, path string, depth int").repartition(5)
    paths = conversation_paths(table)
    assert bool(splitters(paths, shard_turns)) == (shard_turns < 500)
    assert sorted(repr(tuple(r)) for r in prefix_trie(paths, shard_turns).collect()) == plain_trie(rows)


def test_trie_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie(conversation_paths(spark.createDataFrame([], schema))).collect() == []
    rows = [(7, 1, "user", "only")]  # crc32 of 7 takes the first turns of an absent conversation
    got = prefix_trie(conversation_paths(spark.createDataFrame(rows, schema))).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_trie(rows)


URLS = [None, "", "no scheme", "://", "http://NET/", "http://net", "http://a.net?x=/", "http://xnet/", "HTTP://A.Example.NET/en/1?q#f",
        "http://example.net/EN/", "http://a.b.example.com/de/", "http://example.com/de", "http://a.org/fr/x/y/z", "http://org:80/fr/",
        "x://y://net/", "http://.net/", "http://net./", "http://É.net/é/ß", "http://a.net#/", "http://a\nb.net/c\nd",
        "http://" + "a." * 20_000 + "net/" + "b/" * 20_000]


def plain_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark, 1)[0]
    path = rest[len(host):].split("?", 1)[0].split("#", 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), a, h + p) for a, h, p in rules
            if h and (not p or p[0] == "/") and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[1] if best else "allow"


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_urls_equal_plain_python(spark, seed):
    rules, urls = list(RULES), list(URLS)
    if seed:
        rng = random.Random(seed)
        host = lambda: ".".join(rng.choice(["a", "b", "net", "org"]) for _ in range(rng.randint(1, 4)))
        path = lambda: "".join("/" + rng.choice(["", "x", "xy", "en"]) for _ in range(rng.randint(0, 4)))
        rules = [(rng.choice(["allow", "block"]), host(), path()) for _ in range(80)] + [("allow", "", "/"), ("block", "a", "x")]
        urls += [f"http://{host()}{path()}?z" for _ in range(500)]
    rows = [(i, u, 1, "r") for i, u in enumerate(urls)] + [(None, urls[4], 0, None)] * 3 + [(4, urls[4], 0, None), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int, rule string").repartition(4)
    got = judge_urls(pages, rules_table(spark, rules)).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((i, *plain_url(u, rules))) for i, u, *_ in rows)


def test_urls_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert judge_urls(pages.limit(0), rules_table(spark)).collect() == []
    none = spark.createDataFrame([], "action string, host string, path string")
    assert [tuple(r) for r in judge_urls(pages, none, default="block").collect()] == [(1, "a.net", "/", None, "block")]
