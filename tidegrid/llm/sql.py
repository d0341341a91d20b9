"""DuckDB counterparts of the queries that SQL can express."""

WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5
      THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
x AS (SELECT doc_id, unnest(sh) AS h FROM s),
often AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
y AS (SELECT doc_id, h FROM x JOIN often USING (h)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM y a JOIN y b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b
  WHERE 100 * shared >= 75 * (len(sa.sh) + len(sb.sh) - shared)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.other)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
x AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w)),
d AS (SELECT win FROM x GROUP BY win HAVING count(*) > 1),
c AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM x JOIN d USING (win) GROUP BY doc_id),
p AS (SELECT doc_id, unnest(gone) AS i FROM c),
q AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT q.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM q ANTI JOIN p USING (doc_id, i) GROUP BY q.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

RULES = rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, {WORDS.format("text")} AS ws FROM documents),
x AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
d AS (SELECT doc_id, win FROM x GROUP BY doc_id, win HAVING count(*) > 1),
c AS (SELECT doc_id, len(list_distinct(flatten(list(range(i, i + 3))))) AS n FROM x JOIN d USING (doc_id, win) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (
  SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 20 * word_chars AS symbols_failed, n_dup_lines > 20 AS lines_failed FROM m),
h AS (
  SELECT host, rule, count(*) AS n, sum(failed::INT) AS bad
  FROM (SELECT host, unnest(['base', 'symbols', 'lines']) AS rule, unnest([base_failed, symbols_failed, lines_failed]) AS failed FROM f)
  GROUP BY host, rule),
b AS (SELECT rule, avg(bad / n) AS mean, var_pop(bad / n) AS var FROM h GROUP BY rule),
v AS (
  SELECT host, bool_and((bad + mean * strength) / (n + strength) <= 0.5) AS ok
  FROM h JOIN (SELECT rule, mean, CASE WHEN var > 1e-12 THEN greatest(10.0, mean * (1 - mean) / var - 1) ELSE 1e6 END AS strength FROM b)
    USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM f JOIN v USING (host)
"""

DECONTAMINATION = rf"""
WITH i AS (
  SELECT item_id, len(ws) AS n, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) AS bag
  FROM (SELECT item_id, {WORDS.format("lower(text)")} AS ws FROM benchmark) WHERE len(ws) >= 5),
d AS (
  SELECT doc_id, list_transform(range(1, greatest(len(ws) - 3, 1)), lambda i: array_to_string(ws[i:i + 4], ' ')) AS bag
  FROM (SELECT doc_id, {WORDS.format("lower(text)")} AS ws FROM documents)),
a AS (SELECT DISTINCT n, unnest(bag) AS h FROM i),
p AS (
  SELECT doc_id, bag, pos, n FROM (SELECT doc_id, bag, unnest(bag) AS h, unnest(range(1, len(bag) + 1)) AS pos FROM d) JOIN a USING (h)),
win AS (SELECT doc_id, pos, n, bag[pos:pos + n - 5] AS win FROM p),
ws AS (SELECT doc_id, pos, n, len(win) AS size, unnest(win) AS h FROM win),
wc AS (SELECT doc_id, pos, n, size, h, count(*) AS c FROM ws GROUP BY ALL),
ic AS (SELECT item_id, n, size, h, count(*) AS c FROM (SELECT item_id, n, len(bag) AS size, unnest(bag) AS h FROM i) GROUP BY ALL),
j AS (
  SELECT doc_id, pos, item_id, sum(least(wc.c, ic.c)) AS shared, any_value(wc.size) + any_value(ic.size) AS total
  FROM wc JOIN ic USING (n, h) GROUP BY doc_id, pos, item_id),
s AS (SELECT doc_id, item_id, pos - 1 AS start, (shared / (total - shared))::DOUBLE AS similarity FROM j)
SELECT doc_id, item_id, count(*)::BIGINT AS n_windows, max(similarity) AS similarity, arg_min(start, (-similarity, start))::BIGINT AS start
FROM s WHERE similarity >= 0.75 GROUP BY doc_id, item_id
"""

CRC32 = """xor(4294967295, list_reduce(list_transform(string_split({}::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda acc, b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(acc, b)),
  4294967295::BIGINT))"""

# Any run repeats a stretch of 16 words at its period, so equal stretches of 16 words of one text find the periods.
RUNS = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, ws, len(ws) AS n, coalesce({CRC32.format("doc_id")}, 1) AS h
  FROM (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents)),
a AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a, h // 10 AS g FROM w),
r AS (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n),
    lambda i: ws[(CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END) + 1]) ELSE ws END AS ws FROM a),
x AS (
  SELECT rid, n, i, array_to_string(ws[i + 1:i + 16], ' ') AS win
  FROM (SELECT rid, n, ws, unnest(range(n - 15)) AS i FROM r WHERE n >= 24)),
p AS (SELECT b.rid, b.i, c.i - b.i AS q FROM x b JOIN x c ON b.rid = c.rid AND b.win = c.win AND c.i > b.i AND c.i - b.i <= b.n // 3),
s AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM p),
u AS (SELECT rid, q, min(i) AS start, count(*) + 15 + q AS length FROM s GROUP BY rid, q, island),
v AS (SELECT rid, start, length, min(q) AS period FROM u WHERE length >= greatest(24, 3 * q) GROUP BY rid, start, length),
b AS (
  SELECT rid, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, (-length / period, start, period)) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM v GROUP BY rid),
d AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM v),
k AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept
  FROM (SELECT rid, unnest(ws) AS word, unnest(range(n)) AS i FROM r) ANTI JOIN d USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
  (1000 * best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM r LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)
"""

TRIE = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, {CRC32.format("conv_id")} % 4 AS h, conv_id - conv_id % 20 AS base FROM t GROUP BY conv_id),
e AS (SELECT c.*, coalesce(least(c.h, b.n), 0) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
x AS (
  SELECT e.conv_id, t.r AS d, role, text FROM e JOIN t ON t.conv_id = e.base AND t.r <= e.taken
  UNION ALL SELECT e.conv_id, t.r - e.h + e.taken, role, text FROM e JOIN t ON t.conv_id = e.conv_id AND t.r > e.h),
p AS (
  SELECT conv_id, 0 AS d, '' AS path, 0 AS words FROM e
  UNION ALL SELECT conv_id, d, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d),
    len({WORDS.format("text")}) FROM x),
m AS (SELECT conv_id, max(d) AS last FROM p GROUP BY conv_id),
u AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY path, d),
l AS (SELECT DISTINCT a.path, b.path AS child FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.d = a.d + 1),
k AS (SELECT path, count(*) AS n_children FROM l GROUP BY path),
y AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (path)),
z AS (
  SELECT p.path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * y.words) AS saved
  FROM y JOIN p ON p.conv_id = y.conv_id AND p.d <= y.d GROUP BY p.path),
f AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
  FROM p JOIN m USING (conv_id) WHERE p.d = m.last GROUP BY path),
g AS (SELECT child AS path, u.conv_id AS parent FROM l JOIN u ON u.path = l.path)
SELECT y.conv_id, y.d::BIGINT AS depth, g.parent AS parent_conv_id, y.n_convs::BIGINT AS n_convs, y.n_children::BIGINT AS n_children,
  z.n_leaves::BIGINT AS n_leaves, z.saved::BIGINT AS saved_tokens, coalesce(f.ends, sha256('')) AS ends_sha256
FROM y JOIN z USING (path) LEFT JOIN f USING (path) LEFT JOIN g USING (path)
"""

URLS = """
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(action, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (
  SELECT rid, arg_max({'a': action, 'r': rh || rp}, length(rh || rp)) AS best
  FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, best.r AS rule, coalesce(best.a, 'allow') AS verdict FROM p LEFT JOIN f USING (rid)
"""
