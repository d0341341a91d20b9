"""Queries on unions, deduplication and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.times import DAY
from tidegrid.operators import merge as ops
from tidegrid.operators.series import bounds_of, spine
from tidegrid.plans.adapters import D_SQL, M_SQL, V_SQL, days, stored_and_incoming, table, vintages
from tidegrid.plans.registry import query
from tidegrid.session import written

KEYS = ["series_id", "ts"]
START, END = "1998-06-01 00:00:00", "1999-03-01 00:00:00"
INSIDE = f"ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'"
NEAR = "abs({0}) <= 1e-12 + 1e-9 * abs({1})"

# Outcome of every cell of the merge, by plain comparisons.
CELLS_SQL = f"""{M_SQL}, j AS (
  SELECT coalesce(s.series_id, i.series_id) AS series_id, coalesce(s.ts, i.ts) AS ts, s.ts IS NOT NULL AS had, i.ts IS NOT NULL AS got,
    s.price AS p0, i.price AS p1, s.total AS t0, i.total AS t1 FROM stored s FULL JOIN incoming i ON i.series_id = s.series_id AND i.ts = s.ts),
o AS (SELECT *, CASE WHEN had AND got AND p0 IS NULL AND p1 IS NOT NULL THEN 'repaired'
    WHEN had AND got AND p1 IS NOT NULL AND NOT ({NEAR.format('p0 - p1', 'p1')}) THEN CASE WHEN {INSIDE} THEN 'revised' ELSE 'protected' END END AS po,
  CASE WHEN had AND got AND t0 IS NULL AND t1 IS NOT NULL THEN 'repaired'
    WHEN had AND got AND t1 IS NOT NULL AND NOT ({NEAR.format('t0 - t1', 't1')}) THEN CASE WHEN {INSIDE} THEN 'revised' ELSE 'protected' END END AS tot_o FROM j)"""


@query("mrg2_merge_revisions", f"""WITH {CELLS_SQL} SELECT series_id, ts, CASE WHEN NOT had OR po IN ('repaired', 'revised') THEN p1 ELSE p0 END AS price,
  CASE WHEN NOT had OR tot_o IN ('repaired', 'revised') THEN t1 ELSE t0 END AS total FROM o""")
def _(spark, d):
    stored, incoming = stored_and_incoming(spark, d)
    return ops.merge_revisions(stored, incoming, KEYS, window=(START, END), retain=True).data


AUDIT = " UNION ALL ".join(f"""SELECT '{name}' AS column_name, (SELECT count(*) FROM o WHERE NOT had) AS new_rows,
  count(*) FILTER (WHERE {c} = 'repaired') AS repaired, count(*) FILTER (WHERE {c} = 'revised') AS revised, count(*) FILTER (WHERE {c} = 'protected') AS protected,
  min(ts) FILTER (WHERE {c} = 'protected') AS first_protected, max(ts) FILTER (WHERE {c} = 'protected') AS last_protected FROM o"""
                           for name, c in (("price", "po"), ("total", "tot_o")))


@query("mrg5_merge_audit_columns", f"WITH {CELLS_SQL} {AUDIT}")
def _(spark, d):
    stored, incoming = stored_and_incoming(spark, d)
    return ops.merge_revisions(stored, incoming, KEYS, window=(START, END), retain=True).audit


@query("mrg5_merge_audit", f"""WITH {CELLS_SQL}, a AS ({AUDIT}) SELECT max(new_rows) AS new_rows, CAST(sum(repaired) AS BIGINT) AS repaired_cells, CAST(sum(revised) AS BIGINT) AS revised_cells,
  CAST(sum(protected) AS BIGINT) AS protected_conflicts, min(first_protected) AS first_protected, max(last_protected) AS last_protected, max(new_rows) + sum(repaired) + sum(revised) > 0 AS changed FROM a""")
def _(spark, d):
    stored, incoming = stored_and_incoming(spark, d)
    return ops.merge_audit(ops.merge_revisions(stored, incoming, KEYS, window=(START, END), retain=True).audit)


# Unchanged; a watermark that moves on; new rows; filled cells; revised cells inside the window.
@query("mrg6_should_rebuild", f"""WITH {D_SQL}, x AS (SELECT *, ts < TIMESTAMP '1999-06-01 00:00:00' AS old, ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}' AS inside FROM dd),
n AS (SELECT count(*) FILTER (WHERE NOT old) AS added, count(*) FILTER (WHERE old AND day(ts) % 7 = 0) AS filled, count(*) FILTER (WHERE old AND inside AND day(ts) % 5 = 0) AS revised FROM x)
SELECT name, new_rows, repaired_cells, revised_cells, watermark_advanced, rebuild FROM n, LATERAL (VALUES
  ('unchanged', 0::BIGINT, 0::BIGINT, 0::BIGINT, false, false), ('advanced', 0, 0, 0, true, true), ('new', added, 0, 0, false, true),
  ('filled', 0, filled, 0, false, true), ('revised', 0, 0, revised, false, true), ('full', 0, 0, 0, false, true)) v(name, new_rows, repaired_cells, revised_cells, watermark_advanced, rebuild)""")
def _(spark, d):
    whole = written(days(spark, d).select("series_id", "ts", "price_eur_mwh", "total"))
    stored, day = whole.filter("ts < '1999-06-01'"), F.dayofmonth("ts")
    holes = stored.withColumn("total", F.when(day % 7 != 0, F.col("total")))
    other = stored.withColumn("total", F.when(day % 5 == 0, F.col("total") + 1).otherwise(F.col("total")))
    at, out = "1999-05-31 00:00:00", None
    for name, before, after, mark, mode in (
            ("unchanged", stored, stored, at, "incremental"), ("advanced", stored, stored, "1999-06-01 00:00:00", "incremental"),
            ("new", stored, whole, at, "incremental"), ("filled", holes, stored, at, "incremental"), ("revised", stored, other, at, "incremental"),
            ("full", stored, stored, at, "full")):
        audit = ops.merge_revisions(before, after, KEYS, window=(START, END), retain=True).audit
        one = ops.should_rebuild(audit, at, mark, mode).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("mrg1_merge_strict", f"""WITH {D_SQL} SELECT series_id, ts, price_eur_mwh, total FROM dd""")
def _(spark, d):
    whole = days(spark, d).select("series_id", "ts", "price_eur_mwh", "total")
    return ops.merge_strict(whole.filter("ts < '1999-06-01'"), whole.filter("ts >= '1997-06-01'"), KEYS)


PRICE_SQL = f"""{D_SQL}, st AS (SELECT series_id, ts, price_eur_mwh AS price, CASE WHEN day(ts) % 2 = 0 THEN NULL ELSE 'PT60M' END AS resolution FROM dd WHERE ts < TIMESTAMP '1999-06-01 00:00:00'),
inc AS (SELECT series_id, ts, price_eur_mwh + CASE WHEN day(ts) = 9 THEN 1 ELSE 0 END AS price, 'PT60M' AS resolution FROM dd WHERE ts >= TIMESTAMP '1997-06-01 00:00:00')"""


def price_tables(spark, d):
    base = days(spark, d)
    day = F.dayofmonth("ts")
    stored = base.filter("ts < '1999-06-01'").select(
        "series_id", "ts", F.col("price_eur_mwh").alias("price"), F.when(day % 2 != 0, "PT60M").alias("resolution"))
    incoming = base.filter("ts >= '1997-06-01'").select(
        "series_id", "ts", (F.col("price_eur_mwh") + F.when(day == 9, 1).otherwise(0)).alias("price"), F.lit("PT60M").alias("resolution"))
    return stored, incoming


@query("mrg3_merge_prices", f"""WITH {PRICE_SQL} SELECT coalesce(st.series_id, inc.series_id) AS series_id, coalesce(st.ts, inc.ts) AS ts,
  CASE WHEN st.ts IS NULL OR (inc.ts >= TIMESTAMP '{START}' AND inc.ts < TIMESTAMP '{END}' AND day(inc.ts) = 9) THEN inc.price ELSE st.price END AS price,
  CASE WHEN st.ts IS NULL THEN inc.resolution ELSE coalesce(st.resolution, inc.resolution) END AS resolution
FROM st FULL JOIN inc ON inc.series_id = st.series_id AND inc.ts = st.ts""")
def _(spark, d):
    stored, incoming = price_tables(spark, d)
    return ops.merge_prices(stored, incoming, KEYS, window=(START, END)).data


@query("mrg3_label_conflicts", f"""WITH {PRICE_SQL} SELECT st.series_id, st.ts, 'label_conflict' AS reason FROM st JOIN inc USING (series_id, ts) WHERE st.resolution IS NOT NULL AND day(ts) = 7
UNION ALL SELECT series_id, ts, 'unknown_incoming' FROM inc WHERE day(ts) = 8""")
def _(spark, d):
    stored, incoming = price_tables(spark, d)
    day = F.dayofmonth("ts")
    odd = incoming.withColumn("resolution", F.when(day == 7, "PT15M").when(day == 8, "PT5M").otherwise(F.col("resolution")))
    return ops.label_conflicts(stored, odd, KEYS)


@query("mrg4_repair_interval", f"""WITH {M_SQL}, late AS (SELECT series_id, ts, price_eur_mwh AS price FROM dd)
SELECT s.series_id, s.ts, CASE WHEN s.ts >= TIMESTAMP '1998-03-01 00:00:00' AND s.ts < TIMESTAMP '1998-03-08 00:00:00' THEN coalesce(s.price, l.price) ELSE s.price END AS price, s.total
FROM stored s LEFT JOIN late l ON l.series_id = s.series_id AND l.ts = s.ts""")
def _(spark, d):
    stored, _incoming = stored_and_incoming(spark, d)
    late = days(spark, d).select("series_id", "ts", F.col("price_eur_mwh").alias("price"), F.col("orders").alias("extra"))
    return ops.repair_interval(stored, late, KEYS, "1998-03-01 00:00:00", "1998-03-08 00:00:00").data


REPAIR_SQL = f"""{D_SQL}, base AS (SELECT series_id, ts, price_eur_mwh AS price FROM dd),
st AS (SELECT * FROM base WHERE NOT (year(ts) = 1998 AND month(ts) = 3 AND day(ts) IN (4, 5)))"""


def repair_tables(spark, d):
    base = days(spark, d).select("series_id", "ts", F.col("price_eur_mwh").alias("price"))
    march = (F.year("ts") == 1998) & (F.month("ts") == 3)
    stored = base.filter(~(march & F.dayofmonth("ts").isin(4, 5)))
    return base, stored, base.filter(march & (F.dayofmonth("ts") <= 10)), march


@query("mrg7_repair_rows", f"WITH {REPAIR_SQL} SELECT * FROM base")
def _(spark, d):
    base, stored, delivered, _march = repair_tables(spark, d)
    allowed = base.select(*KEYS).join(stored.select(*KEYS), KEYS, "left_anti")
    return ops.repair_rows(stored, delivered, allowed, delivered.select(*KEYS), KEYS)


@query("mrg7_repair_violations", f"""WITH {REPAIR_SQL}, del AS (SELECT * FROM base WHERE year(ts) = 1998 AND month(ts) = 3 AND day(ts) <= 10),
grid AS (SELECT series_id, unnest(generate_series(TIMESTAMP '1998-03-01 00:00:00', TIMESTAMP '1998-03-10 00:00:00', INTERVAL 1 DAY)) AS ts FROM (SELECT DISTINCT series_id FROM dd))
SELECT series_id, ts, 'delivery_incomplete' AS reason FROM grid ANTI JOIN del USING (series_id, ts)
UNION ALL SELECT series_id, ts, 'key_not_approved' FROM del ANTI JOIN st USING (series_id, ts) WHERE day(ts) <> 4
UNION ALL SELECT series_id, ts, 'stored_value_differs' FROM del JOIN st USING (series_id, ts) WHERE day(ts) = 2""")
def _(spark, d):
    base, stored, delivered, march = repair_tables(spark, d)
    allowed = base.filter(march & (F.dayofmonth("ts") == 4)).select(*KEYS)
    ends = bounds_of(base, ["series_id"]).select(
        "series_id", F.lit("1998-03-01").cast("timestamp").alias("first_ts"), F.lit("1998-03-10").cast("timestamp").alias("last_ts"))
    expected = spine(ends, ["series_id"], DAY)
    changed = delivered.withColumn("price", F.col("price") + F.when(F.dayofmonth("ts") == 2, 5).otherwise(0))
    return ops.repair_violations(stored, changed, allowed, expected, KEYS)


@query("st1_union_strict", f"WITH {D_SQL} SELECT series_id, ts, total FROM dd")
def _(spark, d):
    whole = days(spark, d).select("series_id", "ts", "total")
    return ops.union_strict([whole.filter("ts < '1998-01-01'"), whole.filter("ts >= '1998-01-01'")], KEYS)


@query("st2_union_last", f"""WITH {M_SQL} SELECT series_id, ts, price, total FROM incoming
UNION ALL SELECT series_id, ts, price, total FROM stored ANTI JOIN incoming USING (series_id, ts)""")
def _(spark, d):
    return ops.union_last(list(stored_and_incoming(spark, d)), KEYS)


@query("st3_vintage_conflicts", f"""WITH {V_SQL}, ids AS (SELECT document_id, revision_number, part_key % 100 AS slot, value_mw, resolution FROM v)
SELECT document_id, slot, count(*) AS "rows" FROM ids GROUP BY 1, 2 HAVING count(DISTINCT value_mw) > 1 OR count(DISTINCT resolution) > 1""")
def _(spark, d):
    rows = vintages(spark, d).withColumn("slot", F.col("part_key") % 100)
    return ops.vintage_conflicts(rows, ["document_id", "slot"], ["value_mw", "resolution"])


@query("st3_dedupe_vintages", f"""WITH {V_SQL}, one AS (SELECT document_id, revision_number, technology, target_timestamp, part_key, max(value_mw) AS value_mw, min(acquired_at_utc) AS acquired_at_utc
  FROM v GROUP BY 1, 2, 3, 4, 5)
SELECT * FROM one""")
def _(spark, d):
    key = ["document_id", "revision_number", "technology", "target_timestamp", "part_key"]
    base = vintages(spark, d).groupBy(*key).agg(F.max("value_mw").alias("value_mw"), F.min("acquired_at_utc").alias("acquired_at_utc"))
    again = base.filter("part_key % 3 = 0").withColumn("acquired_at_utc", F.col("acquired_at_utc") + F.expr("INTERVAL 1 HOUR"))
    return ops.dedupe_vintages(base.unionByName(again), key, ["value_mw"])


@query("st5_union_columns", """SELECT o_orderkey AS id, o_orderstatus AS state, NULL::DOUBLE AS amount FROM orders
UNION ALL SELECT l_orderkey, NULL, l_extendedprice FROM lineitem""")
def _(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("amount"))
    return ops.union_columns(orders, lines)
