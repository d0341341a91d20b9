import pytest
from frames import table, values
from pyspark.sql import functions as F

from tidegrid import DataContractError
from tidegrid.operators import incremental, merge as ops

COLUMNS = "series_id string, ts timestamp, price double, load double"
KEYS = ["series_id", "ts"]
WINDOW = ("2026-01-02 00:00:00", "2026-01-03 00:00:00")


def stored(spark):
    return table(spark, COLUMNS, [("a", "2026-01-01", 1.0, 10.0), ("a", "2026-01-02", 2.0, None), ("a", "2026-01-04", None, 40.0)])


def incoming(spark):
    return table(spark, COLUMNS, [("a", "2026-01-01", 9.0, 10.0 + 1e-12), ("a", "2026-01-02", 8.0, 20.0), ("a", "2026-01-04", 4.0, None), ("a", "2026-01-05", 5.0, 50.0)])


def test_each_cell_is_filled_revised_or_protected(spark):
    merged = ops.merge_revisions(stored(spark), incoming(spark), KEYS, window=WINDOW, retain=True)
    assert [tuple(r)[2:] for r in merged.data.orderBy("ts").collect()] == [(1.0, 10.0), (8.0, 20.0), (4.0, 40.0), (5.0, 50.0)]
    audit = {r["column_name"]: (r["new_rows"], r["repaired"], r["revised"], r["protected"]) for r in merged.audit.collect()}
    assert audit == {"price": (1, 1, 1, 1), "load": (1, 1, 0, 0)}


def test_merging_twice_changes_nothing(spark):
    once = ops.merge_revisions(stored(spark), incoming(spark), KEYS, window=WINDOW, retain=True).data
    again = ops.merge_revisions(once, incoming(spark), KEYS, window=WINDOW, retain=True)
    assert again.data.exceptAll(once).count() == 0
    assert not ops.merge_audit(again.audit).first()["changed"]
    assert not ops.should_rebuild(again.audit, "2026-01-05", "2026-01-05").first()["rebuild"]


def test_strict_merge_refuses_changes(spark):
    with pytest.raises(DataContractError):
        ops.merge_revisions(stored(spark), incoming(spark), KEYS)
    with pytest.raises(DataContractError):
        ops.merge_strict(stored(spark), incoming(spark), KEYS)
    with pytest.raises(DataContractError):
        ops.merge_strict(stored(spark), incoming(spark).drop("load"), KEYS)
    same = stored(spark).unionByName(incoming(spark).filter("ts > '2026-01-04'"))
    assert ops.merge_strict(stored(spark), same, KEYS).count() == 4


def test_new_columns_are_kept(spark):
    wide = incoming(spark).withColumn("solar", F.lit(3.0))
    out = ops.merge_revisions(stored(spark), wide, KEYS, window=WINDOW, retain=True).data
    assert out.columns == [*KEYS, "price", "load", "solar"] and out.filter("solar IS NULL").count() == 0


def test_labels_may_be_filled_but_not_changed(spark):
    base = stored(spark).withColumn("resolution", F.lit(None).cast("string"))
    new = incoming(spark).withColumn("resolution", F.lit("PT15M"))
    out = ops.merge_prices(base, new, KEYS, window=WINDOW).data
    assert {r[0] for r in values(out, "resolution")} == {"PT15M"}
    with pytest.raises(DataContractError):
        ops.merge_prices(base.withColumn("resolution", F.lit("PT60M")), new, KEYS, window=WINDOW)


def test_repair_fills_only_null_cells(spark):
    late = table(spark, COLUMNS, [("a", "2026-01-02", 2.0, 20.0), ("a", "2026-01-03", 3.0, 30.0)])
    out = ops.repair_interval(stored(spark), late, KEYS, "2026-01-01 00:00:00", "2026-01-04 00:00:00")
    assert out.data.count() == 3 and out.data.filter("load = 20").count() == 1
    with pytest.raises(DataContractError):
        ops.repair_interval(stored(spark), late, KEYS, "2026-01-01 00:00:00", "2026-01-09 00:00:00")
    with pytest.raises(DataContractError):
        ops.repair_interval(stored(spark), incoming(spark), KEYS, "2026-01-01 00:00:00", "2026-01-04 00:00:00")


def test_vintages_collapse_to_the_earliest_equal_copy(spark):
    rows = [("d", "2026-01-01 02:00:00", 1.0), ("d", "2026-01-01 01:00:00", 1.0), ("e", "2026-01-01", None), ("e", "2026-01-02", None)]
    df = table(spark, "id string, acquired_at_utc timestamp, v double", rows)
    out = ops.dedupe_vintages(df, ["id"], ["v"])
    assert [str(r[1]) for r in values(out, "id", "acquired_at_utc")] == ["2026-01-01 01:00:00", "2026-01-01 00:00:00"]
    with pytest.raises(DataContractError):
        ops.dedupe_vintages(df.unionByName(table(spark, "id string, acquired_at_utc timestamp, v double", [("e", "2026-01-03", 5.0)])), ["id"], ["v"])


def test_two_deliveries_equal_one(spark):
    hours = [("a", f"2026-01-0{1 + h // 24} {h % 24:02d}:00:00", float(h)) for h in range(60)]
    source = table(spark, "series_id string, ts timestamp, value double", hours)
    old = source.filter("ts < '2026-01-02 00:00:00'")
    now, start = "2026-01-03 10:00:00", "2026-01-01 12:00:00"
    once = incremental.ingest_increment(old, source, "load", now, start).merge.data
    half = incremental.ingest_increment(old, source.filter("ts < '2026-01-02 18:00:00'"), "load", "2026-01-02 18:00:00", start).merge.data
    twice = incremental.ingest_increment(half, source, "load", now, start).merge.data
    assert once.exceptAll(twice).count() == 0 and once.count() == twice.count() == 58


def test_trim_keeps_published_rows_and_refuses_inner_gaps(spark):
    rows = [("a", "2026-01-01", 1.0, 1.0), ("a", "2026-01-02", 2.0, 2.0), ("a", "2026-01-03", None, 3.0)]
    assert incremental.trim_unpublished(table(spark, COLUMNS, rows), ["series_id"], ["price", "load"]).count() == 2
    with pytest.raises(DataContractError):
        incremental.trim_unpublished(table(spark, COLUMNS, [*rows, ("a", "2026-01-04", 4.0, 4.0)]), ["series_id"], ["price", "load"])


def test_a_repeated_key_is_fatal(spark):
    twice = incoming(spark).unionByName(incoming(spark).limit(1))
    with pytest.raises(DataContractError):
        ops.merge_revisions(stored(spark), twice, KEYS, window=WINDOW, retain=True)
    with pytest.raises(DataContractError):
        ops.merge_revisions(stored(spark).unionByName(stored(spark)), incoming(spark), KEYS, window=WINDOW, retain=True)


def test_rows_outside_the_delivered_range_are_kept(spark):
    part = incoming(spark).filter("ts = '2026-01-02 00:00:00'")
    out = ops.merge_revisions(stored(spark), part, KEYS, window=WINDOW, retain=True)
    assert [tuple(r)[2:] for r in out.data.orderBy("ts").collect()] == [(1.0, 10.0), (8.0, 20.0), (None, 40.0)]
    none = ops.merge_revisions(stored(spark), part.filter("false"), KEYS, window=WINDOW, retain=True)
    assert none.data.exceptAll(stored(spark)).count() == 0 and none.data.count() == 3
