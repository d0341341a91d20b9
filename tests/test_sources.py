from concurrent.futures import ThreadPoolExecutor

import pytest
from frames import table, values
from pyspark.sql import functions as F

from tidegrid import DataContractError
from tidegrid.sources import documents, observations, payloads, sinks

PRICE_XML = """<?xml version="1.0"?><D xmlns="urn:x"><TimeSeries><mRID>1</mRID><curveType>A03</curveType><Period><timeInterval>
<start>2026-01-01T00:00Z</start><end>2026-01-01T06:00Z</end></timeInterval><resolution>PT60M</resolution>
<Point><position>1</position><price.amount>5.5</price.amount></Point><Point><position>4</position><price.amount>-7</price.amount></Point>
</Period></TimeSeries></D>"""


def test_price_document_with_namespace(spark, tmp_path):
    (tmp_path / "a.xml").write_text(PRICE_XML)
    out = documents.read_price_documents(spark, str(tmp_path)).orderBy("ts").collect()
    assert [r["value"] for r in out] == [5.5, 5.5, 5.5, -7.0, -7.0, -7.0] and str(out[5]["ts"]) == "2026-01-01 05:00:00"


def test_overlapping_price_periods_are_fatal(spark, tmp_path):
    series = PRICE_XML.split("<TimeSeries>")[1].split("</TimeSeries>")[0]
    period = series[series.index("<Period>"):]
    (tmp_path / "a.xml").write_text(f"<D><TimeSeries>{series}{period}</TimeSeries></D>")
    with pytest.raises(DataContractError):
        documents.read_price_documents(spark, str(tmp_path))


def test_forecast_document_keeps_its_provenance(spark, tmp_path):
    (tmp_path / "f.xml").write_text("""<M xmlns="urn:y"><mRID>doc</mRID><revisionNumber>3</revisionNumber><type>A69</type><process.processType>A40</process.processType>
<createdDateTime>2026-01-01T00:10:00Z</createdDateTime><TimeSeries><MktPSRType><psrType>B19</psrType></MktPSRType><Period><timeInterval><start>2026-01-01T01:00Z</start>
<end>2026-01-01T02:00Z</end></timeInterval><resolution>PT15M</resolution><Point><position>3</position><quantity>12</quantity></Point></Period></TimeSeries></M>""")
    row = documents.read_forecast_documents(spark, str(tmp_path)).first()
    assert (row["document_id"], row["revision_number"], row["process_type"], row["technology"]) == ("doc", "3", "A40", "WIND_ONSHORE")
    assert str(row["target_timestamp"]) == "2026-01-01 01:30:00" and row["source_horizon_minutes"] == 80.0 and row["value_mw"] == 12.0


def test_two_row_header(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text(",Solar,Solar,Gas,Gas\n,Actual Aggregated,Actual Consumption,Actual Aggregated,Actual Aggregated\n2026-01-01 00:00:00+00:00,1,2,3,4\n")
    out = observations.read_wide_generation(spark, str(path))
    assert out.columns == ["timestamp", "Solar", "Gas"] and tuple(out.first())[1:] == ("1", "3")
    path.write_text("timestamp,Solar\n2026-01-01,7\n")
    assert observations.read_wide_generation(spark, str(path)).first()["Solar"] == "7"


def test_repeated_or_broken_times_are_fatal(spark):
    for rows in ([("2026-01-01", 1.0), ("2026-01-01", 2.0)], [("soon", 1.0)]):
        with pytest.raises(DataContractError):
            observations.parse_observations(spark.createDataFrame(rows, "ts string, v double"))


def test_unequal_payload_arrays_are_reported(spark):
    df = spark.createDataFrame([('{"hourly": {"time": ["a", "b"], "v": [1.0]}}',), ('{"hourly": {"time": ["a"], "v": [1.0]}}',), ("{}",)], "payload string")
    assert payloads.payload_violations(df, ["time", "v"], "payload", "hourly").count() == 2


def test_append_is_idempotent_and_refuses_conflicts(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = table(spark, "k int, v double", [(1, 1.0), (2, 2.0)])
    rows.write.parquet(path)
    assert sinks.append_to(path, spark.read.parquet(path), table(spark, "k int, v double", [(2, 2.0), (3, 3.0)]), ["k"]) == 1
    assert sinks.append_to(path, spark.read.parquet(path), rows, ["k"]) == 0
    with pytest.raises(DataContractError):
        sinks.append_to(path, spark.read.parquet(path), table(spark, "k int, v double", [(3, 4.0)]), ["k"])


def test_published_versions_and_pointer(spark, tmp_path):
    root = str(tmp_path / "p")
    assert sinks.current_version(spark, root) is None
    sinks.publish_table(table(spark, "k int", [(1,)]), root)
    assert sinks.publish_table(table(spark, "k int", [(1,), (2,)]), root) == 2
    assert sinks.read_published(spark, root).count() == 2
    with ThreadPoolExecutor(4) as pool:  # several writers at a time: every one gets a number of its own
        numbers = list(pool.map(lambda k: sinks.publish_table(table(spark, "k int", [(k,)]), root), range(4)))
    assert sorted(numbers) == [3, 4, 5, 6] and sinks.current_version(spark, root) == 6
    assert values(sinks.read_published(spark, root), "k") == [(numbers.index(6),)]


def test_only_delivered_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "m")
    sinks.overwrite_partitions(table(spark, "month string, v int", [("01", 1), ("02", 2)]), path, ["month"])
    sinks.overwrite_partitions(table(spark, "month string, v int", [("02", 5)]), path, ["month"])
    assert values(spark.read.parquet(path), "v") == [(1,), (5,)]


def issue(spark, rows=24, shift=0.0, issued="2026-01-01 00:05:00"):
    columns = "series_id string, model_release string, forecast_issue_time timestamp, target_timestamp timestamp, horizon_hours int, predicted_price_eur_mwh double, issued_at_utc timestamp"
    return table(spark, columns, [("one", "m", "2026-01-01 00:00:00", f"2026-01-0{1 + h // 24} {h % 24:02d}:00:00", h, h + shift, issued) for h in range(1, rows + 1)])


def test_issued_forecasts_cannot_change(spark):
    history = issue(spark)
    assert sinks.append_issued(history.limit(0), history).count() == 24
    assert sinks.append_issued(history, issue(spark)).count() == 0
    for bad in (issue(spark, 23), issue(spark, shift=1e-6), issue(spark, issued="2025-12-31 23:59:00")):
        with pytest.raises(DataContractError):
            sinks.append_issued(history, bad)


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(50).select("id", (F.col("id") * 2).alias("v"))
    a, b = sinks.fingerprint(df).first(), sinks.fingerprint(df.select("v", "id").repartition(7)).first()
    assert a == b and a != sinks.fingerprint(df.withColumn("v", F.col("v") + 1)).first()
    nulls = spark.createDataFrame([(None, "a")], "x string, y string"), spark.createDataFrame([("a", None)], "x string, y string")
    assert sinks.fingerprint(nulls[0]).first() != sinks.fingerprint(nulls[1]).first()


def test_unknown_schema_is_fatal(spark):
    df = spark.range(1)
    with pytest.raises(DataContractError):
        observations.migrate_schema(df, ["a"], ["b"], {"b": "a"})
    assert values(observations.migrate_schema(df, ["a", "c"], ["id"], {"id": "a"}, {"c": "string"}), "a", "c") == [(0, None)]


def test_scratch_tables_go_when_their_scope_ends(spark):
    from tidegrid.session import scratch_scope, written, written_buckets

    with scratch_scope():
        with scratch_scope():
            inner, kept = written(spark.range(3)), written(spark.range(4), keep=True)
            table_ = written_buckets(spark.range(5).repartition(2, "id"), "id", 2)
            assert (inner.count(), table_.count()) == (3, 5)
        assert kept.count() == 4
        with pytest.raises(Exception):  # noqa: B017
            inner.count()
    with pytest.raises(Exception):  # noqa: B017
        kept.count()
    alone = written(spark.range(6))
    assert alone.count() == 6


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_price_points_are_moved_once(spark, tmp_path):
    series = PRICE_XML.split("<TimeSeries>")[1].split("</TimeSeries>")[0]
    (tmp_path / "a.xml").write_text(f"<D><TimeSeries>{series}</TimeSeries><TimeSeries>{series.replace('2026-01-01', '2026-01-02').replace('<mRID>1<', '<mRID>2<')}</TimeSeries></D>")
    out = documents.read_price_documents(spark, str(tmp_path))
    assert out.count() == 12 and "Exchange" not in plan_of(out)


def test_queries_write_their_documents_compressed(spark, tmp_path, monkeypatch):
    from tidegrid.plans import load_all
    from tidegrid.plans import sources as plans
    from tidegrid.plans.registry import QUERIES

    load_all()
    spark.sql("SELECT 1L AS l_orderkey, 1L AS l_suppkey, 1 AS l_linenumber, 5.0D AS l_extendedprice").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sql("SELECT 1L AS o_orderkey, 'F' AS o_orderstatus, timestamp'2026-01-01' AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("src3_price_documents", "src4_forecast_documents"):
        folder = tmp_path / name
        monkeypatch.setattr(plans, "scratch", lambda _, to=folder: str(to))
        rows = QUERIES[name](spark, str(tmp_path)).count()
        assert rows == (8 if name.startswith("src3") else 2)
        assert list(folder.glob("part-*.gz")) and not list(folder.glob("part-*.txt"))
