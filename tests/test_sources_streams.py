"""File sources, snapshot publication and the streaming forms."""

import datetime as dt
import json

import pytest
from pyspark.sql import types as T

from apothecary.operators.snapshots import Feed
from apothecary.sources import feeds
from apothecary.streaming import arrivals

T0 = dt.datetime(2026, 1, 1)


def test_envelope(spark, tmp_path):
    record = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    (tmp_path / "x.json").write_text(json.dumps({"meta": {}, "results": [{"a": "1", "extra": 2}, {"b": "2"}]}))
    assert [tuple(r) for r in feeds.read_envelope(spark, str(tmp_path / "x.json"), record).orderBy("pos").collect()] == [(1, "1", None), (2, None, "2")]
    (tmp_path / "y.json").write_text('{"meta": {}}')
    with pytest.raises(Exception, match="no results"):
        feeds.read_envelope(spark, str(tmp_path / "y.json"), record).collect()


def test_lines(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
    (tmp_path / "l").write_text('{"k": "a", "n": 1}\n\n{"k": "a", "n": 2}\n')
    rows = feeds.read_lines(spark, str(tmp_path / "l"), schema)
    assert [tuple(r) for r in feeds.last_line_wins(rows, "k", "n").collect()] == [("a", 2)]
    (tmp_path / "m").write_text('{"k": "a", "n": "x"}\n')
    with pytest.raises(Exception):
        feeds.read_lines(spark, str(tmp_path / "m"), schema).collect()


def test_snapshot_publication(spark, tmp_path):
    root, df = f"file://{tmp_path}/snaps", spark.range(3)
    assert feeds.complete_snapshots(spark, root, ("recalls",)) == []
    feeds.write_snapshot({"recalls": df}, root, "2026-01-01_00", {"recalls": 3})
    with pytest.raises(FileExistsError):
        feeds.write_snapshot({"recalls": df}, root, "2026-01-01_00")
    with pytest.raises(ValueError, match="expected"):
        feeds.write_snapshot({"recalls": df}, root, "2026-01-01_01", {"recalls": 4})
    with pytest.raises(ValueError):
        feeds.write_snapshot({"recalls": df}, root, "today")
    assert feeds.complete_snapshots(spark, root, ("recalls",)) == ["2026-01-01_00"]
    assert feeds.complete_snapshots(spark, root, ("recalls", "ndc")) == []
    with pytest.raises(ValueError):
        feeds.source("nothing")


def test_stream_of_deliveries(spark, tmp_path):
    schema = "row_id bigint, snapshot string, ingested_at timestamp, recall_number string, status string, classification string"
    rows = [(1, "a", T0, "D-1", "x", "c"), (2, "a", T0, "D-2", "x", "c"), (3, "b", T0, "D-1", "y", "c"), (4, "b", T0, "D-3", "x", "c")]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(source)
    stream = arrivals.read_deliveries(spark, source, spark.createDataFrame([], schema).schema)
    arrivals.stream_changes(stream, Feed("recalls", ("status", "classification")), out, str(tmp_path / "cp"), 2).awaitTermination(120)
    got = {(r["snapshot"], r["record_key"], r["change_kind"]) for r in arrivals.read_changes(spark, out).collect()}
    assert got == {("b", "D-1", "changed"), ("b", "D-2", "removed"), ("b", "D-3", "added")}


def test_deliveries_over_runs_and_triggers(spark, tmp_path):
    schema = "row_id bigint, snapshot string, ingested_at timestamp, recall_number string, status string, classification string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed = Feed("recalls", ("status", "classification"))

    def run(rows):
        for r in rows:
            spark.createDataFrame([(r[0], r[1], T0, r[2], r[3], "c")], schema).coalesce(1).write.mode("append").parquet(source)
        stream = arrivals.read_deliveries(spark, source, spark.createDataFrame([], schema).schema, 1)
        query = arrivals.stream_changes(stream, feed, out, str(tmp_path / "cp"), 2)
        assert query.awaitTermination(120)

    run([(1, "a", "D-1", "x"), (2, "a", "D-2", "x")])
    run([(3, "b", "D-1", "y"), (4, "b", "D-2", "x")])
    run([(5, "b", "D-3", "x"), (6, "c", "D-1", "y")])
    got = sorted((r["snapshot"], r["record_key"], r["change_kind"]) for r in arrivals.read_changes(spark, out).collect())
    assert got == [("b", "D-1", "changed"), ("b", "D-3", "added"), ("c", "D-2", "removed"), ("c", "D-3", "removed")]


def test_replayed_batch(spark, tmp_path):
    schema = "row_id bigint, snapshot string, ingested_at timestamp, recall_number string, status string, classification string"
    out, kept = str(tmp_path / "out"), str(tmp_path / "kept")
    write = arrivals.change_writer(Feed("recalls", ("status", "classification")), out, kept, 2)
    batch = lambda *rows: spark.createDataFrame([(i, s, T0, k, v, "c") for i, s, k, v in rows], schema)
    write(batch((1, "a", "D-1", "x"), (2, "a", "D-2", "x")), 0)
    for _ in range(2):
        write(batch((3, "b", "D-1", "y")), 1)
    write(batch((4, "b", "D-2", "x")), 2)
    write(batch(), 3)
    assert {(r["snapshot"], r["record_key"], r["change_kind"]) for r in arrivals.read_changes(spark, out).collect()} == {("b", "D-1", "changed")}


def test_event_stream(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    rows = [(1, T0, 1, "a", 1.0), (1, T0, 1, "a", 1.0), (2, T0 + dt.timedelta(minutes=5), 1, "a", 2.0), (3, T0 + dt.timedelta(hours=3), 1, "a", 4.0), (4, None, 1, "a", 9.0)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = arrivals.event_windows(stream).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r["n"], r["total"]) for r in spark.table("w").collect()}
    assert {(2, 3.0)} <= got <= {(2, 3.0), (1, 4.0)}
    batch = spark.createDataFrame(rows, schema)
    assert {(r["n"], r["total"]) for r in arrivals.event_windows(batch).collect()} == {(2, 3.0), (1, 4.0)}
    assert sorted(r["n"] for r in arrivals.sessions(batch).collect()) == [1, 3]
