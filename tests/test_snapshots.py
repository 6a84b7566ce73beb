"""Snapshot differences against brute force, and their edge cases."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from apothecary.operators import snapshots

RECALLS = "row_id bigint, snapshot string, ingested_at timestamp, recall_number string, status string, classification string, digest string"
SHORTAGES = "row_id bigint, snapshot string, ingested_at timestamp, package_ndc string, status string, availability string"
T0 = dt.datetime(2026, 1, 1)


def run(spark, recalls, shortages=()):
    tables = {"recalls": spark.createDataFrame(list(recalls), RECALLS), "shortages": spark.createDataFrame(list(shortages), SHORTAGES)}
    return {(r["feed"], r["snapshot"], r["record_key"], r["change_kind"]) for r in snapshots.changes(spark, tables, buckets=3).collect()}


def test_kinds(spark):
    rows = [
        (1, "a", T0, "D-1", "Ongoing", "I", "z"), (2, "a", T0, "D-2", "Ongoing", "I", "z"), (3, "a", T0, "D-3", None, "I", "z"), (4, "a", T0, " ", "x", "y", "z"),
        (5, "b", T0, " d-1", "ONGOING ", "i", "z"), (6, "b", T0, "D-3", "Ongoing", "I", "z"), (7, "b", T0, "D-4", "Ongoing", "I", "z"),
        (8, "b", T0 + dt.timedelta(1), "D-1", "Completed", "I", "z"), (9, None, T0, "D-9", "x", "y", "z"), (10, "b", None, "D-4", "late", None, "z"),
    ]
    short = [(1, "a", T0, "1234-5678-90", "Current", None), (2, "b", T0, "NDC 01234567890", "current", "Available"), (3, "b", T0, "pending", "x", "y")]
    assert run(spark, rows, short) == {("recalls", "b", "D-2", "removed"), ("recalls", "b", "D-1", "changed"), ("recalls", "b", "D-3", "changed"), ("recalls", "b", "D-4", "added"), ("shortages", "b", "01234567890", "changed")}


def test_empty_and_single(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, "a", T0, "D-1", "x", "y", "z")]) == set()


def test_fields(spark):
    rows = [(1, "a", T0, "D-1", "Ongoing", "I", "z"), (2, "b", T0, "D-1", "Completed", None, "z")]
    tables = {"recalls": spark.createDataFrame(rows, RECALLS), "shortages": spark.createDataFrame([], SHORTAGES)}
    got = {(r["field"], r["old_value"], r["new_value"]) for r in snapshots.field_changes(spark, tables, buckets=2).collect()}
    assert got == {("status", "Ongoing", "Completed"), ("classification", "I", None)}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 3), st.sampled_from(["D-1", "d-1 ", "D-2", "D-3", None]), st.sampled_from(["x", "X", "y", None])), max_size=40))
def test_against_brute_force(spark, rows):
    made = [(i, s, T0 + dt.timedelta(h), k, v, "c", "z") for i, (s, h, k, v) in enumerate(rows)]
    state = {}
    for i, s, at, k, v, _, _ in made:
        if k:
            state.setdefault(s, {}).setdefault(k.strip().upper(), []).append((at, i, v and v.lower()))
    names = sorted({r[1] for r in made})
    want = set()
    for a, b in zip(names, names[1:]):
        x, y = ({k: max(v)[2] for k, v in state.get(n, {}).items()} for n in (a, b))
        for k in x.keys() | y.keys():
            if k not in x or k not in y or x[k] != y[k]:
                want.add(("recalls", b, k, "added" if k not in x else "removed" if k not in y else "changed"))
    assert run(spark, made) == want


def test_bucketed_probe_needs_no_shuffle(spark):
    df = spark.range(2000).selectExpr("'recalls' AS feed", "cast(id AS string) AS record_key", "unhex(md5(cast(id AS string))) AS digest", "id AS row_id")
    a, b = (snapshots.SnapshotIndex(spark, df, 4) for _ in range(2))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = snapshots.probe(a.rows(), b.rows())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        a.drop()
        b.drop()
    assert "Exchange" not in plan


def test_missing_table_name(spark):
    with pytest.raises(KeyError):
        snapshots.changes(spark, {"recalls": spark.createDataFrame([(1, "a", T0, "D", "x", "y", "z")], RECALLS)})
