"""Nested records: places, odd shapes, Merkle identities and the way back."""

import json

from pyspark.sql import functions as F

from apothecary.operators import nested

ING = "array<struct<name:string,strength:string>>"
NDC = f"product_id string, active_ingredients {ING}, packaging array<struct<package_ndc:string,description:string,sample:boolean>>"
FDA = f"application_number string, products array<struct<product_number:string,brand_name:string,active_ingredients:{ING}>>, submissions array<struct<submission_number:string,application_docs:array<struct<doc_title:string>>>>"


def frames(spark, ndc=(), fda=(), raw=()):
    return spark.createDataFrame(list(ndc), NDC), spark.createDataFrame(list(fda), FDA), spark.createDataFrame([(i, f, p if isinstance(p, str) or p is None else json.dumps(p)) for i, (f, p) in enumerate(raw, 1)], "raw_id bigint, feed string, payload string")


def places(occ):
    rows = nested.flat(nested.bridge(occ), nested.objects(occ))
    found = {tuple(r) for r in rows.select("record_id", "path", "pos", "sub_pos").distinct().collect()}
    assert found == {tuple(r)[1:] for r in nested.places(occ, nested.identities(occ)).collect()}
    return found


def test_native(spark):
    ndc = [("p1", [("A", "1"), None, (None, None), ("B", None)], []), ("p1", [("A", "1"), None, (None, None), ("B", None)], []), ("p2", None, [("c", None, True)]), (None, [("A", "1")], None)]
    fda = [("n1", [None, ("001", None, [None, ("A", "1")]), (None, None, [])], [("1", [("t",), (None,)]), ("2", None)])]
    got = places(nested.all_occurrences(*frames(spark, ndc, fda)))
    assert got == {
        ("p1", "active_ingredients", 1, 0), ("p1", "active_ingredients", 4, 0), ("p2", "packaging", 1, 0), ("n1", "products", 2, 0), ("n1", "products.active_ingredients", 2, 2), ("n1", "products", 3, 0),
        ("n1", "submissions", 1, 0), ("n1", "submissions.application_docs", 1, 1), ("n1", "submissions", 2, 0),
    }


def test_raw(spark):
    raw = [
        ("ndc", {"active_ingredients": {"name": "A"}, "packaging": '[{"package_ndc": "x"}, null, {}, {"sample": false}]'}),
        ("drugsfda", {"products": {"product_number": "1", "active_ingredients": '{"name": "B"}'}, "submissions": None}),
        ("ndc", '{"packaging": [{"package_ndc": "x"}'), ("ndc", '{"packaging": [{"package_ndc": "x"}]}], "y": [{"a": 1}'), ("ndc", '{"packaging": [{"package_ndc": "x"}]}, {"a": 1}'), ("ndc", "[]"), ("ndc", ""), ("ndc", None), ("ndc", "null"), ("ndc", '{"packaging": [{"package_ndc": "x"}]} trailing'), ("ndc", {"packaging": "no list", "active_ingredients": ["text", 5, {"name": "C"}]}), ("ndc", ' \n {"packaging": []}'),
    ]
    got = places(nested.all_occurrences(*frames(spark, raw=raw)))
    assert got == {("1", "active_ingredients", 1, 0), ("1", "packaging", 1, 0), ("1", "packaging", 4, 0), ("2", "products", 1, 0), ("2", "products.active_ingredients", 1, 1), ("11", "active_ingredients", 3, 0)}


def test_equal_subtrees_are_stored_once(spark):
    ndc = [("p1", [("A", "1"), ("A", "1")], None), ("p2", [("A", "1")], None)]
    occ = nested.all_occurrences(*frames(spark, ndc, raw=[("ndc", {"active_ingredients": [{"strength": "1", "name": "A", "note": None}]})]))
    (obj,) = nested.objects(occ).collect()
    assert (json.loads(obj["body"]), obj["places"]) == ({"name": "A", "strength": "1"}, 4)
    assert nested.bridge(occ).count() == 4


def test_records_can_be_rebuilt(spark):
    fda = [("n1", [("001", "b", [("A", "1"), None, ("B", "2")]), ("002", None, None)], None), ("n2", [("001", "b", [("A", "1"), None, ("B", "2")])], None)]
    occ = nested.all_occurrences(*frames(spark, fda=fda)).cache()
    bodies = {bytes(r["object_id"]): json.loads(r["body"]) for r in nested.objects(occ).collect()}
    links = {}
    for r in nested.bridge(occ).collect():
        parent = f"{r['feed']}:{r['record_id']}" if r["parent_id"] is None else bytes(r["parent_id"])
        links.setdefault(parent, {})[r["ordinals"][-1]] = bytes(r["object_id"])
    for name, products, _ in fda:
        for pos, oid in links[f"drugsfda:{name}"].items():
            number, brand, inner = products[pos - 1]
            assert bodies[oid] == {k: v for k, v in (("product_number", number), ("brand_name", brand)) if v is not None}
            assert {p: (bodies[c]["name"], bodies[c]["strength"]) for p, c in links.get(oid, {}).items()} == {i + 1: x for i, x in enumerate(inner or []) if x}
    shared = [v[1] for k, v in links.items() if isinstance(k, str)]
    assert shared[0] == shared[1]


def test_any_depth(spark):
    deep = "a array<struct<x:int,tags:array<string>,b:array<struct<y:string,c:array<struct<z:boolean>>>>>>"
    rows = [("r1", [(1, ["t"], [None, ("p", [(None,), (True,)])])]), ("r2", [(None, None, None), (2, None, [("p", [(None,), (True,)])])])]
    occ = nested.native_occurrences(spark.createDataFrame(rows, f"id string, {deep}"), "deep", "id")
    got = {(r["record_id"], r["path"], tuple(r["ordinals"])) for r in occ.collect()}
    assert got == {("r1", "a", (1,)), ("r1", "a.b", (1, 2)), ("r1", "a.b.c", (1, 2, 2)), ("r2", "a", (2,)), ("r2", "a.b", (2, 1)), ("r2", "a.b.c", (2, 1, 2))}
    ids = {(r["record_id"], r["path"]): bytes(r["object_id"]) for r in occ.collect()}
    assert ids["r1", "a.b"] == ids["r2", "a.b"] and ids["r1", "a"] != ids["r2", "a"]
    parents = {(r["record_id"], r["path"]): r["parent_id"] and bytes(r["parent_id"]) for r in occ.collect()}
    assert parents["r1", "a.b.c"] == ids["r1", "a.b"] and parents["r1", "a.b"] == ids["r1", "a"] and parents["r1", "a"] is None
    body = next(r["body"] for r in nested.objects(occ).collect() if r["path"] == "a" and "1" in r["body"])
    assert json.loads(body) == {"x": "1", "tags": '["t"]'}


def test_empty(spark):
    occ = nested.all_occurrences(*frames(spark))
    assert occ.count() == nested.objects(occ).count() == nested.bridge(occ.withColumn("clash", F.lit(1))).count() == 0
