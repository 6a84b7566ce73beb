"""Resolution, graph and traversal on small feeds with known answers."""

import datetime as dt

from pyspark.sql import functions as F

from apothecary.operators import classify, graph, market, modeling, resolve

NDC = "product_id string, product_ndc string, generic_name string, brand_name string, labeler_name string, dosage_form string, route array<string>, finished boolean, application_number string, active_ingredients array<struct<name:string,strength:string>>, packaging array<struct<package_ndc:string,description:string,sample:boolean>>"


def product(pid, code, maker, packs=(), ingredients=(("Aspirin", "1 mg"),), finished=True, route=("ORAL",), generic="Aspirin", app=None):
    return (pid, code, generic, None, maker, "TABLET", list(route) if route is not None else None, finished, app, [tuple(i) for i in ingredients], [(p, None, None) for p in packs])


def directory(spark, *rows):
    return spark.createDataFrame(list(rows), NDC)


def test_waterfall(spark):
    ndc = directory(spark, product("p1", "0002-8215", "Lilly", ["0002-8215-01"]), product("p2", "0003-1111", "X Inc", ["0003-1111-01"]), product("p3", "0003-1111", "Y Inc", []))
    rows = spark.createDataFrame([(1, "002-8215-01", None), (2, "0002-8215-99", None), (3, "99999-9999-99", None), (4, "0003-1111-77", (["0002-8215-01"], None)), (5, None, (["x", "0002-8215-01"], ["0002-8215"])), (6, None, None)], "row_id int, package_ndc string, openfda struct<package_ndc:array<string>,product_ndc:array<string>>")
    got = {r["row_id"]: (r["method"], r["product_id"], r["candidates"]) for r in resolve.waterfall(rows, resolve.shortage_tiers(), resolve.directory_keys(ndc)).collect()}
    assert got == {1: ("package_ndc", "p1", 1), 2: ("product_ndc", "p1", 1), 3: ("unmatched", None, 0), 4: ("ambiguous_product_ndc", None, 2), 5: ("openfda_package_ndc", "p1", 1), 6: ("unmatched", None, 0)}


def test_recall_tiers(spark):
    ndc = directory(spark, product("p1", "0002-8215", "L", ["0002-8215-01"], app="NDA 1"), product("p2", "0003-1111", "M", ["0003-1111-01"], app="nda1"))
    schema = "row_id int, product_description string, code_info string, more_code_info string, openfda struct<package_ndc:array<string>,product_ndc:array<string>,application_number:array<string>>"
    rows = spark.createDataFrame([(1, "NDC 0003-1111-01", None, None, (["0002-8215-01"], ["0002-8215"], ["NDA1"])), (2, "ndc: 0003-1111-01", None, None, None), (3, "none", None, None, (None, None, ["NDA-1"])), (4, None, None, None, None)], schema)
    got = {(r["row_id"], r["product_id"], r["method"]) for r in resolve.recall_links(rows, ndc).collect()}
    assert got == {(1, "p1", "openfda_package_ndc"), (2, "p2", "explicit_ndc_text"), (3, "p1", "application_number"), (3, "p2", "application_number")}


def test_signature_and_groups(spark):
    ndc = directory(
        spark,
        product("a", "1-1", "A", ingredients=(("Caffeine", "2 mg"), ("Aspirin", "1mg"))), product("b", "1-2", "B", ingredients=(("ASPIRIN", "1 MG"), ("caffeine", "2mg"))),
        product("c", "1-3", "C", route=()), product("d", "1-4", "D", ingredients=(("Aspirin", None),)), product("e", "1-5", "E", ingredients=(("Aspirin", "1 mg"), ("Caffeine", "2 mg")), finished=False), product("f", "1-6", "F", route=None, ingredients=()),
    )
    members = graph.equivalence_members(ndc)
    assert {r["product_id"] for r in members.collect()} == {"a", "b"}
    assert graph.equivalence_counts(members).collect()[0].asDict() == {"groups": 1, "members": 2, "pairs": 2}


def test_market(spark):
    ndc = directory(spark, *[product(f"p{i}", f"1-{i}", f"Maker {i} Inc") for i in range(1, 5)])
    products, ingredients = graph.products(ndc), graph.product_ingredients(ndc)
    stopped = market.blocked(spark.createDataFrame([("p1",), (None,)], "product_id string"), spark.createDataFrame([("p2",), ("p1",)], "product_id string"))
    assert market.available_makers(products, ingredients, stopped).collect()[0].asDict() == {"ingredient": "aspirin", "makers": 4, "available_makers": 2}
    assert {tuple(r) for r in market.overlap(products, market.ingredient_sets(ingredients), stopped).collect()} == {("p1", 1)}
    alt = {r["product_id"]: (r["candidates"], r["available"]) for r in market.alternatives(graph.equivalence_members(ndc), products, stopped).collect()}
    assert alt == {"p1": (3, 2), "p2": (3, 2), "p3": (3, 1), "p4": (3, 1)}
    assert market.search(products, ingredients, "ASPI%").count() == 0 and market.search(products, ingredients, "ASPI").count() == 4


def test_surrogates_are_dense(spark):
    names = spark.createDataFrame([(f"n{i % 37:02d}",) for i in range(200)] + [(None,)], "name string")
    got = [(r["id"], r["name"]) for r in graph.surrogate(names, "name", "id").orderBy("id").collect()]
    assert got == [(i + 1, f"n{i:02d}") for i in range(37)]


def test_display_name_and_checks(spark):
    df = spark.createDataFrame([(1, "A Inc"), (2, "A"), (3, "A"), (4, "B Ltd"), (5, "B Inc"), (6, None)], "pos int, raw string")
    assert {(r["norm"], r["name"], r["spellings"]) for r in graph.display_names(df, "raw", F.col("pos")).collect()} == {("a", "A", 2), ("b", "B Ltd", 2)}
    child, parent = spark.createDataFrame([("x",), ("y",), (None,)], "r string"), spark.createDataFrame([("x",)], "k string")
    assert graph.orphans(child, "r", parent, "k", "rule").collect()[0]["violations"] == 1


def test_classifier(spark):
    cases = {
        "Shortage of an active ingredient": ("active_ingredient_shortage", "high", 1.0), "A manufacturing delay caused a shipping delay": ("shipping_delay", "low", 0.5), "Stability concern": ("manufacturing_quality_problem", "low", 0.55),
        "nothing of note": ("unknown", "low", 0.0), None: ("unknown", "low", 0.0), "": ("unknown", "low", 0.0), "LACK OF STERILITY assurance and mold": ("manufacturing_quality_problem", "high", 1.0),
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    for r, (text, want) in zip(classify.classify(rows, F.col("t")).orderBy("i").collect(), cases.items()):
        assert (r["cause"], r["confidence"], r["confidence_score"]) == want, text
    both = classify.collision_pairs(classify.classify(rows, F.col("t"))).collect()
    assert [tuple(r) for r in both] == [("shipping_delay", "manufacturing_capacity", 1)]


def test_modeling(spark):
    rows = spark.createDataFrame([("1", "A", "t"), ("2", "A", "t"), ("3", "B", "t"), ("4", "C", "u"), ("5", None, None)], "row string, incident string, text string")
    got = {r["row"]: r["weight"] for r in modeling.weights(rows, "row", "incident", "text").collect()}
    assert got == {"1": 0.25, "2": 0.25, "3": 0.5, "4": 1.0, "5": 1.0}
    seven = spark.createDataFrame([(f"r{i}{j}", f"i{i}", "t") for i in range(7) for j in range(2)], "row string, incident string, text string")
    capped = modeling.capped(seven, "row", "incident", "text", 5).collect()
    assert len(capped) == len({r["incident"] for r in capped}) == 5
    stats = modeling.nearest_rank(spark.createDataFrame([("a", float(i)) for i in range(20)] + [("a", None)], "by string, v double"), "by", "v").collect()[0]
    assert (stats["n"], stats["mean"], stats["median"], stats["p95"]) == (20, 9.5, 9.5, 19.0)
    assert {tuple(r) for r in modeling.missing_report(spark.createDataFrame([], "a string"), {"a": F.col("a").isNull()}).collect()} == {("a", 0, 0.0)}


def test_durations(spark):
    rows = spark.createDataFrame([(1, " current", "01/01/2026", None), (2, "Resolved", "01/31/2026", "01/01/2026"), (3, "Current", None, None)], "row_id int, status string, a string, b string")
    from apothecary.functions.names import feed_date

    got = {r["row_id"]: (r["ongoing"], r["days"]) for r in market.durations(rows, "2026-01-31", feed_date(F.col("a")), feed_date(F.col("b"))).collect()}
    assert got == {1: (True, 30), 2: (False, 0), 3: (True, None)}
    assert dt.date(2026, 1, 31)
