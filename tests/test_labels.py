"""Events, identities, samples, provenance, ranges, tables in place: cases stated by hand and edge cases."""

import datetime as dt
import json
import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from apothecary.functions import names as N
from apothecary.operators import classify, graph, market, modeling, ranges
from apothecary.sources import feeds

# Stated by hand: texts and the category each must get.
PINNED = {
    "Shortage of an active ingredient": ("active_ingredient_shortage", "high"), "API shortage at the supplier": ("active_ingredient_shortage", "high"), "excipient shortage": ("inactive_ingredient_shortage", "high"),
    "Lack of sterility assurance": ("manufacturing_quality_problem", "high"), "Potency not stated": ("manufacturing_quality_problem", "low"), "CGMP deviations": ("manufacturing_quality_problem", "high"),
    "Manufacturing delays": ("manufacturing_capacity", "high"), "Awaiting FDA approval": ("regulatory_delay", "high"), "Delay in shipping of the drug": ("shipping_delay", "high"), "Unexpected demand": ("demand_increase", "high"),
    "Product discontinuation": ("product_discontinuation", "high"), "Labeling: wrong strength": ("labeling_packaging_error", "high"), "Marketed without an approved NDA/ANDA": ("regulatory_noncompliance", "high"),
    "Adverse reactions": ("adverse_event_signal", "high"), "Nothing known": ("unknown", "low"), "": ("unknown", "low"), None: ("unknown", "low"), "Shipping delay and increased demand": ("shipping_delay", "low"),
    "Failed dissolution\r specification": ("manufacturing_quality_problem", "high"),
}


def test_pinned_causes(spark):
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(PINNED)], "text string, cause_row int")
    got = {r["text"]: (r["cause"], r["confidence"]) for r in classify.classify(rows, F.col("text")).collect()}
    assert got == PINNED


def test_whole_events(spark):
    cols = "is_recall boolean, text string, classification string, availability string, status string, stage string"
    rows = [(True, " Sterility \n", " class I", None, "Ongoing", "x"), (False, None, None, "Unavailable", "Current", "x"), (False, "Demand increase", None, None, "RESOLVED", "x"), (True, None, None, None, None, None)]
    out = [r.asDict() for r in classify.events(spark.createDataFrame(rows, cols).coalesce(1)).collect()]
    assert [r["severity"] for r in out] == ["high", "high", "low", "medium"]
    assert [r["stage"] for r in out] == ["manufacturing", "unknown", "demand_planning", "unknown"]
    assert [r["secondary"] for r in out] == [["recall_event"], [], [], ["recall_event"]]
    assert [r["fallback"] for r in out] == [False, True, False, True]
    assert out[0]["evidence"] == ["FDA reason_for_recall: Sterility", "FDA classification:  class I", "FDA status: Ongoing"]
    assert out[1]["evidence"] == ["FDA shortage_reason: not supplied", "FDA status: Current", "FDA availability: Unavailable"]


def test_families(spark):
    one = spark.createDataFrame([("Temperature\rexcursion; COUNTERFEIT",), (None,)], "t string")
    assert [r[0] for r in one.select(classify.in_family(F.col("t"), classify.GAP_FAMILIES["counterfeit_or_tampering"])).collect()] == [True, False]


def test_identities(spark):
    s = spark.createDataFrame([("1-2", "D", "P", "C", "Gen"), ("1-2", "D", "P", "C", " GEN "), (None, None, None, None, " ")], "package_ndc string, initial_posting_date string, presentation string, company_name string, generic_name string")
    a, b, c = s.select(N.shortage_source_id().alias("s"), N.shortage_incident_id().alias("i")).collect()
    assert a["s"] == b["s"] and a["s"].startswith("1-2:") and len(a["s"]) == 14
    assert a["i"] == b["i"] and a["i"].startswith("shortage_event:") and c["i"] == f"shortage_record:{c['s']}"
    r = spark.createDataFrame([("R-1", "7", "p", "d"), ("", None, "p", "d")], "recall_number string, event_id string, product_description string, recall_initiation_date string")
    x, y = r.select(N.recall_source_id().alias("s"), N.recall_incident_id().alias("i")).collect()
    assert (x["s"], x["i"]) == ("R-1", "recall_event:7") and y["s"].startswith("event-missing-") and y["i"] == f"recall_record:{y['s']}"
    assert s.select(N.context(("package_ndc", "generic_name"))).collect()[2][0] == {}


def test_odd_letters(spark):
    cases = {"Ｆｕｌｌ ｗｉｄｔｈ": "full width", "ﬁne oﬃce™": "fine officetm", "№ ² ½ Ⅳ": "no 2 12 iv", "Ångström & Co": "angstrom and co", "e\u0301te\u0301": "ete", "日本": None, "𝐁old": "bold", "plain": "plain", "": None, None: None}
    df = spark.createDataFrame([(k, i) for i, k in enumerate(cases)], "t string, i int")
    assert {r["t"]: r["w"] for r in df.select("t", N.words(F.col("t")).alias("w")).collect()} == cases
    texts = ["Straße  ﬁnal", "ＦＵＬＬ\u3000width", "Über ™", "plain  TEXT", "İstanbul", "½ ㎎"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split())
    assert [r[0] for r in df.select(N.reason_text(F.col("t"))).collect()] == [plain(t) for t in texts]


def test_as_of():
    assert N.resolve_as_of("2026-01-02", "2026-03-04_05", None) == "2026-01-02"
    assert N.resolve_as_of(None, "2026-03-04_05", "2026-01-01T00:00") == "2026-03-04"
    assert N.resolve_as_of(None, None, "2026-01-01T00:00") == "2026-01-01"
    with pytest.raises(ValueError):
        N.resolve_as_of(None, "", None)


def test_holdouts_are_exact():
    rng = random.Random(2)
    for k in range(200):
        sizes = {f"c{k}": rng.choice([rng.randrange(1, 6), rng.randrange(1, 400)]) for k in range(rng.randrange(2, 13))}
        cover = {c for c, n in sizes.items() if n >= 3}
        total = round(sum(sizes.values()) * 0.15)
        want = {c: int(c in sorted(cover, key=lambda c: (sizes[c], c), reverse=True)[:total]) for c in sizes}
        for _ in range(total - sum(want.values())):
            if rest := [c for c, n in sizes.items() if want[c] < n - 1]:
                want[max(rest, key=lambda c: (0.15 * sizes[c] - want[c], sizes[c], c))] += 1
        assert modeling.holdout_sizes(sizes, total, 0.15, cover) == want
    assert modeling.holdout_sizes({"a": 3, "b": 3}, 1, 0.15, {"a", "b"}) == {"a": 0, "b": 1}
    assert modeling.holdout_sizes({}, 0, 0.15, set()) == {} and modeling.holdout_sizes({"a": 1}, 1, 0.15, set()) == {"a": 0}


def test_exact_split(spark):
    rows = spark.createDataFrame([(f"r{k:03d}", "abc"[k % 3] if k % 10 else "rare", "x") for k in range(200)], "id string, label string, split string")
    got = modeling.exact_split(rows, "id", "label").collect()
    assert Counter(r["split"] for r in got) == {"train": 140, "validation": 30, "test": 30}
    assert len({r["id"] for r in got}) == 200 and all(Counter(r["split"] for r in got if r["label"] == c)["test"] for c in ("a", "b", "c", "rare"))
    assert modeling.exact_split(rows.limit(0), "id", "label").count() == 0


def test_ranks_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), float(rng.randrange(40)), k, "x") for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, id int, _x string")
    for ranked in (ranges.numbered(df, ["g"], [F.col("v"), F.col("id")], "n").collect(),):
        for g in ("hot", "cold", None):
            mine = sorted((r for r in ranked if r["g"] == g), key=lambda r: (r["v"], r["id"]))
            assert [r["n"] for r in mine] == list(range(1, len(mine) + 1))
    hashed = ranges.by_hash(df, ["g"], F.sha2(F.col("id").cast("string"), 256), "id", "n").withColumn("h", F.sha2(F.col("id").cast("string"), 256)).collect()
    for g in ("hot", None):
        assert [r["n"] for r in sorted((r for r in hashed if r["g"] == g), key=lambda r: r["h"])] == list(range(1, sum(r[0] == g for r in rows) + 1))
    run = ranges.running(df, ["g"], [F.col("id")], "v", "t").collect()
    total = Counter()
    for g, v, k, _ in rows:
        total[g] += v
        assert next(r["t"] for r in run if r["id"] == k) == total[g]
    assert ranges.numbered(df.limit(0), ["g"], [F.col("v")], "n").count() == 0


def test_quota_sample(spark):
    rows = [(f"r{k:02d}", "a" if k < 30 else "b", f"t{k % 7}", k % 3 == 0) for k in range(40)] + [("n", None, None, None)]
    df = spark.createDataFrame(rows, "id string, label string, text string, edge boolean")
    got = modeling.quota_sample(df, "label", "text", "id", {"a": 10, "b": 50}, F.col("edge"), "s").collect()
    by = {c: [r for r in got if r["label"] == c] for c in "ab"}
    assert len(by["a"]) == 10 and sum(r["edge"] for r in by["a"]) >= 4 and len(by["b"]) == 10
    assert len({r["id"] for r in got}) == 20


def test_provenance_and_sets(spark):
    cols = "id string, a string, b string"
    labels = spark.createDataFrame([("1", "x", None), ("2", "x", "y"), ("2", "x", "z"), ("3", "x", "y"), ("4", "x", "y"), ("5", "x", "y"), (None, "x", "y")], cols)
    candidates = spark.createDataFrame([("1", "x", None), ("1", "x", None), ("2", "x", "y"), ("3", "x", "q"), ("4", "x", "y"), ("4", "x", "n")], cols)
    got = {r["id"]: r["outcome"] for r in modeling.provenance(labels, candidates, "id", ("a", "b")).collect()}
    assert got == {"1": "agrees", "2": "duplicate_label", "3": "differs", "4": "duplicate_candidate", "5": "no_candidate"}
    a = spark.createDataFrame([("1",), ("1",), (None,)], "k string")
    assert tuple(modeling.same_set(a, a.distinct()).first()) == (True, 0, 0)
    assert tuple(modeling.same_set(a, spark.createDataFrame([("2",)], "k string")).first()) == (False, 2, 1)


def test_tables_in_place(spark, tmp_path):
    path = f"{tmp_path}/t"
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    feeds.replace_table(one, path)
    feeds.replace_table(spark.read.parquet(path).withColumn("v", F.col("v") + 1), path)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 3)}
    with pytest.raises(Exception):
        feeds.replace_table(spark.read.parquet(path).withColumn("v", F.raise_error(F.lit("no")).cast("int")), path)
    assert spark.read.parquet(path).count() == 2 and len(list(tmp_path.iterdir())) == 1
    log = f"{tmp_path}/log"
    for _ in range(2):
        feeds.append_new(spark.createDataFrame([("a", 1), ("a", 1), (None, 3)], "k string, v int"), log, "k")
    feeds.append_new(spark.createDataFrame([("a", 9), ("c", 3)], "k string, v int"), log, "k")
    assert {tuple(r) for r in spark.read.parquet(log).collect()} == {("a", 1), ("c", 3)}
    assert feeds.read_lines(spark, f"{tmp_path}/absent.jsonl", one.schema).count() == 0
    splits = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "train")], "k string, split string")
    feeds.write_splits(splits, f"{tmp_path}/s")
    assert {tuple(r) for r in spark.read.json(f"{tmp_path}/s/manifest").select("split", "records").collect()} == {("train", 2), ("test", 1)}
    assert {json.loads(line)["k"] for f in (tmp_path / "s/rows/split=train").glob("*.json") for line in f.read_text().splitlines()} == {"a", "c"}
    with pytest.raises(Exception):
        feeds.write_splits(splits, f"{tmp_path}/s")


def test_failed_snapshot_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2026, 1, 1))], "a int, b date")
    with pytest.raises(ValueError):
        feeds.write_snapshot({"recalls": df}, str(tmp_path), "2026-01-01_00", {"recalls": 2})
    assert list(tmp_path.iterdir()) == []


NDC = "product_id string, product_ndc string, generic_name string, brand_name string, labeler_name string, dosage_form string, route array<string>, finished boolean, application_number string, active_ingredients array<struct<name:string,strength:string>>, packaging array<struct<package_ndc:string,description:string,sample:boolean>>"
DIRECTORY = [
    ("p1", "00001-001", "Zelo Sodium", None, "Alpha Inc", "TABLET", ["ORAL"], True, "NDA1", [("ZELO SODIUM", "5 mg")], [("00001-001-01", "b", False)]),
    ("p2", "00002-001", "Zelo Sodium", None, "Beta", "TABLET", ["ORAL", None], True, "NDA2", [("ZELO SODIUM", "5 mg")], None),
    ("p3", "00003-001", "Other", None, "Gamma", "TABLET", None, True, None, [("ZELO SODIUM", "9 mg"), ("MIRA", "1 mg")], None),
    ("p4", "00003-002", "Other", None, "Gamma", "TABLET", None, False, None, [("ZELO SODIUM", "9 mg")], None),
]


def test_drug_report(spark):
    ndc = spark.createDataFrame(DIRECTORY, NDC)
    products, pairs = graph.products(ndc), graph.product_ingredients(ndc)
    stopped = spark.createDataFrame([("p2", True, False), ("p3", False, True)], "product_id string, in_shortage boolean, in_recall boolean")
    needles = spark.createDataFrame([("zelo",), ("mira",), ("none",), ("",)], "q string").where("q <> ''")
    got = {r["q"]: tuple(r)[1:] for r in market.drug_report(needles, products, pairs, stopped, graph.equivalence_members(ndc), 1).collect()}
    assert got == {"zelo": (1, 2, 2, 1, 1, 1), "mira": (1, 2, 2, 1, 0, 0), "none": (0, 0, 0, 0, 0, 0)}
    top = [(r["q"], r["place"], r["product_id"]) for r in market.drug_alternatives(needles, products, pairs, stopped, 1).collect()]
    assert sorted(top) == [("mira", 1, "p2"), ("zelo", 1, "p3")]


def test_graph_is_published_whole_or_not(spark, tmp_path):
    ndc = spark.createDataFrame(DIRECTORY, NDC)
    fda = spark.createDataFrame([("NDA1", "Alpha")], "application_number string, sponsor_name string")
    resolved = spark.createDataFrame([(1, "p1", "package_ndc"), (2, None, "unmatched")], "row_id bigint, product_id string, method string")
    links = spark.createDataFrame([(9, "p2", "explicit_ndc_text")], "row_id bigint, product_id string, method string")
    made = graph.tables(ndc, fda, resolved, links)
    path = f"{tmp_path}/g"
    graph.publish(made, path)
    sizes = {k: v.count() for k, v in graph.read(spark, path).items()}
    assert sizes == {"products": 4, "makers": 3, "ingredients": 2, "product_ingredients": 5, "product_codes": 5, "packages": 1, "routes": 2, "applications": 2, "equivalence_members": 2, "shortage_products": 1, "recall_products": 1}
    with pytest.raises(FileExistsError):
        graph.publish(made, path)
    with pytest.raises(ValueError, match="nowhere"):
        graph.publish(made | {"routes": spark.createDataFrame([("zz", "oral")], "product_id string, route string")}, f"{tmp_path}/h")
    assert [p.name for p in tmp_path.iterdir()] == ["g"]
