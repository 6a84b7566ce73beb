"""Matching without keys: parsing, exact near-pair search, matches and confidences."""

import random

from apothecary.llm import matching as M

NDC = "product_id string, product_ndc string, brand_name string, labeler_name string, dosage_form string, active_ingredients array<struct<name:string,strength:string>>, packaging array<struct<package_ndc:string>>"
OPEN = "struct<package_ndc:array<string>,product_ndc:array<string>>"
RECALLS = f"recall_number string, product_description string, code_info string, more_code_info string, openfda {OPEN}, score double"
SHORTAGES = f"package_ndc string, generic_name string, company_name string, presentation string, openfda {OPEN}"
PRODUCTS = [
    ("1", "00101-101", None, "Corvanta Laboratories, Inc.", "TABLET, FILM COATED", [("ZELOMIXAMER SODIUM", "20 mg/1")], [("00101-101-01",)]),
    ("2", "00102-201", "Belmora", "Telkava Drug Works", "INJECTION, SOLUTION", [("PARONAFENE", "0.5 mg/mL"), ("QUITADAZINE", "40 mg/mL")], [("00102-201-01",)]),
    ("3", "00101-102", None, "Corvanta Laboratories", "TABLET, FILM COATED", [("ZELOMIXAMER SODIUM", None)], None),
    ("4", "00101-103", None, "Corvanta Laboratories", "CAPSULE", None, None),
    ("5", "00101-104", None, "Corvanta Laboratories LLC", "TABLET, FILM COATED", [("ZELOMIXAMER SODIUM", "40 mg/1"), None], None),
]


def run(spark, recalls, shortages=(), **more):
    frames = [spark.createDataFrame(list(r), s) for r, s in ((recalls, RECALLS), (shortages, SHORTAGES), (PRODUCTS, NDC))]
    out = M.match(*frames, **more).collect()
    assert all(0 <= r["confidence"] <= 1 for r in out)
    return {(r["feed"], r["record_key"], r["product_ndc"]) for r in out if r["confidence"] >= M.ACCEPT}


def recall(key, text, code=None, openfda=None):
    return (key, text, code, None, openfda, 0.0)


def test_parsing():
    d = M.describe("Rx paronafene 500 mcg and quitadazine 0.04 g/1 mL Inj. soln - 10 x vial - Mfd. by: Dist. by Telkava Drug Works (USA) - Quiro", None, None)
    assert d == {"names": ["paronafene", "quitadazine"], "own": ["0.5", "40"], "salts": [], "strengths": ["0.5", "40"], "form": "injection", "maker": "telkava", "kind": "drug"}
    d = M.describe("quitadazine and paronafene 40 mg/0.5 mg inj, Mfg: Corvanta Meridian Pharma, Quiro", None, None)
    assert (d["names"], d["own"], d["maker"], d["kind"]) == (["paronafene", "quitadazine"], [None, None], "corvanta meridian", "pharma")
    d = M.describe("quitadazine 40 mg and paronafene 0.5 mg inj, Mfg: Telkava", None, None)
    assert (d["names"], d["own"]) == (["paronafene", "quitadazine"], ["0.5", "40"])
    d = M.describe("ZELOMIXAMER NA FC TABS, 1,000MG, BOTTLE OF 10, MADE FOR CORVANTA LABS INC.", None, None)
    assert (d["strengths"], d["salts"], d["form"], d["maker"], d["kind"]) == (["1000"], ["sodium"], "tablet", "corvanta", "laboratories")
    assert M.strengths("5 mg per g, 2 mg/1 mL, .5 mg/5 g") == ["0.5", "2", "5"]
    assert M.firm(None) == (None, None) and M.firm("Inc.") == (None, None)
    assert M.describe("", None, None)["names"] == []


def test_near_pairs_are_exact(spark):
    rng = random.Random(3)
    known = sorted({"".join(rng.choices("abcdeiour", k=rng.randrange(4, 12))) for _ in range(150)})
    asked = sorted({w[:p] + rng.choice("xyz") + w[p + rng.randrange(2) :] for w in known for p in [rng.randrange(len(w))]} | set(known[:20]))
    frame = lambda ws: spark.createDataFrame([(w, "") for w in ws], "word string, block string")
    got = {(r["asked"], r["known"]) for r in M.close_words(frame(asked), frame(known)).collect()}
    dice = lambda x, y: 1 - (x ^ y).bit_count() / (x.bit_count() + y.bit_count())
    v = {w: M.vector(w) for w in {*asked, *known}}
    want = {(a, k) for a in asked for k in known if (v[a] ^ v[k]).bit_count() <= M.RADIUS and dice(v[a], v[k]) >= M.LEAST_DICE}
    assert got == want and len(want) > 100


def test_names_meet_within_strengths_and_form_only(spark):
    rng = random.Random(4)
    words = lambda n: [("".join(rng.choices("abcdeiorstu", k=rng.randrange(5, 14))), str(rng.randrange(1, 26)), rng.choice([f for f, _ in M.FORMS])) for _ in range(n)]
    asked, known = (spark.createDataFrame(words(n), "word string, strengths string, form string").selectExpr("word", "concat_ws('#', strengths, form) AS block").distinct().cache() for n in (600, 900))
    met = M.candidates(asked, known).select("asked", "known", "block").distinct().count()
    assert 0 < met < 0.01 * asked.count() * known.count()
    v = {r["word"]: M.vector(r["word"]) for r in [*asked.collect(), *known.collect()]}
    dice = lambda x, y: 1 - (x ^ y).bit_count() / (x.bit_count() + y.bit_count())
    want = {(a["word"], k["word"], a["block"]) for a in asked.collect() for k in known.collect() if a["block"] == k["block"] and (v[a[0]] ^ v[k[0]]).bit_count() <= M.RADIUS and dice(v[a[0]], v[k[0]]) >= M.LEAST_DICE}
    assert {tuple(r) for r in M.close_words(asked, known).select("asked", "known", "block").collect()} == want


def test_strengths_and_whole_labelers_count(spark):
    recalls = [recall("S-1", "quitadazine 0.5 mg and paronafene 40 mg, injection, Packaged by Telkava Drug Works"), recall("S-2", "quitadazine 40 mg and paronafene 0.5 mg, injection, Packaged by Telkava Drug Works"), recall("S-3", "zelomixamer 20 mg tablets, Mfg: Corvanta Meridian Pharma"), recall("S-4", "zelomixamer 20 mg tablets, Mfg: Corvanta Pharma")]
    got = run(spark, recalls)
    assert ("recalls", "S-2", "00102-201") in got
    same = [recall(f"H-{k}", "zelomixamer 20 mg tablets, Mfg: Corvanta Laboratories") for k in range(12)]
    assert run(spark, same, hot_rows=3) == {("recalls", f"H-{k}", "00101-101") for k in range(12)}
    assert not {k for _, k, _ in got} & {"S-1", "S-3"}


def test_matches(spark):
    recalls = [
        recall("D-1", "zelomixamer na FC tabs, 20 MG, bottle of 30, Rx only, Mfd. by: Corvanta Labs, Quiro"), recall(" d-1 ", "zelomixamer na FC tabs, 20 MG, bottle of 30, Rx only, Mfd. by: Corvanta Labs, Quiro"),
        recall("D-2", "Zeolmixamer Tablets, film coated 20mg (bottles). Made for Corvatna Laboratories"), recall("D-3", "BELMORA INJECTION, 0.5 mg and 40 mg, vials, Mfg: Telkava"),
        recall("D-4", "quitadazine 40 mg and paronafene 0.5 mg, injection, Packaged by Telkava Drug Works"), recall("D-5", "zelomixamer 25 mg tablets, Mfg: Corvanta Laboratories"), recall("D-6", "zelomixamer 20 mg capsules, Mfg: Corvanta Laboratories"),
        recall("D-7", "zelomixamer 20 mg tablets, Mfg: Brimora Laboratories"), recall("D-8", "zelomixamer 20 mg tablets, Mfg: Corvanta Laboratories (NDC 00101-101-01)"), recall("D-9", "zelomixamer 20 mg tablets, Mfg: Corvanta Laboratories", None, (None, ["00101-101"])),
        recall(None, "zelomixamer 20 mg tablets, Mfg: Corvanta Laboratories"), recall("D-10", None), recall("D-11", ""), recall("D-12", "x" * 100_000), recall("D-13", "zelomixamer 40 mg tablets, Mfg: Corvanta Laboratories"), recall("D-14", "paronafene 0.5 mg injection, Mfg: Telkava"),
    ]
    short = [("0101-6001-01", "Zelomixamer Sodium", "The Corvanta Laboratories (USA)", "Zelomixamer film-coated tablets, 0.02 g (30 count bottle)", None), ("00101-101-01", "Zelomixamer", "Corvanta", "Zelomixamer tablets, 20 mg", None), ("pending", "Zelomixamer", "Corvanta", "Zelomixamer tablets, 20 mg", None), ("0101-6002-01", None, None, None, None)]
    assert run(spark, recalls, short) == {("recalls", k, "00101-101") for k in ("D-1", "D-2")} | {("recalls", k, "00102-201") for k in ("D-3", "D-4")} | {("recalls", "D-13", "00101-104"), ("shortages", "00101600101", "00101-101")}


def test_no_side_of_a_join_is_held_by_the_driver(spark, monkeypatch):
    plans = []
    write = M.materialise

    def planned(df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(M, "materialise", planned)
    recalls = [recall(f"D-{k}", "zelomixamer 20 mg tablets, Mfg: Corvanta Laboratories", "00101-101-01" if k % 2 else None) for k in range(6)]
    frames = [spark.createDataFrame(r, s) for r, s in ((recalls, RECALLS), ([], SHORTAGES), (PRODUCTS, NDC))]
    out = M.match(*frames)
    assert {r["record_key"] for r in out.collect()} == {"D-0", "D-2", "D-4"}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 5
    assert not [p for p in plans if "BroadcastExchange" in p]


def test_empty(spark):
    assert run(spark, []) == set()


def test_calibration_rises():
    table = M.calibrate({19: (90, 100), 18: (95, 100), 10: (1, 50), 3: (5, 5)})
    values = [table[b] for b in range(20)]
    assert values == sorted(values) and values[10] < 0.3 < 0.9 < values[19]
