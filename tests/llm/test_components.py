"""Tied records and splits: brute force, hot entities, edge cases."""

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from apothecary.llm import components as C

SCHEMA = "candidate_id string, incident_id string, split_group_id string, cause string, node string, label string"
TIES = ("incident_id", "split_group_id")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "n", "l") if len(r) == 3 else (*r, "n", "l") for r in rows], SCHEMA)


def sets(spark, rows, **limits):
    out = C.components(C.ties(frame(spark, rows), "candidate_id", TIES), **limits)
    return {r["node"]: r["label"] for r in out.collect() if not r["node"].startswith(C.NAMELESS)}


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, (rid, *ids) in enumerate(rows):
        node = ("r", rid) if rid and rid.strip() else ("n", k)
        find(node)
        for c, v in zip("ig", ids):
            v = "".join((v or "").split()).lower()
            if v:
                a, b = find(node), find((c, v))
                parent[max(a, b)] = min(a, b)
    groups = {}
    for x in list(parent):
        if x[0] == "r":
            groups.setdefault(find(x), []).append(x[1])
    return {m: min(g) for g in groups.values() for m in g}


def check(spark, rows, **limits):
    got, want = sets(spark, rows, **limits), brute(rows)
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in want.items() if k != v}


def test_spellings_nulls_and_nameless(spark):
    rows = [("a", "I:1", None), ("b", " i : 1\t", "g"), ("c", None, "G"), ("d", "  ", ""), ("e", None, None), ("f", "x", None), (None, "x", "y"), ("g", None, "y"), ("c", "z", None), ("h", "Z", None), ("a", "I:1", None)]
    check(spark, rows)
    assert sets(spark, rows)["h"] == "a" and sets(spark, rows)["g"] == "f"


def test_long_chain_and_hot_entity(spark):
    chain = [(f"c{i:03d}", f"i{i // 2}", f"g{(i + 1) // 2}") for i in range(80)]
    hot = [(f"h{i:03d}", "hot", f"u{i}") for i in range(150)] + [(f"k{i:03d}", None, f"u{i}") for i in range(150)]
    check(spark, chain + hot, hot_rows=20)


def test_empty(spark):
    assert sets(spark, []) == {} and sets(spark, [("a", None, None)]) == {}
    assert C.assign(frame(spark, []), "candidate_id", TIES, F.col("cause"), {"train": 0.7, "test": 0.3}).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([f"r{i}" for i in range(12)] + [None]), st.sampled_from(["a", "A ", "b", "c", None, " "]), st.sampled_from(["p", "q", "Q", "r", "s", None])), max_size=25))
def test_against_brute_force(spark, rows):
    check(spark, rows)


def test_splits_keep_sets_together_and_shares(spark):
    rows = [(f"r{i:04d}", f"i{i // 3}", f"g{i // 7}" if i % 5 == 0 else None, f"c{i % 4}") for i in range(1500)] + [(f"z{i:03d}", "big", None, f"c{i % 4}") for i in range(200)]
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    out = {r["candidate_id"]: r["split"] for r in C.assign(frame(spark, rows), "candidate_id", TIES, F.col("cause"), shares).collect()}
    assert len(out) == len(rows)
    of = brute([r[:3] for r in rows])
    assert all(out[k] == out[v] for k, v in of.items())
    total = Counter(out.values())
    assert all(abs(total[s] / len(rows) - share) < 0.03 for s, share in shares.items())
    by = Counter((r[3], out[r[0]]) for r in rows)
    assert all(abs(by[c, s] / 425 - share) < 0.06 for c in ("c0", "c1", "c2", "c3") for s, share in shares.items())
