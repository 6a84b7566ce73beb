"""Connected components against union-find, hot entities and labels, edge cases."""

import random
from pathlib import Path

from apothecary.operators import components as C
from apothecary.session import shared_dir

SCHEMA = "id string, a string, b string, node string, label string, entity string"


def sets(spark, rows, **limits):
    df = spark.createDataFrame([(*r, "n", "l", "e") for r in rows], SCHEMA)
    out = C.components(C.ties(df, "id", ("a", "b")), **limits).collect()
    return {r["node"]: r["label"] for r in out if not r["node"].startswith(C.NAMELESS)}


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, (i, *names) in enumerate(rows):
        node = ("0", i) if i and i.strip() else ("1", str(k))
        for c, v in zip("ab", names):
            v = "".join((v or "").split()).lower()
            if v:
                x, y = find(node), find(("2", c, v))
                parent[max(x, y)] = min(x, y)
    groups = {}
    for x in list(parent):
        if x[0] == "0":
            groups.setdefault(find(x), []).append(x[1])
    return {m: min(g) for g in groups.values() for m in g}


def test_random_graphs(spark):
    rng = random.Random(8)
    rows = [(f"r{rng.randrange(90):03d}", rng.choice([None, " ", f"i{rng.randrange(60)}", f"I {rng.randrange(60)}"]), rng.choice([None, f"t{rng.randrange(80)}"])) for _ in range(140)]
    rows += [(None, "i1", "t1"), (None, "i2", "t1")]
    want = brute(rows)
    assert sets(spark, rows) == want == sets(spark, rows, hot_rows=2)


def test_chain_and_hot_entity(spark):
    chain = [(f"c{k:02d}", f"x{k}", f"x{k + 1}") for k in range(24)]
    chain = [(i, a, None) for i, a, _ in chain] + [(i, b, None) for i, _, b in chain]
    hot = [(f"h{k:02d}", "HOT", f"own{k}") for k in range(40)]
    got = sets(spark, chain + hot, hot_rows=4)
    assert {got[i] for i, *_ in chain} == {"c00"} and {got[i] for i, *_ in hot} == {"h00"}


def test_empty(spark):
    assert sets(spark, []) == sets(spark, [("a", None, " ")]) == {}


def test_rounds_are_deleted(spark):
    folder = Path(shared_dir(spark).removeprefix("file://")) / "apothecary"
    kept = lambda: {p.name for p in folder.glob("component-*")}
    before = kept()
    df = spark.createDataFrame([("a", "x", "y", "n", "l", "e"), ("b", "y", "y", "n", "l", "e")], SCHEMA)
    labels = C.components(C.ties(df, "id", ("a", "b")))
    assert {r["label"] for r in labels.collect()} == {"a"}
    assert len(kept() - before) == 1
