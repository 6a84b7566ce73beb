"""Leaked passages: exact against brute force, near ones by recall, blocks, edge cases."""

import random

import numpy as np

from apothecary.llm import leakage as L

WORDS = [f"w{i}" for i in range(300)]


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string"), spark.createDataFrame([(*i, "y") for i in items], "item_id bigint, text string, suite string")


def run(spark, docs, items, **more):
    return {(r["doc_id"], r["item_id"]) for r in L.find(*frames(spark, docs, items), **more).collect()}


def brute(docs, items, w=L.WINDOW):
    grams = lambda t: {tuple(x[i : i + w]) for x in [L.words(t)] for i in range(len(x) - w + 1)}
    return {(d, i) for d, t in docs for i, u in items if d is not None and i is not None and grams(t) & grams(u)}


def made(seed, edits=0):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(WORDS, k=40))) for i in range(25)]
    docs = []
    for d in range(60):
        text = rng.choices(WORDS, k=80)
        if d % 3 == 0:
            part = L.words(items[d % 25][1])[5 : 5 + rng.randrange(10, 24)]
            for _ in range(edits):
                part[rng.randrange(len(part))] = "changed"
            text[20:20] = part
        docs.append((d, " ".join(text)))
    return docs, items


def test_exact(spark):
    docs, items = made(1)
    docs += [(100, None), (101, ""), (102, "w1 w2"), (None, items[0][1]), (103, items[3][1].upper() + " " + items[4][1]), (104, items[3][1])]
    items += [(50, None), (51, ""), (52, "short one"), (None, items[0][1]), (53, items[3][1])]
    want = brute(docs, items)
    assert run(spark, docs, items) == want and len(want) > 12
    assert run(spark, docs, items, broadcast_words=200) == want


def test_hyphens_at_line_ends(spark):
    text = " ".join(WORDS[:14])
    broken = text.replace("w7 ", "w-\n7 ").replace("w9 ", "w-  \r\n 9 ")
    assert run(spark, [(1, broken), (2, text.replace("w7", "w-7"))], [(1, text)]) == {(1, 1)}


def test_near_passages_reach_the_target_recall(spark):
    docs, items = made(2, edits=1)
    grams = lambda t: [x[i : i + 14] for x in [L.words(t)] for i in range(len(x) - 13)]
    want = {(d, i) for d, t in docs if d % 3 == 0 for i, u in items if any(L.edit_distance(a, b, 1) <= 1 for a in grams(t) for b in grams(u))}
    got = run(spark, docs, items, edits=1, recall=0.95)
    assert got <= want and len(want) > 8 and len(got) >= 0.9 * len(want)


def test_recall_as_registered(spark):
    """20 words up to two edits apart, words replaced, put in and left out, against brute force; by both ways."""
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(WORDS, k=30))) for i in range(30)]
    docs = []
    for d in range(240):
        part = L.words(items[d % 30][1])[4:24]
        for _ in range(2):
            at = rng.randrange(len(part))
            part[at : at + rng.randrange(2)] = [] if rng.random() < 1 / 3 else ["changed"]
        docs.append((d, " ".join([*rng.choices(WORDS, k=12), *part, *rng.choices(WORDS, k=12)])))
    grams = lambda t: [x[i : i + 20] for x in [L.words(t)] for i in range(len(x) - 19)]
    want = {(d, d % 30) for d, t in docs if any(L.edit_distance(a, b, 2) <= 2 for a in grams(t) for b in grams(items[d % 30][1]))}
    got = run(spark, docs, items, window=20, edits=2)
    assert got <= want and len(want) > 150 and len(got) >= 0.95 * len(want)
    assert run(spark, docs, items, window=20, edits=2, broadcast_words=100) == got


def test_recall_of_single_windows():
    made = L.edited(20, 2, 3000, seed=99)
    k = L.repetitions(20, 2, 0.95, L.SAMPLES_NEAR)
    a, b = (L.signatures(np.array([w for p in made for w in p[side]], np.uint64), 20, k, L.SAMPLES_NEAR)[::20] for side in (0, 1))
    assert (a == b).any(axis=1).mean() >= 0.95


def test_walks():
    h = L.Hasher()(WORDS[:50])
    a, b = L.signatures(h, 14, 2, 12), L.signatures(h[10:], 14, 2, 12)
    assert np.array_equal(a[10:], b) and len(np.unique(a[:, 0])) == len(a)
    assert L.signatures(h[:5], 14, 1, 12).shape == (0, 1)
    assert L.edit_distance(list("abcd"), list("abxd"), 2) == 1 and L.edit_distance(list("abcd"), list("wxyz"), 2) == 3
    assert L.repetitions(14, 0, 0.95, 12) == 1 < L.repetitions(14, 2, 0.95, 5)


def test_empty(spark):
    assert run(spark, [], [(1, "a")]) == run(spark, [(1, "a")], []) == set()
