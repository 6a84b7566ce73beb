"""Cross-split overlap against brute force, refined fingerprints, alignment, edge cases."""

import random

from apothecary.llm import overlap as O

SCHEMA = "candidate_id string, raw_text string, split string, source string, class string, words string"
WORDS = [f"w{i}" for i in range(400)]


def pairs(spark, rows):
    return {tuple(r) for r in O.record_pairs(spark.createDataFrame([(*r, "s", "c", "x") for r in rows], SCHEMA)).collect()}


def brute(rows):
    real = [(i, set(O.words(t)), s == "train") for i, t, s in rows if i and t and t.strip() and t.strip().lower() != O.PLACEHOLDER and (s == "train" or s in O.EVALUATION)]
    return {(min(i, j), max(i, j)) for i, a, t in real if t for j, b, u in real if not u and i != j and a and b and 4 * len(a & b) >= 3 * len(a | b)}


def made(seed, n, length):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        base = rng.choices(WORDS, k=length)
        rows.append((f"t{seed}{k:03d}", " ".join(base), "train"))
        changed = list(base)
        start = rng.randrange(length)
        for p in range(start, min(length, start + rng.randrange(length // 3 + 1))):
            changed[p] = rng.choice(WORDS)
        rows.append((f"e{seed}{k:03d}", " ".join(changed).upper(), rng.choice(O.EVALUATION)))
    return rows


def test_recall_against_brute_force(spark):
    for length in (60, 25, 8):
        rows = made(length, 60, length)
        want, got = brute(rows), pairs(spark, rows)
        assert got <= want and len(got) >= 0.98 * len(want) > 20


def test_hot_fingerprints_lose_nothing(spark):
    rng = random.Random(5)
    stock = " ".join(WORDS[:14])
    rows = [(f"t{k:03d}", f"{stock} {' '.join(rng.choices(WORDS, k=12))}", "train" if k % 2 else "test") for k in range(120)]
    rows += [(f"u{k:03d}", rows[k][1] + " extra", "test" if k % 2 else "train") for k in range(0, 120, 7)]
    df = spark.createDataFrame([(*r, "s", "c", "x") for r in rows], SCHEMA)
    recs = O.records(df).cache()
    key = lambda frame: {(r["train"], r["eval"]) for r in frame.collect()}
    assert key(O.class_pairs(recs, hot_pairs=1)) == key(O.class_pairs(recs, hot_pairs=10**9))
    assert pairs(spark, rows) == brute(rows)


def test_many_differing_numbers(spark):
    base = [f"{w}{'x' * (k % 5)}" for k, w in enumerate(WORDS[:100])]
    swap = lambda n, length: " ".join([*base[:length], *(str(100000 + n * 50 + k) for k in range(8))])
    rows = [(f"t{n}", swap(n, length), "train") for n, length in ((0, 60), (2, 100))]
    rows += [(f"e{n}", swap(n + 1, length), "test") for n, length in ((0, 60), (2, 100))]
    rows += [("e4", " ".join(base[:60]), "validation")]
    want = brute(rows)
    assert {("e0", "t0"), ("e2", "t2"), ("e4", "t0")} <= want
    assert pairs(spark, rows) == want


def test_scattered_edits(spark):
    rng, rows = random.Random(11), []
    for length, edits in ((16, 2), (20, 2), (30, 4), (60, 8)):
        for k in range(30):
            base = rng.sample(WORDS, length)
            changed = list(base)
            for p in [(k + (j + 1) * length // (edits + 1)) % length for j in range(edits)]:
                changed[p] = f"x{length}{k}{p}"
            rows += [(f"t{length}{k:02d}", " ".join(base), "train"), (f"e{length}{k:02d}", " ".join(changed), "test")]
        base = rng.sample(WORDS, length)
        rows += [(f"t{length}s", " ".join(base), "train"), (f"e{length}s", " ".join(rng.sample(base, length)), "test")]
    want = brute(rows)
    assert len(want) >= 4 * 31 and pairs(spark, rows) == want


def test_odd_records(spark):
    text = "Éclair lot seven failed the seal check twice in spring"
    rows = [("a", text, "train"), ("b", "ECLAIR, lot seven: failed the seal-check twice in spring!", "gold_evaluation"), ("a", text, "train"), ("c", text, "excluded"), ("d", None, "test"), ("e", " ", "test"), ("f", "[FDA reason missing] ", "test"), ("g", "[fda reason missing]", "train"), (None, text, "test"), ("h", "?!", "test"), ("i", text, None), ("j", "one two", "train"), ("k", "two one", "test")]
    assert pairs(spark, rows) == {("a", "b"), ("j", "k")}
    assert pairs(spark, []) == set()


def test_coverage_and_report(spark):
    text = " ".join(WORDS[:40])
    rows = [("a", text, "train", "s", "c", "x"), ("b", text, "test", "s", "c", "x"), ("c", " ".join(WORDS[:36]), "test", "r", "c", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["candidate_id"]: (r["train_classes"], r["coverage"], r["similarity"]) for r in O.coverage(df).collect()}
    assert got == {"b": (1, 1.0, 1.0), "c": (1, 1.0, 0.9)}
    assert {(r["split"], r["source"], r["records"]) for r in O.report(df).collect()} == {("test", "s", 1), ("test", "r", 1)}


def test_large_classes_are_cut(spark):
    rows = [(f"{'t' if k % 2 else 'e'}{k}", "one two three four five" if k < 40 else f"one two three four five{k}", "train" if k % 2 else "test") for k in range(60)]
    df = spark.createDataFrame([(*r, "s", "c", "x") for r in rows], SCHEMA)
    assert {tuple(r) for r in O.record_pairs(df, hot_rows=5).collect()} == brute(rows) == pairs(spark, rows)


def test_overlaps(spark):
    text = " ".join(WORDS[:40])
    rows = [("a", text, "train", "s", "c", "x"), ("b", text, "test", "s", "c", "x"), ("c", " ".join(WORDS[:36]), "test", "r", "c", "x"), ("d", "apart", "test", "r", "c", "x")]
    got = {r["candidate_id"]: (r["train_classes"], r["similarity"]) for r in O.overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"b": (1, 1.0), "c": (1, 0.9)}


def test_alignment():
    a = "a b c d e f g h".split()
    assert O.align(a, a) == 8
    assert O.align(a, "a b c d e x f g h".split()) == 8
    assert O.align(a, "x y z".split()) == 0
    assert O.align(a, "f g h a b c d e".split()) in (5, 6)
    assert O.align([], ["a"]) == 0
    assert O.align(["p"] * 30, ["p"] * 10) == 10
    rng = random.Random(3)
    for _ in range(50):
        x, y = (rng.choices("abcd", k=rng.randrange(30)) for _ in range(2))
        row = [0] * (len(y) + 1)
        for u in x:
            row = _lcs_row(row, u, y)
        assert O._common(x, y) == row[-1]


def _lcs_row(row, u, y):
    out = [0]
    for j, v in enumerate(y, 1):
        out.append(row[j - 1] + 1 if u == v else max(row[j], out[-1]))
    return out
