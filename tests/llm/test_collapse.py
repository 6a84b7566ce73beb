"""Formatting-only duplicates: canonical form, hot keys, edge cases."""

from hypothesis import given, settings
from hypothesis import strategies as st

from apothecary.llm.collapse import collapse


def run(spark, rows, **limits):
    return {tuple(r) for r in collapse(spark.createDataFrame(rows, "feed string, id string, text string, key string"), **limits).collect()}


def brute(rows):
    groups = {}
    for feed, rid, text, _ in rows:
        if text and text.strip():
            parts = sorted(p for p in ("".join(c for c in x if c.isalpha() or c.isdecimal()) for x in text.lower().split(";")) if p)
            groups.setdefault((feed, ";".join(parts)), []).append(rid)
    return {(f, min(i for i in ids if i is not None), len(ids)) for (f, _), ids in groups.items() if any(i is not None for i in ids)}


def test_forms(spark):
    rows = [("a", "3", "Lot A; failed.", "k"), ("a", "1", "FAILED ;lot-a;;", "k"), ("a", "2", "lota failed", "k"), ("b", "1", "lot a;failed", "k"), ("a", "9", None, "k"), ("a", "8", " \t", "k"), ("a", "7", "?!", "k"), ("a", "6", "--", "k"), ("a", None, "lot a;failed", "k"), ("a", "5", "Über 5", "k"), ("a", "4", "über5", "k")]
    assert run(spark, rows) == {("a", "1", 3), ("a", "2", 1), ("b", "1", 1), ("a", "6", 2), ("a", "4", 2)}


def test_hot_keys_give_the_same(spark):
    rows = [("a", f"{i:04d}", "Same; text" if i % 3 else f"other {i}", "k") for i in range(300)] + [("b", f"{i:04d}", "text;same", "k") for i in range(50)]
    assert run(spark, rows, hot_rows=20) == run(spark, rows) == brute(rows)


def test_empty_and_long(spark):
    assert run(spark, []) == set()
    assert run(spark, [("a", "1", "x" * 300_000, "k"), ("a", "2", "X " * 300_000, "k")]) == {("a", "1", 2)}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.just("f"), st.integers(0, 99).map(lambda i: f"{i:02d}"), st.text("aB;. 1", max_size=6) | st.none(), st.none()), max_size=40))
def test_against_brute_force(spark, rows):
    assert run(spark, rows, hot_rows=3) == brute(rows)
