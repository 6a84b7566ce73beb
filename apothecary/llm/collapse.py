"""Collapse records that differ only in white space, case, punctuation or part order.

Canonical keys are hashed to 256 bits. Keys with very many copies are found exactly
from partial counts; their rows are salted by identifier and aggregated on two levels,
all other keys on one. The representative is the smallest identifier.

Defined cases: NULL and blank texts never count; a text of punctuation only has the
empty key and equals other such texts; repeated rows count as copies; NULL ids are
never representatives but count; empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apothecary.functions.text import is_blank
from apothecary.session import materialise, width

#: A key is hot from this many copies on, or from a thousandth of all rows where that is more:
#: so there are never more than a thousand hot keys, whatever the input.
HOT_ROWS = 50_000
HOT_KEYS = 1_000


def canonical(text: Column) -> Column:
    """Letters and digits in lower case; parts between semicolons in order, without empty ones."""
    parts = F.transform(F.split(F.lower(text), ";"), lambda p: F.regexp_replace(p, r"[^\p{L}\p{Nd}]+", ""))
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), ";")


def collapse(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """feed, kept, copies of ``rows`` (feed, id, text); every distinct key gives one row."""
    keyed = rows.where(~is_blank(F.col("text"))).select("feed", F.unhex(F.sha2(canonical(F.col("text")), 256)).alias("key"), "id")
    keyed = materialise(keyed, "collapse-keys")
    limit = max(hot_rows, keyed.count() // HOT_KEYS)
    counts = keyed.groupBy("feed", "key").agg(F.count(F.lit(1)).alias("n"))
    hot = [bytes(r["key"]) for r in counts.where(F.col("n") >= limit).select("key").distinct().collect()]
    totals = [F.count(F.lit(1)).alias("copies"), F.min("id").alias("kept")]
    if not hot:
        return keyed.groupBy("feed", "key").agg(*totals).select("feed", "kept", "copies")
    is_hot = F.col("key").isin(hot)
    salted = keyed.where(is_hot).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(4 * width(rows.sparkSession))))
    two = salted.groupBy("feed", "key", "salt").agg(*totals).groupBy("feed", "key").agg(F.sum("copies").alias("copies"), F.min("kept").alias("kept"))
    one = keyed.where(~is_hot).groupBy("feed", "key").agg(*totals)
    return one.unionByName(two).select("feed", "kept", "copies")
