"""Duplication, weights, caps, support, sampling and agreement of labelled records."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apothecary.operators import ranges


def duplication(df: DataFrame, text: Column) -> DataFrame:
    """records, texts, repeated_texts, excess: how much of a table repeats."""
    sizes = df.groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count(F.lit(1)).alias("texts"), F.count_if(F.col("n") > 1).alias("repeated_texts"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))


def thresholds(df: DataFrame, text: Column, limits: tuple[int, ...]) -> DataFrame:
    """limit, texts, records: texts with at least ``limit`` copies, and their rows. One pass for all limits."""
    sizes = df.groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    one = sizes.agg(*[F.struct(F.lit(k).cast("bigint").alias("limit"), F.count_if(F.col("n") >= k).alias("texts"), F.coalesce(F.sum(F.when(F.col("n") >= k, F.col("n"))), F.lit(0)).alias("records")).alias(f"t{k}") for k in limits])
    return one.select(F.explode(F.array(*[f"t{k}" for k in limits])).alias("t")).select("t.*")


def cap_sizes(df: DataFrame, text: Column, incident: Column, caps: tuple[int, ...]) -> DataFrame:
    """cap, records: rows left when each text keeps at most ``cap`` incidents."""
    sizes = df.select(text.alias("text"), incident.alias("incident")).distinct().groupBy("text").agg(F.count("incident").alias("n"))
    one = sizes.agg(*[F.struct(F.lit(k).cast("bigint").alias("cap"), F.coalesce(F.sum(F.least(F.lit(k), "n")), F.lit(0)).cast("bigint").alias("records")).alias(f"c{k}") for k in caps])
    return one.select(F.explode(F.array(*[f"c{k}" for k in caps])).alias("c")).select("c.*")


def weights(df: DataFrame, row: str, incident: str, text: str) -> DataFrame:
    """row, filings, incidents, weight = 1 / (filings of the incident's text * incidents of the text).

    Both counts are aggregates joined back; nothing is gathered in a window. NULL is a value of its own.
    """
    pairs = df.groupBy(incident, text).agg(F.count(F.lit(1)).alias("filings"))
    texts = pairs.groupBy(text).agg(F.count(F.lit(1)).alias("incidents"))
    out = df.alias("d").join(pairs.alias("p"), F.col(f"d.{incident}").eqNullSafe(F.col(f"p.{incident}")) & F.col(f"d.{text}").eqNullSafe(F.col(f"p.{text}")))
    out = out.join(texts.alias("t"), F.col(f"d.{text}").eqNullSafe(F.col(f"t.{text}")))
    return out.select(F.col(f"d.{row}").alias(row), "p.filings", "t.incidents", (1 / (F.col("filings") * F.col("incidents"))).alias("weight"))


def capped(df: DataFrame, row: str, incident: str, text: str, cap: int) -> DataFrame:
    """Rows left when each incident keeps one filing a text and each text ``cap`` incidents, in hash order."""
    key = lambda c: F.sha2(F.col(c), 256)
    one = df.groupBy(text, incident).agg(F.min_by(row, F.struct(key(row).alias("k"), F.col(row).alias("r"))).alias(row))
    w = Window.partitionBy(text).orderBy(key(incident), incident)
    return one.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).select(row, incident, text)


def support(df: DataFrame, label: Column, incident: str, text: str, least: int = 3) -> DataFrame:
    """label, records, incidents, texts, sufficient (``least`` of both)."""
    out = df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("records"), F.countDistinct(incident).alias("incidents"), F.countDistinct(text).alias("texts"))
    return out.withColumn("sufficient", (F.col("incidents") >= least) & (F.col("texts") >= least))


def oversample(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as ``times`` says, with its copy number from 1."""
    return df.select("*", F.explode(F.sequence(F.lit(1), times)).alias("copy"))


def seeded(row: str, seed: str = "seed") -> Column:
    """The hash that puts rows in a random but fixed order."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(row)), 256)


def ranked_sample(df: DataFrame, stratum: str, row: str, quota: Column) -> DataFrame:
    """The first ``quota`` rows of each stratum in seeded hash order; hash ranges are ranked apart, so a stratum of any size is no burden."""
    ranked = ranges.by_hash(df, [stratum], seeded(row), row, "_n")
    return ranked.withColumn("_q", quota).where(F.col("_n") <= F.col("_q")).drop("_n", "_q")


def agreement(df: DataFrame, truth: Column, guess: Column, by: Column) -> DataFrame:
    """by, records, correct, pct (NULL where there are no records)."""
    right = F.count_if(truth.eqNullSafe(guess))
    return df.groupBy(by.alias("by")).agg(F.count(F.lit(1)).alias("records"), right.alias("correct"), F.round(F.try_divide(100.0 * right, F.count(F.lit(1))), 4).alias("pct"))


def nearest_rank(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, mean, median, p95 with the nearest rank ``floor(0.95 n)`` from zero.

    Exact ranks come from running counts of the distinct values over value ranges, so no group is
    collected as a list or sorted in one task.
    """
    each = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    run = ranges.running(each, [by], [F.col(value)], "c", "upto")
    sizes = each.groupBy(by).agg(F.sum("c").alias("n"), F.sum(F.col(value) * F.col("c")).alias("sum")).withColumnRenamed(by, "_by")
    run = run.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    p95 = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    return run.groupBy(by).agg(F.max("n").alias("n"), F.round(F.max("sum") / F.max("n"), 6).alias("mean"), F.round((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2, 6).alias("median"), at(p95).alias("p95"))


def missing_report(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """field, missing, pct of all fields in one pass; 0 percent of an empty table."""
    one = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(c).alias(f) for f, c in flags.items()])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing"), F.coalesce(F.round(F.try_divide(100.0 * F.col(f), F.col("_all")), 4), F.lit(0.0)).alias("pct")) for f in flags])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """rule, violations of each set of offending rows."""
    return reduce(DataFrame.unionByName, [bad.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations")) for name, bad in rules.items()])


def holdout_sizes(sizes: dict[str, int], total: int, share: float, cover: set[str]) -> dict[str, int]:
    """How many rows of each class are held out: ``total`` in all, one at least of each class in ``cover``, one left of every class.

    Each next row goes to the class that is furthest below its share; larger and later-named
    classes win ties, also where ``total`` does not cover every class. The bulk is given at
    once, so the work depends on the number of classes only. Where too few rows are left, all that may go are held out.
    """
    first = sorted((c for c in sizes if c in cover), key=lambda c: (sizes[c], c), reverse=True)[:total]
    given = lambda level: {c: max(int(c in first), min(n - 1, math.floor(share * n) - level), 0) for c, n in sizes.items()}
    low, high = 0, max(sizes.values(), default=0) + 1
    while low < high:
        middle = (low + high) // 2
        if sum(given(middle).values()) <= total:
            high = middle
        else:
            low = middle + 1
    # One level more than fits, since shares are not whole: the last rows are given one by one.
    out = given(low + 1)
    for _ in range(total - sum(out.values())):
        open_ = [c for c, n in sizes.items() if out[c] < n - 1]
        if not open_:
            break
        out[max(open_, key=lambda c: (share * sizes[c] - out[c], sizes[c], c))] += 1
    return out


def exact_split(df: DataFrame, row: str, label: str, share: float = 0.15) -> DataFrame:
    """row, label, split: validation and test of exactly ``share`` of all rows each, stratified by label, in seeded hash order."""
    sizes = {r["label"]: r["n"] for r in df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = round(sum(sizes.values()) * share)
    cover = {c for c, n in sizes.items() if n >= 3}
    validation = holdout_sizes(sizes, total, share, cover)
    test = holdout_sizes({c: n - validation[c] for c, n in sizes.items()}, total, share, cover)
    if not sizes:
        return df.select(row, label, F.lit("train").alias("split"))
    upto = lambda of: F.element_at(F.create_map(*[F.lit(x) for c, n in of.items() for x in (c, n)]), F.col(label))
    ranked = ranges.by_hash(df.select(row, label), [label], seeded(row), row, "_r")
    split = F.when(F.col("_r") <= upto(validation), "validation").when(F.col("_r") <= upto({c: validation[c] + test[c] for c in sizes}), "test").otherwise("train")
    return ranked.select(row, label, split.alias("split"))


def diverse_rank(df: DataFrame, by: list[str], text: str, row: str, seed: str, rank: str) -> DataFrame:
    """``df`` with its place within ``by``: the first of each text in seeded hash order first, repeats behind them.

    Meant for a bounded top of each group: a filter on the rank prunes before the shuffle.
    """
    rows = df.withColumn("_h", seeded(row, seed))
    keys = [*by, text]
    firsts = rows.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(F.min(F.struct("_h", row)).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    rows = rows.join(firsts, same).withColumn("_again", F.struct("_h", row) > F.col("_first")).drop("_first", *[f"_k{i}" for i in range(len(keys))])
    order = Window.partitionBy(*by).orderBy("_again", "_h", row)
    return rows.withColumn(rank, F.row_number().over(order)).drop("_h", "_again")


def quota_sample(pool: DataFrame, by: str, text: str, row: str, quota: dict[str, int], edge: Column, seed: str, edge_share: float = 0.4) -> DataFrame:
    """At most ``quota`` rows of each group: two fifths of them from the edge where it has as many, the rest from all others."""
    asked = F.element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col(by))
    rows = pool.withColumns({"_asked": asked, "_edge": F.coalesce(edge, F.lit(False))}).where(F.col("_asked").isNotNull())
    most = max(quota.values())
    first = diverse_rank(rows.where("_edge"), [by], text, row, seed, "_n").where(F.col("_n") <= most)
    first = first.where(F.col("_n") <= F.bround(F.col("_asked") * edge_share, 0)).drop("_n")
    counts = first.groupBy(by).agg(F.count(F.lit(1)).alias("_had"))
    rest = rows.join(first.select(row), row, "left_anti")
    rest = diverse_rank(rest, [by], text, row, f"{seed}+1", "_n").where(F.col("_n") <= most)
    rest = rest.join(F.broadcast(counts), by, "left").where(F.col("_n") <= F.col("_asked") - F.coalesce("_had", F.lit(0))).drop("_n", "_had")
    return first.unionByName(rest).drop("_asked", "_edge")


def provenance(labels: DataFrame, candidates: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """key, outcome of every labelled key: how its label and its candidate go together.

    ``duplicate_label`` and ``duplicate_candidate`` stand for keys with differing rows,
    ``no_candidate`` for labels without one, ``differs`` where a field is not the same.
    """
    body = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("\x00")).alias(f) for f in fields])), 256)
    side = lambda df, n: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(body).alias(f"{n}_n"), F.min(body).alias(f"{n}_body"))
    both = side(labels, "l").join(side(candidates, "c"), key, "left")
    outcome = F.when(F.col("c_n").isNull(), "no_candidate").when(F.col("l_n") > 1, "duplicate_label").when(F.col("c_n") > 1, "duplicate_candidate").when(F.col("l_body") != F.col("c_body"), "differs").otherwise("agrees")
    return both.select(key, outcome.alias("outcome"))


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """equal, only_a, only_b of the distinct rows of two one-column frames."""
    left = a.distinct().toDF("x").withColumn("in_a", F.lit(1))
    both = left.join(b.distinct().toDF("y").withColumn("in_b", F.lit(1)), F.col("x").eqNullSafe(F.col("y")), "full_outer")
    only_a, only_b = F.count_if(F.col("in_b").isNull()), F.count_if(F.col("in_a").isNull())
    return both.agg((only_a + only_b == 0).alias("equal"), only_a.alias("only_a"), only_b.alias("only_b"))
