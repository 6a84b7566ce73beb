"""Splits that keep tied records together.

Records are tied by the connected components of the bipartite record-entity graph
(``apothecary.operators.components``: minimum-label propagation). Whole sets are then
assigned so that the label shares of each split come close to those of all records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apothecary.operators.components import HOT_KEYS, HOT_ROWS, NAMELESS, components, record_node, ties
from apothecary.session import materialise

__all__ = ["NAMELESS", "assign", "checks", "components", "ties"]


def assign(df: DataFrame, id_col: str, entity_cols: tuple[str, ...], label: Column, shares: dict[str, float], hot_rows: int = HOT_ROWS) -> DataFrame:
    """id_col and ``split``: whole sets go to one split, so that every split's label shares come close to the whole's.

    One rule at all sizes: sets are taken stratum by stratum, the largest sets first, and each
    stratum is shared out by what the splits still lack of its labels. A set of a thousandth
    of all rows is a stratum of its own and goes to the split where the squared deviation from
    the label targets falls most; the other sets are strata by main label and size to a factor
    of two. Within a stratum sets stand in hash order and are cut where the running number
    of rows passes each split's part; the running sums are taken over hash ranges, so no
    stratum is sorted in one task. The driver holds one short line a stratum and label.
    """
    base = df.select(record_node(df.select(id_col, *entity_cols), id_col).alias("node"), F.coalesce(label, F.lit("")).alias("class"))
    sets = components(ties(df, id_col, entity_cols), hot_rows)
    rows = materialise(base.join(sets, "node", "left").select("node", "class", F.coalesce("label", "node").alias("set")), "split-rows")
    cells = rows.groupBy("set", "class").agg(F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy("set").agg(F.sum("n").alias("n"), F.max_by("class", F.struct("n", "class")).alias("main"))
    limit = max(2, rows.count() // HOT_KEYS)
    alone = F.col("n") >= limit
    size = F.floor(F.log2("n")).cast("int")
    groups = groups.select("set", "n", F.when(alone, F.concat(F.lit("set:"), "set")).otherwise(F.concat(F.lit("strata:"), size.cast("string"), F.lit(":"), "main")).alias("stratum"))
    groups = materialise(groups, "split-groups")
    parts = _share_out(cells.join(groups.select("set", "stratum", F.col("n").alias("all")), "set"), shares)
    upto = F.element_at(F.create_map(*[F.lit(x) for c, v in parts.items() for x in (c, v)]), F.col("stratum")) if parts else F.array(F.lit(1.0))

    bins = groups.withColumn("bin", F.pmod(F.xxhash64("set"), F.lit(1024)))
    starts = bins.groupBy("stratum", "bin").agg(F.sum("n").alias("m"))
    run = Window.partitionBy("stratum").orderBy("bin")
    starts = starts.select("stratum", "bin", (F.sum("m").over(run) - F.col("m")).alias("start"), F.sum("m").over(Window.partitionBy("stratum")).alias("all"))
    inner = Window.partitionBy("stratum", "bin").orderBy(F.xxhash64("set"), "set")
    middle = F.col("start") + F.sum("n").over(inner) - F.col("n") / 2
    at = F.col("middle") / F.col("all")
    order = list(shares)
    choice = reduce(lambda acc, i: acc.when(at <= F.get(upto, F.lit(i)), order[i]), range(1, len(order)), F.when(at <= F.get(upto, F.lit(0)), order[0])).otherwise(order[-1])
    split = bins.join(starts, ["stratum", "bin"]).withColumn("middle", middle).select("set", choice.alias("split"))
    done = rows.join(split, "set").select("node", "split")
    return done.where(~F.col("node").startswith(NAMELESS)).select(F.col("node").alias(id_col), "split").distinct()


def _share_out(cells: DataFrame, shares: dict[str, float]) -> dict[str, list[float]]:
    """For each stratum the running shares at which it is cut between the splits."""
    strata: dict[str, dict[str, int]] = {}
    largest: dict[str, int] = {}
    for r in cells.groupBy("stratum", "class").agg(F.sum("n").alias("n"), F.max("all").alias("largest")).collect():
        strata.setdefault(r["stratum"], {})[r["class"]] = r["n"]
        largest[r["stratum"]] = max(r["largest"], largest.get(r["stratum"], 0))
    wanted: dict[str, int] = {}
    for counts in strata.values():
        for c, n in counts.items():
            wanted[c] = wanted.get(c, 0) + n
    have = {s: dict.fromkeys(wanted, 0.0) for s in shares}
    lack = lambda s, c: shares[s] * wanted[c] - have[s][c]
    out = {}
    for key, counts in sorted(strata.items(), key=lambda kv: (-largest[kv[0]], kv[0])):
        if key.startswith("set:"):
            worse = lambda s: sum(((k - lack(s, c)) ** 2 - lack(s, c) ** 2) / (shares[s] * wanted[c]) for c, k in counts.items())  # noqa: E731, B023
            best = min(shares, key=lambda s: (worse(s), s))
            part = {s: float(s == best) for s in shares}
        else:
            need = {s: sum(max(0.0, lack(s, c)) * k for c, k in counts.items()) for s in shares}
            part = {s: v / sum(need.values()) for s, v in need.items()} if sum(need.values()) else dict(shares)
        for s in shares:
            for c, k in counts.items():
                have[s][c] += part[s] * k
        cut, so_far = [], 0.0
        for s in shares:
            so_far += part[s]
            cut.append(so_far)
        out[key] = cut
    return out


def checks(df: DataFrame, assigned: DataFrame, id_col: str, entity_cols: tuple[str, ...], label: Column, shares: dict[str, float], tolerance: float = 0.01) -> DataFrame:
    """rule, violations of an assignment: sets and records in two splits, records in none, and labels
    whose records in a split are off their share by more than ``tolerance`` of all records."""
    sets = components(ties(df, id_col, entity_cols))
    named = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("node"), label.alias("class")).distinct()
    placed = assigned.select(F.col(id_col).alias("node"), "split")
    n = lambda rows, rule: rows.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))
    several = lambda rows, key: rows.groupBy(key).agg(F.countDistinct("split").alias("k")).where("k > 1")
    rows = named.join(placed, "node")
    most = max(1.0, tolerance * named.count())
    targets = named.groupBy("class").agg(F.count(F.lit(1)).alias("wanted")).withColumn("split", F.explode(F.array(*map(F.lit, shares))))
    share = reduce(lambda acc, kv: acc.when(F.col("split") == kv[0], kv[1]), list(shares.items())[1:], F.when(F.col("split") == next(iter(shares)), next(iter(shares.values()))))
    have = rows.groupBy("class", "split").agg(F.count(F.lit(1)).alias("have")).withColumnsRenamed({"class": "of", "split": "in"})
    off = targets.join(have, targets["class"].eqNullSafe(have["of"]) & (targets["split"] == have["in"]), "left").withColumn("off", F.abs(F.coalesce("have", F.lit(0)) - share * F.col("wanted")))
    off = off.where(F.col("off") > most)
    parts = [n(several(sets.join(placed, "node"), "label"), "set_in_two_splits"), n(several(placed, "node"), "record_in_two_splits"), n(named.select("node").distinct().join(placed, "node", "left_anti"), "record_without_split"), n(off, "label_off_its_share")]
    return reduce(DataFrame.unionByName, parts)
