"""Connected components: sets of records tied through shared entities.

Labels spread over the bipartite graph of records and entities: each entity takes the
smallest label of its records, each record the smallest of its entities, then each
label its own label (pointer jumping), until nothing changes. A label is the smallest
record id seen so far. Every round is written to the shared folder, and the round before deleted.

Skew: an entity with very many records is salted by record id; a label with very many
records is resolved by a map of at most a thousand entries. Both limits follow from the
number of rows, so the lists stay bounded at any size.

Defined cases: NULL and blank entity ids tie nothing; rows with the same record id are
one record; a record without id ties others but is never reported; empty input gives
an empty result.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apothecary.functions.text import is_blank, squash
from apothecary.session import materialise, release

HOT_ROWS = 100_000
HOT_KEYS = 1_000
#: Sorts behind every real id and marks records without one.
NAMELESS = chr(0x10FFFF)


def record_node(df: DataFrame, id_col: str) -> Column:
    """The id of a record; rows without one get a mark that depends on their content."""
    content = F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns])), 256)
    return F.when(is_blank(F.col(id_col)), F.concat(F.lit(NAMELESS), content)).otherwise(F.col(id_col))


def _hot(counts: DataFrame, key: str, limit: int) -> list:
    return [r[0] for r in counts.where(F.col("n") >= limit).select(key).collect()]


def lookup(pairs: dict, key: Column, otherwise: Column) -> Column:
    if not pairs:
        return otherwise
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in chain(*pairs.items())]), key), otherwise)


def components(ties: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """node, label of the bipartite edges ``ties`` (node, entity): label is the smallest node of the set."""
    edges = ties.where(F.col("entity").isNotNull()).distinct()
    edges = written = materialise(edges, "component-edges")
    total = edges.count()
    limit = max(hot_rows, total // HOT_KEYS)
    degrees = edges.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
    salts = {r["entity"]: 1 + r["n"] // max(1, limit // 2) for r in degrees.collect()}
    n_salt = lookup(salts, F.col("entity"), F.lit(1).cast("bigint"))
    edges = edges.withColumn("salt", F.pmod(F.xxhash64("node"), n_salt))
    labels = None
    while True:
        # At first each record is its own label.
        spread = edges.join(labels, "node") if labels is not None else edges.withColumn("label", F.col("node"))
        least = spread.groupBy("entity").agg(F.min("label").alias("label"))
        least = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), n_salt - 1)))
        stepped = edges.join(least, ["entity", "salt"]).groupBy("node").agg(F.min("label").alias("label"))
        stepped = materialise(stepped, "component-step")
        sizes = stepped.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        hot = _hot(sizes, "label", limit)
        targets = {r["node"]: r["label"] for r in stepped.where(F.col("node").isin(hot)).collect()} if hot else {}
        to = stepped.select(F.col("node").alias("at"), F.col("label").alias("target"))
        cold = F.when(~F.col("label").isin(hot), F.col("label")) if hot else F.col("label")
        # A NULL key would meet in one task: hot rows are spread over keys that match nothing.
        key = F.coalesce(cold, F.concat(F.lit(NAMELESS), F.col("node"))) if hot else cold
        jumped = stepped.withColumn("at", key).join(to, "at", "left")
        jumped = jumped.select("node", F.least("label", F.coalesce("target", lookup(targets, F.col("label"), F.col("label")))).alias("label"))
        jumped = materialise(jumped, "component-labels")
        release(stepped)
        if labels is not None:
            before = labels.select("node", F.col("label").alias("was"))
            moved = jumped.join(before, "node").where(F.col("label") != F.col("was")).limit(1).count()
        else:
            moved = jumped.where(F.col("label") != F.col("node")).limit(1).count()
        release(labels)
        labels = jumped
        if not moved:
            release(written)
            return labels


def ties(df: DataFrame, id_col: str, entity_cols: tuple[str, ...]) -> DataFrame:
    """Edges from each record to the entities it names, compared without case and white space."""
    names = F.array(*[F.concat(F.lit(f"{c}:"), squash(F.col(c))) for c in entity_cols])
    return df.select(record_node(df.select(id_col, *entity_cols), id_col).alias("node"), F.explode(names).alias("entity"))
