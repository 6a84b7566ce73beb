"""What changed between consecutive full snapshots.

The last snapshot lives as a bucketed index from key to row digest in the shared
folder. A new snapshot is digested the same way and probes that index in a
bucket-to-bucket join without a shuffle; old values are fetched by row pointer for
changed keys only; then the new index takes the old one's place.

Defined cases: rows whose key or snapshot is NULL or blank are left out; of several
rows of a key the one ingested last counts (NULL first, ties to the larger row id);
a snapshot without valid rows removes every key; the first snapshot has no changes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.functions.text import is_blank, record_key, strip
from apothecary.session import discard, materialise, scratch, width


#: Row pointers that may be broadcast: eight bytes each, some megabytes at most.
FEW_CHANGES = 200_000


@dataclass(frozen=True)
class Feed:
    """How one feed names its keys and what counts as a change."""

    name: str
    watched: tuple[str, ...]

    def key(self) -> Column:
        return record_key(self.name)


FEEDS = (Feed("recalls", ("status", "classification")), Feed("shortages", ("status", "availability")))


def _plain(c: str) -> Column:
    return F.lower(strip(F.col(c)))


def digest(df: DataFrame, feed: Feed) -> DataFrame:
    """Key, digest of the watched fields and row pointer of one snapshot: one row a key.

    ``max_by`` combines on the map side, so a key that holds a third of the rows
    reaches its reducer as one row a task.
    """
    body = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), _plain(c)), F.lit("!")) for c in feed.watched])
    rows = df.select(
        F.lit(feed.name).alias("feed"),
        feed.key().alias("record_key"),
        F.struct(F.col("ingested_at"), F.col("row_id")).alias("at"),
        F.struct(F.unhex(F.md5(body)).alias("digest"), F.col("row_id")).alias("row"),
    ).where(F.col("record_key").isNotNull())
    last = rows.groupBy("feed", "record_key").agg(F.max_by("row", "at").alias("row"))
    return last.select("feed", "record_key", F.col("row.digest").alias("digest"), F.col("row.row_id").alias("row_id"))


class SnapshotIndex:
    """The bucketed key-to-digest index of one snapshot."""

    def __init__(self, spark: SparkSession, rows: DataFrame, buckets: int):
        self.spark, self.table, self.path = spark, f"snapshot_index_{uuid.uuid4().hex}", scratch(spark, "snapshot-index")
        (
            rows.repartition(buckets, "feed", "record_key")
            .write.bucketBy(buckets, "feed", "record_key")
            .sortBy("feed", "record_key")
            .option("path", self.path)
            .format("parquet")
            .saveAsTable(self.table)
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        discard(self.spark, self.path)


def probe(old: DataFrame, new: DataFrame) -> DataFrame:
    """feed, record_key, change_kind and the row pointers of both sides; equal keys leave no row."""
    o = old.select("feed", "record_key", F.col("digest").alias("old_digest"), F.col("row_id").alias("old_row_id"))
    n = new.select("feed", "record_key", F.col("digest").alias("new_digest"), F.col("row_id").alias("new_row_id"))
    kind = F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "removed").otherwise("changed")
    both = o.join(n, ["feed", "record_key"], "full_outer")
    return both.where(~F.col("old_digest").eqNullSafe(F.col("new_digest"))).select("feed", "record_key", kind.alias("change_kind"), "old_row_id", "new_row_id")


def snapshot_names(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Names of all deliveries in order, each with its spellings in the tables: a few short strings a delivery."""
    names = reduce(DataFrame.unionByName, [df.select("snapshot") for df in tables.values()]).where(~is_blank(F.col("snapshot")))
    spellings: dict[str, list[str]] = {}
    for raw, name in sorted(names.select("snapshot", strip(F.col("snapshot"))).distinct().collect()):
        spellings.setdefault(name, []).append(raw)
    return dict(sorted(spellings.items()))


def changes(spark: SparkSession, tables: dict[str, DataFrame], feeds: tuple[Feed, ...] = FEEDS, buckets: int | None = None) -> DataFrame:
    """All changes between consecutive snapshots: feed, snapshot (the later), record_key, change_kind, row pointers."""
    buckets = buckets or width(spark)
    found, index = [], None
    for name, spellings in snapshot_names(tables).items():
        # Plain equality reaches the scan, so parts of the table that hold other snapshots are not read.
        of = [digest(tables[f.name].where(F.col("snapshot").isin(spellings)), f) for f in feeds]
        new = SnapshotIndex(spark, reduce(DataFrame.unionByName, of), buckets)
        if index is not None:
            found.append(materialise(probe(index.rows(), new.rows()).withColumn("snapshot", F.lit(name)), "snapshot-changes"))
            index.drop()
        index = new
    if index is not None:
        index.drop()
    if not found:
        return spark.createDataFrame([], "feed string, record_key string, change_kind string, old_row_id bigint, new_row_id bigint, snapshot string")
    return reduce(DataFrame.unionByName, found)


def _side(changed: DataFrame, side: str, rows: DataFrame, watched: tuple[str, ...], few: bool) -> DataFrame:
    """``changed`` with the watched values of its rows of one side, fetched by row pointer."""
    wanted = changed.select(F.col(f"{side}_row_id").alias("row_id")).distinct()
    values = F.map_from_arrays(F.array(*map(F.lit, watched)), F.array(*map(F.col, watched))).alias(side)
    got = rows.join(F.broadcast(wanted) if few else wanted, "row_id", "left_semi").select(F.col("row_id").alias(f"{side}_row_id"), values)
    return changed.join(got, f"{side}_row_id")


def field_changes(spark: SparkSession, tables: dict[str, DataFrame], feeds: tuple[Feed, ...] = FEEDS, buckets: int | None = None) -> DataFrame:
    """One row per changed field with its value before and after.

    Only rows that a change points to leave the scan: up to ``FEW_CHANGES`` pointers are
    sent to all tasks, more meet the table in a shuffle of its pointers and watched fields.
    """
    changed = materialise(changes(spark, tables, feeds, buckets).where(F.col("change_kind") == "changed"), "snapshot-changed")
    few = changed.count() <= FEW_CHANGES
    parts = []
    for f in feeds:
        rows = tables[f.name].select("row_id", *f.watched)
        both = _side(_side(changed.where(F.col("feed") == f.name), "old", rows, f.watched, few), "new", rows, f.watched, few)
        both = both.select("feed", "snapshot", "record_key", F.explode(F.array(*map(F.lit, f.watched))).alias("field"), "old", "new")
        both = both.select("feed", "snapshot", "record_key", "field", F.col("old")[F.col("field")].alias("old_value"), F.col("new")[F.col("field")].alias("new_value"))
        parts.append(both.where(~F.lower(strip(F.col("old_value"))).eqNullSafe(F.lower(strip(F.col("new_value"))))))
    return reduce(DataFrame.unionByName, parts)
