"""Structured Streaming forms: deliveries that arrive as files, and event windows with late rows.

A file-source stream reads new deliveries as they land; each micro-batch adds its rows
to their snapshots, kept beside the checkpoint, and writes anew the changes of each
snapshot it adds to and of the one after it. Events are counted in watermarked
windows, repeated events dropped within the watermark.

Defined cases: an empty micro-batch changes nothing; a snapshot may arrive in any number
of files, micro-batches and runs, its changes hold for what has arrived of it and are
replaced when more does; rows later than the watermark are dropped;
events without time or id are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from apothecary.functions.text import is_blank, strip
from apothecary.operators.snapshots import Feed, SnapshotIndex, digest, probe
from apothecary.session import width


def read_deliveries(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """A stream of the Parquet files below ``path``; the schema is stated, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").parquet(path)


_NAME = "snapshot_name="


def _kept_names(spark: SparkSession, kept: str) -> list[str]:
    """Names of all snapshots of which anything has arrived, in order."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(unquote(n[len(_NAME) :]) for n in found if n.startswith(_NAME))


def change_writer(feed: Feed, out: str, kept: str, buckets: int | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the rows of each snapshot in ``kept`` and its changes in ``out``.

    Nothing lives in the driver between batches. A batch that is replayed after a failure
    overwrites its own part of ``kept``, and changes are written whole for each snapshot.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("snapshot", strip(F.col("snapshot"))).where(~is_blank(F.col("snapshot")))
        touched = sorted(r[0] for r in rows.select("snapshot").distinct().collect())
        for name in touched:
            rows.where(F.col("snapshot") == name).write.mode("overwrite").parquet(f"{kept}/{_NAME}{quote(name, safe='')}/batch={batch_id}")
        names = _kept_names(spark, kept)
        indexes: dict[str, SnapshotIndex] = {}

        def index(name: str) -> DataFrame:
            if name not in indexes:
                arrived = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(f"{kept}/{_NAME}{quote(name, safe='')}")
                indexes[name] = SnapshotIndex(spark, digest(arrived, feed), buckets or width(spark))
            return indexes[name].rows()

        try:
            for old, new in zip(names, names[1:]):
                if old in touched or new in touched:
                    changes = probe(index(old), index(new)).withColumn("snapshot", F.lit(new))
                    changes.write.mode("overwrite").parquet(f"{out}/{_NAME}{quote(new, safe='')}")
        finally:
            for i in indexes.values():
                i.drop()

    return write


def stream_changes(deliveries: DataFrame, feed: Feed, out: str, checkpoint: str, buckets: int | None = None) -> StreamingQuery:
    """Work off everything that has arrived, then stop: the scheduled form of the snapshot difference.

    The next run goes on where this one stopped; snapshots are kept beside ``checkpoint``.
    """
    kept = f"{checkpoint.rstrip('/')}-snapshots"
    return deliveries.writeStream.foreachBatch(change_writer(feed, out, kept, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(out)


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """window_start, by, n, total of events; each event id counts once within the watermark."""
    rows = events.where(F.col("ts").isNotNull() & F.col("event_id").isNotNull()).withWatermark("ts", late)
    once = rows.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])
    counted = once.groupBy(F.window("ts", size).alias("w"), F.col(by)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, session_end, n: events of a user no further apart than ``gap``."""
    rows = events.where(F.col("ts").isNotNull() & F.col("user_id").isNotNull()).withWatermark("ts", late)
    counted = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
