"""File sources and sinks of the feeds: JSON envelopes, JSON lines, snapshots, split folders.

Defined cases: an envelope without a ``results`` list fails; blank lines are skipped;
lines that do not fit the schema fail with the line's text; a snapshot is published
whole or not at all and never overwritten; a missing snapshot folder lists as empty.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apothecary.session import discard, file_system as _fs

SNAPSHOT = re.compile(r"^\d{4}-\d{2}-\d{2}_\d{2}$")


@dataclass(frozen=True)
class Source:
    """A registered feed: its file name and the fields every record should have."""

    name: str
    file: str
    required: tuple[str, ...]


SOURCES = {
    "shortages": Source("shortages", "shortages.json", ("package_ndc", "generic_name", "company_name", "status")),
    "recalls": Source("recalls", "recalls.json", ("recall_number", "status", "classification", "recalling_firm")),
    "ndc": Source("ndc", "ndc.json", ("product_id", "product_ndc", "generic_name", "labeler_name")),
    "drugsfda": Source("drugsfda", "drugsfda.json", ("application_number", "sponsor_name")),
}


def source(name: str) -> Source:
    if name not in SOURCES:
        raise ValueError(f"unknown source: {name}; known are {', '.join(sorted(SOURCES))}")
    return SOURCES[name]


def read_envelope(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """Records of a ``{"meta": ..., "results": [...]}`` file with their 1-based place as ``pos``."""
    schema = T.StructType([T.StructField("results", T.ArrayType(record))])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = rows.withColumn("results", F.when(F.col("results").isNull(), F.raise_error(F.lit("no results list in the envelope")).cast(schema["results"].dataType)).otherwise(F.col("results")))
    return checked.select(F.posexplode("results").alias("pos", "r")).select((F.col("pos") + 1).cast("bigint").alias("pos"), "r.*")


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines that must all fit the schema; blank lines are skipped; a missing file is empty."""
    fs, p = _fs(spark, path)
    if not (fs.globStatus(p) or []):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def last_line_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of several lines of a key the last."""
    names = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("r")).select("r.*")


def write_snapshot(tables: dict[str, DataFrame], root: str, name: str, expected: dict[str, int] | None = None) -> None:
    """Publish a snapshot: written to a hidden folder beside its place, counted, then renamed in one step.

    ``expected`` holds the counts a delivery claims; a difference, or a missing table, publishes
    nothing and leaves nothing behind.
    """
    if not SNAPSHOT.match(name):
        raise ValueError(f"not a snapshot name: {name}")
    spark = next(iter(tables.values())).sparkSession
    fs, target = _fs(spark, f"{root}/{name}")
    if fs.exists(target):
        raise FileExistsError(f"{root}/{name}")
    held = f"{root}/.{name}-{uuid.uuid4().hex}"
    try:
        counts = {}
        for t, df in tables.items():
            df.write.parquet(f"{held}/{t}")
            counts[t] = spark.read.schema(df.schema).parquet(f"{held}/{t}").count()
        for t, n in (expected or {}).items():
            if counts.get(t) != n:
                raise ValueError(f"{t}: {counts.get(t)} rows, {n} expected; nothing was published")
        manifest = spark.createDataFrame([(name, t, n) for t, n in sorted(counts.items())], "snapshot string, source string, records bigint")
        manifest.write.parquet(f"{held}/manifest")
        if not fs.rename(_fs(spark, held)[1], target):
            raise FileExistsError(f"{root}/{name}")
    except BaseException:
        discard(spark, held)
        raise


def complete_snapshots(spark: SparkSession, root: str, needed: tuple[str, ...]) -> list[str]:
    """Names of the snapshots that hold all needed tables and a manifest, in order."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    whole = lambda n: all(fs.exists(_fs(spark, f"{root}/{n}/{t}/_SUCCESS")[1]) for t in (*needed, "manifest"))
    return sorted(n for n in names if SNAPSHOT.match(n) and whole(n))


def replace_table(rows: DataFrame, path: str) -> None:
    """Put ``rows`` in the place of the Parquet table at ``path``, which may be among what ``rows`` reads.

    The new table is written beside the old one and takes its place by renaming; a failure
    before that leaves the old table as it was.
    """
    spark = rows.sparkSession
    fs, target = _fs(spark, path)
    held, old = f"{target.getParent()}/.{target.getName()}-{uuid.uuid4().hex}", f"{target.getParent()}/.{target.getName()}-{uuid.uuid4().hex}"
    try:
        rows.write.parquet(held)
    except BaseException:
        discard(spark, held)
        raise
    if fs.exists(target):
        fs.rename(target, _fs(spark, old)[1])
    if not fs.rename(_fs(spark, held)[1], target):
        raise FileExistsError(path)
    discard(spark, old)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the Parquet table at ``path`` does not hold yet, each key once.

    A run that is repeated adds nothing: what was appended before is found by its key.
    """
    fs, target = _fs(rows.sparkSession, path)
    fresh = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
    if fs.exists(target):
        fresh = fresh.join(rows.sparkSession.read.schema(rows.schema).parquet(path).select(key), key, "left_anti")
    fresh.select(*rows.columns).write.mode("append").parquet(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder of JSON lines a split, with a manifest of counts beside them; ``path`` must be new."""
    rows.write.partitionBy("split").mode("errorifexists").json(f"{path}/rows")
    rows.groupBy("split").agg(F.count(F.lit(1)).alias("records")).coalesce(1).write.json(f"{path}/manifest")
