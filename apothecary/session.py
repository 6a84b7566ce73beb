"""Session defaults and the shared folder for intermediate tables.

Nothing here keeps data on one machine of a cluster: intermediate tables go to the
folder named by ``spark.checkpoint.dir``. Only where that setting is absent and the
master is local, as in tests, a folder on the local disk takes its place; a cluster
without the setting is an error. Intermediate tables are deleted as soon as nothing
reads them again, the others when the driver ends.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "apothecary") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("APOTHECARY_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is configured and the master is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="apothecary-")
        spark.sparkContext.setCheckpointDir(_FALLBACK[app])
    return _FALLBACK[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, deleted at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/apothecary/{name}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def file_system(spark: SparkSession, path: str):
    """The file system that holds a path, and the path in its terms."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*written: DataFrame | None) -> None:
    """Delete tables of ``materialise`` that nothing will read again."""
    for df in written:
        if df is not None and getattr(df, "_written_at", None):
            discard(df.sparkSession, df._written_at)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing will read again."""
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def width(spark: SparkSession) -> int:
    """Configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame) -> DataFrame:
    """A narrow scan over at least as many tasks as there are cores.

    For work that costs far more than moving its rows. Only inputs of fewer parts than
    cores are moved; larger ones, as on a cluster, stay as they were read.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
