"""Session construction and the shared scratch area.

Intermediate tables that must not be recomputed (range-sorted orders, component
labels, feature blocks) are written as Parquet below the folder the cluster names
in ``spark.checkpoint.dir``.  A written table survives executor loss, cuts the
lineage, keeps column pruning and gives the planner a real size, so that small
sides are broadcast because they were measured and not because they were hinted.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tracefold", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the configured checkpoint folder, or a local one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/tracefold/{app}/{label}-{uuid.uuid4().hex}"


#: Of a write: Spark deletes its shuffle files as soon as it is done, and hands long texts to Python
#: in batches of a few megabytes, which an executor holds outside its heap several times over.
_OF_WRITES = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table.

    The written table replaces the shuffles behind it, so their files go at once and do not
    fill the executors' disks until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = {key: spark.conf.get(key) for key in _OF_WRITES}
    try:
        for key, value in _OF_WRITES.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def _leaf_bytes(df: DataFrame) -> int:
    """Bytes of the files ``df`` reads; sources of unknown size (near 2**63) count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size for size in sizes if size < 1 << 60)


def shuffle_width(df: DataFrame, bytes_per_partition: int = 128 << 20) -> int:
    """Partitions for an explicit shuffle of ``df``.

    The configured number; more when the files ``df`` reads are so large that partitions
    of that number would not fit an executor, fewer (one per core or per megabyte) when
    they are so small that most partitions would be empty.
    """
    size = _leaf_bytes(df)
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if 0 < size < configured << 20:
        cores = df.sparkSession.sparkContext.defaultParallelism
        return max(min(cores, configured), -(-size // (1 << 20)))
    return max(configured, -(-size // bytes_per_partition))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash out a small scan of long texts so that every core gets a share.

    A file with one row group is one task, however slow its texts are to process.  From
    128 MB per core on, the scan has enough tasks of its own and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if _leaf_bytes(df) >= cores * (128 << 20):
        return df
    return df.repartition(cores, key)


def release_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table written by this application."""
    app = spark.sparkContext.applicationId
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/tracefold/{app}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
