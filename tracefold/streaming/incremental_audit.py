"""Incremental quality audit: only files not seen before, running totals per project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracefold.operators.audit import row_facts
from tracefold.session import scratch_path

FLAGS = (
    "severity_blank", "summary_missing", "summary_blank", "description_missing",
    "description_blank", "both_unavailable", "time_null", "fully_empty",
    "has_html", "has_url", "has_email", "has_code",
)


def running_counters(facts: DataFrame, *keys: str) -> DataFrame:
    """Counters that add up across micro-batches."""
    flags = [f for f in FLAGS if f in facts.columns]
    extra = (
        [
            F.count_if(~F.col("time_null") & F.col("instant").isNull()).alias("time_failed"),
            F.min("instant").alias("earliest"),
            F.max("instant").alias("latest"),
        ]
        if "instant" in facts.columns else []
    )
    return facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(f)).alias(f) for f in flags],
        *extra,
    )


def audit_stream(
    spark: SparkSession, path: str, schema, prepare, aggregate, checkpoint: str, sink: str,
    pattern: str = "*.parquet",
) -> None:
    """Read new Parquet files below ``path`` and fold them into the totals at ``sink``.

    ``path`` is a folder, or a glob of files and folders; ``pattern`` is that of file names.
    ``prepare`` maps the stream to rows, ``aggregate`` groups them.  State and file log
    live in ``checkpoint``; each trigger rewrites the small totals table.
    """
    stream = (
        spark.readStream.schema(schema)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .parquet(path)
    )

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    totals = aggregate(prepare(stream))
    # A stream without files runs no batch: its totals are empty.
    spark.createDataFrame([], totals.schema).write.mode("ignore").parquet(f"{sink}/batch=-1")
    query = (
        totals.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )
    query.awaitTermination()


def latest_totals(spark: SparkSession, sink: str) -> DataFrame:
    totals = spark.read.parquet(sink)
    last = totals.agg(F.max("batch")).first()[0]
    return totals.filter(F.col("batch") == last).drop("batch")


def table_glob(folder: str, name: str) -> str:
    """A glob of the table ``name``, be it one file or a folder of files.

    A stream takes the plain path of one file for a folder of partitions, and refuses it.
    """
    return f"{folder}/{name}.parque[t]"


def audit_issue_stream(spark: SparkSession, path: str, schema, checkpoint: str, sink: str) -> DataFrame:
    """Issue rows (source_project, record_number and the five text fields) as a stream."""
    audit_stream(
        spark, path, schema, row_facts,
        lambda facts: running_counters(facts, "source_project"), checkpoint, sink,
    )
    return latest_totals(spark, sink)


def scratch_stream_paths(spark: SparkSession, label: str) -> tuple[str, str]:
    root = scratch_path(spark, label)
    return f"{root}/checkpoint", f"{root}/totals"

