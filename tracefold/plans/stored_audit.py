"""Audits that are kept per source and merged; an unchanged source is not read again.

What the audit needs of a source is a table of counts, (measure, value, n): flags, labels, one
entry per distinct length, the first and last instant.  Counts of parts add up, so a report over
all sources is a sum over stored tables.  A source is known by project, path and size; its
latest stored state counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracefold.operators.audit import weighted_statistics
from tracefold.sources.catalogue import pending_sources
from tracefold.session import materialize

FLAGS = ("severity_blank", "summary_missing", "summary_blank", "description_missing", "description_blank",
         "both_unavailable", "time_null", "fully_empty", "has_html", "has_url", "has_email", "has_code")
LENGTHS = ("summary_length", "description_length")
KEYS = ["project", "path", "size_bytes"]
SCHEMA = "project string, path string, size_bytes long, measure string, value string, n long"


def source_states(facts: DataFrame) -> DataFrame:
    """project, path, measure, value, n from row facts that carry ``path``.

    Every row adds to a few counts; equal ones meet before the shuffle.
    """
    flags = [f for f in FLAGS if f in facts.columns]

    def entry(measure: str, value) -> F.struct:
        return F.struct(F.lit(measure).alias("measure"), value.cast("string").alias("value"))

    entries = F.array(
        entry("rows", F.lit("")),
        *[F.when(F.col(f), entry("flag", F.lit(f))) for f in flags],
        F.when(~F.col("severity_blank"), entry("label", F.col("severity"))),
        *[entry(c, F.col(c)) for c in LENGTHS],
    )
    counted = facts.select(
        F.col("source_project").alias("project"), "path", F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("e")
    ).groupBy("project", "path", "e.measure", "e.value").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("project", "path", "measure", "value", "n")


class StoredAudit:
    """States of audited sources below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def pending(self, sources: DataFrame) -> DataFrame:
        return pending_sources(sources, self.read().filter("measure = 'rows'").select(*KEYS).distinct())

    def run(self, sources: DataFrame, facts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Merged (project, measure, value, n) of ``sources`` (project, path, size_bytes).

        ``facts_of`` gets the pending sources and returns the row facts, with ``path``, of these
        alone; it is not called when nothing is pending.
        """
        todo = materialize(self.pending(sources), "audit-pending")
        if not todo.isEmpty():
            fresh = source_states(facts_of(todo)).join(todo, ["project", "path"])
            # A source without a row is known by a count of zero.
            silent = todo.select("project", "path", F.lit("rows").alias("measure"), F.lit("").alias("value"), F.lit(0).cast("long").alias("n"), "size_bytes")
            columns = [*KEYS, "measure", "value", "n"]
            fresh.select(*columns).unionByName(silent.select(*columns)).write.mode("append").parquet(self.path)
        states = self.read().join(sources.select(*KEYS).distinct(), KEYS, "left_semi")
        return states.groupBy("project", "measure", "value").agg(F.sum("n").alias("n"))


def summary(merged: DataFrame) -> DataFrame:
    """project, rows and one column per flag."""
    wanted = {f: F.sum(F.when((F.col("measure") == "flag") & (F.col("value") == f), F.col("n")).otherwise(0)).alias(f) for f in FLAGS}
    rows = F.sum(F.when(F.col("measure") == "rows", F.col("n")).otherwise(0)).alias("rows")
    return merged.groupBy("project").agg(rows, *wanted.values())


def labels(merged: DataFrame) -> DataFrame:
    return merged.filter("measure = 'label'").select("project", F.col("value").alias("severity_raw"), "n")


def lengths(merged: DataFrame) -> DataFrame:
    """Exact statistics per project and field, from the counts per distinct length."""
    counted = merged.filter(F.col("measure").isin(*LENGTHS)).select(
        "project", F.regexp_replace("measure", "_length$", "").alias("field"), F.col("value").cast("long").alias("length"), "n"
    )
    return weighted_statistics(counted, ["project", "field"], "length")
