"""Parquet stores: processed rows, split roots, fold manifests, vector shards, results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracefold.functions.ids import stable_id
from tracefold.operators.eligibility import require_empty
from tracefold.operators.fingerprints import membership_digest
from tracefold.operators.memberships import repeated_members
from tracefold.protocol import (
    FAMILIES,
    PROCESSED_SCHEMA,
    ROLES,
    IntegrityError,
    LockedDataError,
)
from tracefold.session import shuffle_width

DEVELOPMENT_COLUMNS = (
    "source_project", "issue_id", "summary", "description", "text_combined",
    "target_s6", "target_s3", "target_s2",
)
SPLIT_COLUMNS = (
    "source_project", "issue_id", "creation_time", "severity_raw",
    "target_s6", "target_s3", "target_s2", "dupe_of", "exact_text_hash",
)


def with_stable_id(df: DataFrame) -> DataFrame:
    return df.withColumn("stable_id", stable_id(F.col("source_project"), F.col("issue_id")))


def write_processed(rows: DataFrame, path: str) -> None:
    """Typed rows, one folder per project; a large project keeps many files."""
    (
        rows.select(*[f.name for f in PROCESSED_SCHEMA])
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy("source_project")
        .parquet(path)
    )


def read_processed(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    rows = spark.read.schema(PROCESSED_SCHEMA).parquet(path)
    return with_stable_id(rows.select(*(columns or [f.name for f in PROCESSED_SCHEMA])))


def write_split(processed: DataFrame, memberships: DataFrame, development: str, locked: str) -> None:
    """Two physically separate roots, routed by ``memberships`` (stable_id, membership)."""
    for name, path in (("DEVELOPMENT", development), ("LOCKED_TEST", locked)):
        wanted = memberships.filter(F.col("membership") == name).select("stable_id")
        write_processed(processed.join(wanted, "stable_id", "left_semi"), path)


def read_development(spark: SparkSession, path: str) -> DataFrame:
    """Development rows with the eight modelling columns; repeated ids are an error."""
    rows = read_processed(spark, path, DEVELOPMENT_COLUMNS)
    require_empty(repeated_members(rows.select("stable_id")), "duplicate development ids")
    return rows


def read_split_rows(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """Text-free rows, after the artifact hashes below ``path`` matched ``expected``."""
    if expected is not None:
        require_empty(artifact_drift(expected, artifact_manifest(spark, path)), "artifact drift")
    return read_processed(spark, path, SPLIT_COLUMNS)


def require_unlock(token: str | None, expected: str) -> None:
    if token != expected:
        raise LockedDataError("held-out data is only for the final evaluation")


def read_locked_texts(spark: SparkSession, path: str, token: str | None, expected: str) -> DataFrame:
    require_unlock(token, expected)
    rows = read_processed(spark, path, ("source_project", "issue_id", "text_combined"))
    require_empty(repeated_members(rows.select("stable_id")), "duplicate held-out ids")
    return rows


def read_locked_labels(spark: SparkSession, path: str, token: str | None, expected: str) -> DataFrame:
    require_unlock(token, expected)
    return read_processed(
        spark, path, ("source_project", "issue_id", "target_s6", "target_s3", "target_s2")
    )


def write_memberships(memberships: DataFrame, path: str) -> None:
    """Fold manifests partitioned by family, fold and role, sorted by id in each file."""
    (
        memberships.select(
            "family", "fold", "role", "source_project", "issue_id", "stable_id", "creation_time"
        )
        .repartition("family", "fold", "role", F.crc32("stable_id") % shuffle_width(memberships))
        .sortWithinPartitions("family", "fold", "role", "stable_id")
        .write.mode("overwrite")
        .partitionBy("family", "fold", "role")
        .parquet(path)
    )


def read_membership(
    spark: SparkSession,
    path: str,
    *,
    family: str,
    fold: int,
    role: str,
    fingerprints: DataFrame | None = None,
    project: str | None = None,
) -> DataFrame:
    """One membership, authenticated against its stored digest before any project filter."""
    role = role.upper()
    if family not in FAMILIES or role not in ROLES:
        raise IntegrityError("unknown fold family or role")
    rows = spark.read.parquet(path).filter(
        (F.col("family") == family) & (F.col("fold") == fold) & (F.col("role") == role)
    )
    if fingerprints is not None:
        actual = membership_digest(rows, F.col("stable_id")).first()["fingerprint"]
        stored = fingerprints.filter(
            (F.col("family") == family) & (F.col("fold") == fold) & (F.col("role") == role)
        ).first()
        if stored is None or stored["fingerprint"] != actual:
            raise IntegrityError(f"fold membership differs from its fingerprint: {family} {fold} {role}")
    return rows if project is None else rows.filter(F.col("source_project") == project)


def artifact_manifest(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """SHA-256 and size of every file below ``root`` (files up to 2 GB)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return files.select(
        F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("artifact"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("size_bytes"),
    )


def artifact_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    both = expected.select("artifact", F.col("sha256").alias("expected_sha256")).join(
        actual.select("artifact", F.col("sha256").alias("actual_sha256")), "artifact", "full_outer"
    )
    return both.filter(~F.col("expected_sha256").eqNullSafe(F.col("actual_sha256")))


def write_shards(vectors: DataFrame, path: str) -> None:
    (
        vectors.select("source_project", "issue_id", F.col("embedding").cast("array<float>"))
        .write.mode("append")
        .option("compression", "zstd")
        .partitionBy("source_project")
        .parquet(path)
    )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    schema = "issue_id string, embedding array<float>, source_project string"
    return with_stable_id(spark.read.schema(schema).parquet(path))


def shard_manifest(vectors: DataFrame, provenance: dict) -> DataFrame:
    """Row count and membership digest per shard, with the encoder's provenance beside."""
    digest = membership_digest(vectors, F.col("stable_id"), ["source_project"])
    return digest.select(
        F.col("source_project").alias("project"),
        "row_count",
        F.col("fingerprint").alias("membership_sha256"),
        *[F.lit(v).alias(k) for k, v in provenance.items()],
    )


def write_report(table: DataFrame, path: str, fmt: str = "csv", columns: Sequence[str] | None = None) -> None:
    """Report tables: given columns or all in sorted order, one file."""
    chosen = list(columns or sorted(table.columns))
    writer = table.select(*chosen).coalesce(1).write.mode("overwrite")
    (writer.option("header", "true").csv(path) if fmt == "csv" else writer.json(path))


class ResultStore:
    """Append-only fit results keyed by experiment id and provenance."""

    SCHEMA = (
        "experiment_id string, stage string, task string, configuration_id string, "
        "representation string, classifier string, class_weight string, c double, "
        "text_view string, fold bigint, feature_count bigint, training_rows bigint, "
        "validation_rows bigint, status string, exception string, fit_seconds double, "
        "prediction_seconds double, reused boolean, warnings array<string>, "
        "metrics struct<macro_f1:double,balanced_accuracy:double,accuracy:double,weighted_f1:double>, "
        "per_class array<struct<class:string,precision:double,recall:double,f1:double,support:bigint>>, "
        "confusion_matrix array<array<bigint>>, provenance string"
    )

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.SCHEMA)

    def read(self) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(target):
            return self._empty()
        return self.spark.read.schema(self._empty().schema).parquet(self.path)

    def append(self, rows: list[dict]) -> None:
        fields = self._empty().schema
        data = [tuple(r.get(f.name) for f in fields) for r in rows]
        self.spark.createDataFrame(data, fields).coalesce(1).write.mode("append").parquet(self.path)

    def pending(self, grid: DataFrame, provenance: str) -> DataFrame:
        """Grid rows without a stored result; a stored result of other provenance raises."""
        stored = self.read()
        drift = stored.join(grid.select("experiment_id"), "experiment_id", "left_semi").filter(
            F.col("provenance") != provenance
        )
        require_empty(drift.select("experiment_id", "provenance"), "result provenance drift")
        return grid.join(stored.select("experiment_id"), "experiment_id", "left_anti")
