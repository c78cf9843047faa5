"""Source catalogue (project -> relative CSV path) and file presence."""

from __future__ import annotations

import tomllib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


class CatalogueError(ValueError):
    """The catalogue breaks its contract."""


def catalogue_frame(spark: SparkSession, projects: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(projects.items()), "project string, path string")


def catalogue_violations(catalogue: DataFrame, expected: DataFrame) -> DataFrame:
    """Missing and extra projects, and paths that are not safe relative CSV paths."""
    missing = expected.select("project").join(catalogue, "project", "left_anti").select(
        "project", F.lit("missing_project").alias("rule")
    )
    extra = catalogue.join(expected.select("project"), "project", "left_anti").select(
        "project", F.lit("extra_project").alias("rule")
    )
    path = F.coalesce("path", F.lit(""))
    unsafe = path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)")
    rule = F.when(unsafe, "unsafe_path").when(~path.rlike(r"(?i)[^/]\.csv$"), "not_csv")
    bad = catalogue.select("project", rule.alias("rule")).filter("rule is not null")
    return missing.unionByName(extra).unionByName(bad)


def load_catalogue(spark: SparkSession, path: str, expected: Sequence[str]) -> DataFrame:
    """Read a TOML catalogue with a ``version`` and a ``[projects]`` table."""
    try:
        with open(path, "rb") as handle:
            document = tomllib.load(handle)
    except (OSError, tomllib.TOMLDecodeError) as error:
        raise CatalogueError(f"cannot read catalogue {path}: {error}") from error
    projects, version = document.get("projects"), document.get("version")
    if not isinstance(projects, dict) or not all(isinstance(v, str) for v in projects.values()):
        raise CatalogueError("the catalogue needs a [projects] table of text paths")
    if isinstance(version, bool) or not isinstance(version, int) or version < 1:
        raise CatalogueError("the catalogue version must be a positive integer")
    frame = catalogue_frame(spark, projects)
    wanted = spark.createDataFrame([(p,) for p in expected], "project string")
    found = catalogue_violations(frame, wanted).collect()
    if found:
        raise CatalogueError(f"catalogue violations: {[tuple(r) for r in found]}")
    return frame


def file_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes) of every file below ``root``; the content column is never read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    )
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    prefix = base.rstrip("/") + "/"
    return files.select(
        F.regexp_replace(F.replace("path", F.lit(prefix), F.lit("")), "^/+", "").alias("path"),
        F.col("length").alias("size_bytes"),
    )


def verify_files(spark: SparkSession, root: str, catalogue: DataFrame) -> DataFrame:
    """Presence and size of each catalogue source."""
    found = file_sizes(spark, root)
    return catalogue.join(found, "path", "left").select(
        "project", "path", F.col("size_bytes").isNotNull().alias("exists"), "size_bytes"
    )


def pending_sources(sources: DataFrame, audited: DataFrame) -> DataFrame:
    """Sources whose (project, path, size) was not audited before."""
    keys = ["project", "path", "size_bytes"]
    return sources.join(audited.select(*keys), keys, "left_anti")
