"""Strict CSV ingest: header discovery, ragged records, record and line numbers.

A file is read in as many tasks as it has splits, although quoted fields may hold line breaks.
``csv_records`` finds out where records start (see ``csv_splits``); the records are written to
Parquet once, and everything after that reads the written table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracefold.operators.ordering import top_per_group
from tracefold.operators.schemas import header_columns, header_delimiter
from tracefold.protocol import IntegrityError
from tracefold.sources.csv_splits import csv_records
from tracefold.session import materialize

MALFORMED_SAMPLES = 100
_BOM = "﻿"


class SchemaError(ValueError):
    """A CSV header cannot be used."""


@dataclass(frozen=True)
class CsvHeader:
    columns: tuple[str, ...]
    delimiter: str
    has_bom: bool
    duplicates: tuple[str, ...]


def _starts_with_bom(spark: SparkSession, path: str) -> bool:
    """The line reader drops a byte-order mark, so the first three bytes are read apart.

    In a folder the first file with content counts.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(target).isDirectory():
        files = [f for f in fs.listStatus(target) if f.isFile() and f.getLen() and f.getPath().getName()[0] not in "._"]
        if not files:
            return False
        target = min((f.getPath() for f in files), key=lambda p: p.getName())
    stream = fs.open(target)
    try:
        return [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]
    finally:
        stream.close()


def discover_header(spark: SparkSession, path: str) -> CsvHeader:
    """Delimiter, byte-order mark, columns and repeated names from the first line."""
    lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0)
    first = lines.select(
        F.is_valid_utf8("value").alias("valid"),
        F.make_valid_utf8("value").alias("line"),
    ).limit(1)
    line = F.regexp_replace("line", rf"\A{_BOM}|\r\z", "")
    delimiter = header_delimiter(line)
    row = first.select(
        "valid",
        line.alias("bare"),
        delimiter.alias("delimiter"),
        header_columns(line, delimiter).alias("columns"),
    ).first()
    if row is None or not row["bare"]:
        raise SchemaError(f"{path}: empty header")
    if not row["valid"]:
        raise SchemaError(f"{path}: header is not valid UTF-8")
    if row["delimiter"] is None:
        raise SchemaError(f"{path}: no delimiter found")
    columns = tuple(row["columns"])
    repeated = tuple(dict.fromkeys(c for c in columns if columns.count(c) > 1))
    return CsvHeader(columns, row["delimiter"], _starts_with_bom(spark, path), repeated)


def invalid_utf8_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files holding a line that is not valid UTF-8."""
    lines = spark.read.text(list(paths))
    return lines.where(~F.is_valid_utf8("value")).select(
        F.col("_metadata.file_path").alias("path")
    ).distinct()


def csv_problems(records: DataFrame) -> DataFrame:
    """Records that a strict reader refuses: bad bytes, a stray or an open quote."""
    return records.filter("problem is not null").select(
        F.col("source_project").alias("project"), "source_relative_path", "record_number", "ending_line", "problem"
    )


def _named_records(records: DataFrame, project: Column, header: CsvHeader) -> DataFrame:
    # The header is record 0.
    return records.filter("record_number > 0").select(
        project.alias("source_project"),
        F.col("path").alias("source_relative_path"),
        "record_number",
        "ending_line",
        F.size("fields").cast("long").alias("observed_fields"),
        F.lit(len(header.columns)).cast("long").alias("expected_fields"),
        "problem",
        *[F.coalesce(F.get("fields", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(header.columns)],
    )


def _require_readable(records: DataFrame) -> DataFrame:
    first = csv_problems(records).orderBy("source_relative_path", "record_number").limit(5).collect()
    if first:
        raise IntegrityError(f"refused records: {[r.asDict() for r in first]}")
    return records.drop("problem")


def scan_raw_csv(
    spark: SparkSession, project: str, path: str, header: CsvHeader | None = None
) -> DataFrame:
    """One project's records as text columns, in the order of its own header.

    Adds ``source_project, source_relative_path, record_number`` (1-based per file, every record
    counts, a blank line too), ``observed_fields, expected_fields, ending_line, problem``.
    Missing trailing fields and empty fields are empty text.
    """
    header = header or discover_header(spark, path)
    if header.duplicates:
        raise SchemaError(f"{project}: duplicate columns {list(header.duplicates)}")
    records = materialize(csv_records(spark, path, header.delimiter), "raw-csv")
    return _named_records(records, F.lit(project), header)


def read_raw_csv(
    spark: SparkSession, project: str, path: str, header: CsvHeader | None = None
) -> DataFrame:
    """``scan_raw_csv`` for files that a strict reader accepts; a problem stops the job."""
    return _require_readable(scan_raw_csv(spark, project, path, header))


def read_catalogue(spark: SparkSession, root: str, sources: dict[str, str]) -> DataFrame:
    """The files (or folders of files) of all projects, with one header, in one scan.

    ``sources``: relative path per project, as the catalogue lists them.
    """
    if not sources:
        raise SchemaError("the catalogue lists no project")
    headers = {p: discover_header(spark, f"{root}/{path}") for p, path in sorted(sources.items())}
    header = next(iter(headers.values()))
    other = [p for p, h in headers.items() if (h.columns, h.delimiter) != (header.columns, header.delimiter)]
    if other or header.duplicates:
        raise SchemaError(f"headers differ or repeat a column: {other or list(header.duplicates)}")
    records = materialize(csv_records(spark, [f"{root}/{x}" for x in sources.values()], header.delimiter), "raw-csv")
    project = F.coalesce(*[
        F.when(F.col("path").rlike(rf"/\Q{path}\E(/[^/]*)?$"), project) for project, path in sources.items()
    ])
    return _require_readable(_named_records(records, project, header))


def malformed_samples(records: DataFrame, k: int = MALFORMED_SAMPLES) -> DataFrame:
    """The first ragged records of each project."""
    ragged = records.filter("observed_fields <> expected_fields").select(
        F.col("source_project").alias("project"), "record_number", "ending_line",
        "observed_fields", "expected_fields",
    )
    return top_per_group(ragged, ["project"], [F.col("record_number")], k).drop("rank")


def required_width(header: CsvHeader, required: Sequence[str]) -> int:
    """Fields a record needs so that every required column is present."""
    absent = [c for c in required if c not in header.columns]
    if absent:
        raise SchemaError(f"missing required fields: {absent}")
    return max(header.columns.index(c) for c in required) + 1


def record_counters(records: DataFrame, needed: int) -> DataFrame:
    """Raw, parsed, field-audited and malformed records per project."""
    ragged = F.col("observed_fields") != F.col("expected_fields")
    usable = ~ragged | (F.col("observed_fields") >= needed)
    total = F.count(F.lit(1))
    return records.groupBy(F.col("source_project").alias("project")).agg(
        total.alias("raw_rows"),
        total.alias("parsed_rows"),
        F.count_if(usable).alias("field_audited_rows"),
        F.count_if(ragged).alias("malformed_rows"),
    )


def audit_records(records: DataFrame, needed: int) -> DataFrame:
    """Audit policy: records that reach every required field stay, padded with ''."""
    return records.filter(
        (F.col("observed_fields") == F.col("expected_fields"))
        | (F.col("observed_fields") >= needed)
    )


def prepare_records(records: DataFrame, needed: int) -> DataFrame:
    """Preparation policy: short records may stay, wide or too short ones stop the job."""
    bad = (F.col("observed_fields") > F.col("expected_fields")) | (
        F.col("observed_fields") < needed
    )
    sample = records.filter(bad).select(
        "source_project", "record_number", "observed_fields", "expected_fields"
    ).limit(5).collect()
    if sample:
        raise IntegrityError(f"malformed records: {[r.asDict() for r in sample]}")
    return records


def require_contract(header: CsvHeader, columns: Sequence[str], delimiter: str = ",") -> None:
    """Exact column order and delimiter."""
    if header.columns != tuple(columns):
        raise SchemaError("header differs from the expected columns")
    if header.delimiter != delimiter:
        raise SchemaError("delimiter differs from the expected one")


def as_issue_rows(records: DataFrame) -> DataFrame:
    """Rename the raw columns the audit and preparation operators read."""
    names = {
        "ID": "issue_id", "Severity": "severity", "Creation time": "creation_time",
        "Summary": "summary", "Description": "description", "Dupe of": "dupe_of",
    }
    out = records
    for old, new in names.items():
        if old in records.columns:
            out = out.withColumnRenamed(old, new)
    return out if "dupe_of" in out.columns else out.withColumn("dupe_of", F.lit(""))
