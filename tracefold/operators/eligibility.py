"""Label mapping, eligibility and the rules that make preparation fail.

Raw rows carry ``source_project, record_number, issue_id, severity, creation_time,
summary, description, dupe_of`` as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracefold.functions.ids import stable_id
from tracefold.functions.instants import parse_aware
from tracefold.functions.text import (
    combined_text,
    exact_text_hash,
    is_blank,
    strip,
    with_canonical_text,
)
from tracefold.protocol import IntegrityError, LabelScheme

ERROR_STATES = ("missing_id", "unknown_label", "bad_timestamp")


def map_label(label: Column, scheme: LabelScheme, task: str) -> Column:
    """Class of a raw label; NULL for labels outside the scheme."""
    entries = [F.lit(x) for pair in scheme.targets[task].items() for x in pair]
    return F.create_map(*entries)[label]


def with_targets(df: DataFrame, scheme: LabelScheme, label: str = "severity_raw") -> DataFrame:
    return df.withColumns(
        {f"target_{t.lower()}": map_label(F.col(label), scheme, t) for t in scheme.tasks}
    )


def row_status(raw: DataFrame, scheme: LabelScheme) -> DataFrame:
    """Add the parsed fields and ``status``; an excluded label outranks bad time or text."""
    parsed = raw.withColumns(
        {
            "issue_id": strip(F.coalesce("issue_id", F.lit(""))),
            "severity_raw": F.coalesce("severity", F.lit("")),
            "creation_time": parse_aware(F.coalesce("creation_time", F.lit(""))),
            "dupe_of": strip(F.coalesce("dupe_of", F.lit(""))),
        }
    ).drop("severity")
    known = F.col("severity_raw").isin(*scheme.accepted, *scheme.excluded)
    # Canonical text is blank exactly when the raw text is, so the status is known, and
    # rows can drop out, before any text is rewritten.
    blank = [is_blank(F.coalesce(c, F.lit(""))) for c in ("summary", "description")]
    status = (
        F.when(F.col("issue_id") == "", "missing_id")
        .when(~known, "unknown_label")
        .when(F.col("severity_raw").isin(*scheme.excluded), "excluded_label")
        .when(F.col("creation_time").isNull(), "bad_timestamp")
        .when(blank[0] & blank[1], "missing_text")
        .otherwise("eligible")
    )
    return with_canonical_text(parsed.withColumn("status", status), "summary", "description")


def eligible_rows(statused: DataFrame, scheme: LabelScheme) -> DataFrame:
    """Typed rows with targets, text hash and stable id."""
    kept = with_targets(statused.filter("status = 'eligible'"), scheme)
    return kept.withColumns(
        {
            "text_combined": combined_text(F.col("summary"), F.col("description")),
            "exact_text_hash": exact_text_hash(F.col("summary"), F.col("description")),
            "stable_id": stable_id(F.col("source_project"), F.col("issue_id")),
        }
    ).drop("status")


def population(statused: DataFrame) -> DataFrame:
    """Rows per project by outcome."""
    def outcome(*states: str) -> Column:
        return F.count_if(F.col("status").isin(*states))

    return statused.groupBy(F.col("source_project").alias("project")).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        outcome("eligible").alias("eligible_rows"),
        outcome("excluded_label").alias("excluded_label_rows"),
        outcome("missing_text").alias("excluded_missing_text_rows"),
        outcome(*ERROR_STATES).alias("error_rows"),
    )


def repeated_ids(raw: DataFrame) -> DataFrame:
    """Ids that occur more than once in a project, with the record that repeats first."""
    ids = raw.select(
        "source_project",
        strip(F.coalesce("issue_id", F.lit(""))).alias("issue_id"),
        "record_number",
    ).filter("issue_id <> ''")
    return (
        ids.groupBy("source_project", "issue_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("record_number").alias("first_record"))
        .filter("n > 1")
    )


def row_violations(statused: DataFrame) -> DataFrame:
    """Rows that must stop preparation, with their record number."""
    return statused.filter(F.col("status").isin(*ERROR_STATES)).select(
        F.col("status").alias("rule"), "source_project", "record_number", "issue_id"
    )


def require_empty(violations: DataFrame, what: str) -> None:
    """Fail closed: raise with a sample when any violating row exists."""
    sample = violations.limit(5).collect()
    if sample:
        raise IntegrityError(f"{what}: {[row.asDict() for row in sample]}")


def mapping_drift(rows: DataFrame, scheme: LabelScheme) -> DataFrame:
    """Rows whose stored targets are not the image of their raw label."""
    drifted = F.lit(False)
    for task in scheme.tasks:
        stored = F.col(f"target_{task.lower()}")
        drifted = drifted | ~stored.eqNullSafe(map_label(F.col("severity_raw"), scheme, task))
    return rows.filter(drifted)
