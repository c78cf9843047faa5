"""The complete audit of a corpus: one scan of facts, all report tables from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracefold.operators import audit as A
from tracefold.protocol import LabelScheme
from tracefold.session import materialize
from tracefold.sources.stores import write_report


def audit_tables(raw: DataFrame, scheme: LabelScheme) -> dict[str, DataFrame]:
    """Every report of the audit; the narrow facts are written once and shared."""
    facts = materialize(A.row_facts(raw), "audit-facts")
    histogram = A.label_histogram(facts)
    return {
        "severity_by_project": histogram.filter("project is not null"),
        "severity_combined": histogram.filter("project is null").drop("project"),
        "unexpected_severity_labels": A.unexpected_labels(
            histogram, scheme.accepted + scheme.excluded
        ),
        "text_missing_audit": A.text_gaps(facts),
        "text_lengths": A.length_statistics(facts),
        "temporal_coverage": A.temporal_coverage(facts),
        "identifier_audit": A.identifier_audit(facts),
        "duplicate_summary": A.duplicate_summary(A.text_groups(facts)),
        "duplicate_groups": A.duplicate_groups(facts).orderBy(
            "scope", "projects", F.desc("row_count"), "text_sha256"
        ),
        "text_content_signals": A.signal_counts(facts),
    }


def write_audit(tables: dict[str, DataFrame], root: str) -> None:
    for name, table in tables.items():
        write_report(table, f"{root}/{name}", columns=table.columns)
