"""Duplicate graph: equal texts and resolved duplicate links.

Rows with one text hash are contracted to a single vertex first, so the graph holds
only hashes that a link touches.  A vertex is named by the smallest stable id that
carries its hash, which makes a component's id the smallest stable id in it.

Input rows carry ``stable_id, source_project, issue_id, dupe_of, exact_text_hash``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracefold.functions.ids import duplicate_reference
from tracefold.operators.components import connected_components
from tracefold.session import materialize

REASON_AMBIGUOUS_TEXT = "malformed_or_ambiguous_reference"
REASON_EXTERNAL = "target_not_eligible_or_external"
REASON_AMBIGUOUS_TARGET = "ambiguous_target"


def text_owners(rows: DataFrame) -> DataFrame:
    """One row per text hash: its smallest stable id and how many rows share it."""
    return rows.groupBy("exact_text_hash").agg(
        F.min("stable_id").alias("owner"), F.count(F.lit(1)).alias("row_count")
    )


def exact_duplicate_edges(rows: DataFrame) -> DataFrame:
    """Star edges row -> owner of its hash, for rows that are not their own owner.

    Hashes carried by one row drop out before the join back to the rows.
    """
    shared = text_owners(rows).filter("row_count > 1").select("exact_text_hash", "owner")
    return (
        rows.select("stable_id", "exact_text_hash")
        .join(shared, "exact_text_hash")
        .filter("stable_id <> owner")
        .select(F.col("stable_id").alias("u"), F.col("owner").alias("v"))
    )


def resolve_links(rows: DataFrame) -> DataFrame:
    """Every row holding a duplicate link, with its target and an outcome.

    ``outcome`` is ``resolved``, ``self_reference`` or a reason for no resolution.
    Targets are looked up across all projects.
    """
    links = rows.select(
        "stable_id",
        "source_project",
        "exact_text_hash",
        duplicate_reference(F.col("dupe_of")).alias("reference"),
    ).filter("reference is not null")
    targets = rows.groupBy(F.col("issue_id").alias("reference")).agg(
        F.count(F.lit(1)).alias("matches"),
        F.min("stable_id").alias("target_id"),
        F.min("exact_text_hash").alias("target_hash"),
    )
    outcome = (
        F.when(F.col("reference") == "", REASON_AMBIGUOUS_TEXT)
        .when(F.col("matches").isNull(), REASON_EXTERNAL)
        .when(F.col("matches") > 1, REASON_AMBIGUOUS_TARGET)
        .when(F.col("target_id") == F.col("stable_id"), "self_reference")
        .otherwise("resolved")
    )
    found = links.join(targets, "reference", "left").withColumn("outcome", outcome)
    settled = F.col("outcome").isin("resolved", "self_reference")
    return found.select(
        "stable_id",
        "source_project",
        "exact_text_hash",
        "reference",
        "outcome",
        F.when(settled, F.col("target_id")).alias("target_id"),
        F.when(settled, F.col("target_hash")).alias("target_hash"),
    )


def shared_components(rows: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(exact_text_hash, component) for hashes that several rows or a link touch.

    A hash of one unlinked row is missing here: such a row is its own component.
    """
    links = resolve_links(rows) if links is None else links
    edges = (
        links.filter("outcome = 'resolved' and exact_text_hash <> target_hash")
        .select(F.col("exact_text_hash").alias("u"), F.col("target_hash").alias("v"))
    )
    labels = connected_components(edges).withColumnRenamed("node", "exact_text_hash")
    # The link graph is usually a small part of all hashes; its written labels tell
    # the planner whether they can be broadcast.
    labels = materialize(labels, "hash-labels")
    owners = text_owners(rows)
    named = labels.join(owners, "exact_text_hash").groupBy(
        F.col("component").alias("root")
    ).agg(F.min("owner").alias("component_id"))
    lookup = labels.select("exact_text_hash", F.col("component").alias("root")).join(named, "root")
    found = owners.join(lookup, "exact_text_hash", "left").filter(
        "row_count > 1 or component_id is not null"
    )
    return materialize(
        found.select("exact_text_hash", F.coalesce("component_id", "owner").alias("component")),
        "hash-components",
    )


def with_components(rows: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Rows plus ``component`` (smallest stable id linked to the row).

    The lookup holds one row per shared hash and was written, so it is broadcast when
    small; otherwise the rows of a hot hash are split by adaptive skew handling.
    """
    joined = rows.join(shared_components(rows, links), "exact_text_hash", "left")
    return joined.withColumn("component", F.coalesce("component", "stable_id"))


def unresolved_links(links: DataFrame) -> DataFrame:
    """Unresolved links by project and reason; one ALL/none/0 row when there are none."""
    counted = (
        links.filter(~F.col("outcome").isin("resolved", "self_reference"))
        .groupBy(F.col("source_project").alias("project"), F.col("outcome").alias("reason"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    none = (
        counted.agg(F.count(F.lit(1)).alias("n"))
        .filter("n = 0")
        .select(
            F.lit("ALL").alias("project"),
            F.lit("none").alias("reason"),
            F.lit(0).cast("long").alias("count"),
        )
    )
    return counted.unionByName(none)


def link_outcomes(links: DataFrame) -> DataFrame:
    return links.groupBy("outcome").agg(F.count(F.lit(1)).alias("links"))
