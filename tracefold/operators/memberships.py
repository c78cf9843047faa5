"""Set relations and integrity rules over membership tables keyed by ``stable_id``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tracefold.operators.eligibility import require_empty


def common_ids(left: DataFrame, right: DataFrame, key: str = "stable_id") -> DataFrame:
    """Ids of the left set that are also in the right one; empty for disjoint sets."""
    return left.select(key).distinct().join(right.select(key), key, "left_semi")


def missing_ids(left: DataFrame, right: DataFrame, key: str = "stable_id") -> DataFrame:
    """Ids of the left set that the right one lacks; empty for a subset."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def difference(left: DataFrame, right: DataFrame, key: str = "stable_id") -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def set_differences(left: DataFrame, right: DataFrame, key: str = "stable_id") -> DataFrame:
    """Ids on one side only, with the side; empty for equal sets."""
    sides = left.select(key, F.lit(1).alias("s")).unionByName(right.select(key, F.lit(2).alias("s")))
    per_id = sides.groupBy(key).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return per_id.filter("lo = hi").select(
        key, F.when(F.col("lo") == 1, "left_only").otherwise("right_only").alias("side")
    )


def repeated_members(shards: DataFrame, key: str = "stable_id") -> DataFrame:
    """Ids held more than once across shards; empty for pairwise disjoint shards."""
    return shards.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def require_exact_membership(
    cache: DataFrame, development: DataFrame, locked: DataFrame | None = None
) -> None:
    """A vector cache must hold exactly the development ids and no held-out id."""
    require_empty(repeated_members(cache), "duplicate identities in the cache")
    require_empty(set_differences(cache, development), "cache is not the development membership")
    if locked is not None:
        require_empty(common_ids(cache, locked), "cache holds held-out rows")


def component_overlap(
    left: DataFrame, right: DataFrame, scope: Sequence[str] = ()
) -> DataFrame:
    """Components present on both sides, optionally per scope (project)."""
    keys = [*scope, "component"]
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_semi")


def fold_violations(memberships: DataFrame, rows: DataFrame) -> DataFrame:
    """Violation counts of every fold rule, per family and fold (zero when clean).

    ``rows`` (stable_id, component, membership) describes all rows; the memberships are
    joined to it once and every rule is a grouped condition on the result.
    """
    facts = memberships.join(rows.select("stable_id", "component", "membership"), "stable_id", "left")
    outside = facts.groupBy("family", "fold").agg(
        F.count_if(F.coalesce(F.col("membership") != "DEVELOPMENT", F.lit(True))).alias("non_development"),
        F.count_if(F.coalesce(F.col("membership") == "LOCKED_TEST", F.lit(False))).alias("locked_overlap"),
    )
    train, validation = F.col("role") == "TRAIN", F.col("role") == "VALIDATION"
    doubled = (
        facts.groupBy("family", "fold", "stable_id")
        .agg(F.count_if(train).alias("t"), F.count_if(validation).alias("v"))
        .groupBy("family", "fold")
        .agg(F.count_if(F.expr("t > 0 and v > 0")).alias("train_validation_overlap"))
    )
    scope = F.when(F.col("family") == "pooled", "").otherwise(F.col("source_project"))
    leaks = (
        facts.groupBy("family", "fold", scope.alias("scope"), "component")
        .agg(F.count_if(train).alias("t"), F.count_if(validation).alias("v"))
        .groupBy("family", "fold")
        .agg(F.count_if(F.expr("t > 0 and v > 0")).alias("component_leaks"))
    )
    time = (
        facts.groupBy("family", "fold", "source_project")
        .agg(
            F.max(F.when(train, F.col("creation_time"))).alias("t"),
            F.min(F.when(validation, F.col("creation_time"))).alias("v"),
        )
        .groupBy("family", "fold")
        .agg(F.count_if(F.coalesce(F.expr("t > v"), F.lit(False))).alias("chronology_violations"))
    )
    keys = ["family", "fold"]
    return outside.join(doubled, keys).join(leaks, keys).join(time, keys)


def failing_checks(checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boolean check columns -> one row per failed check; NULL counts as failed."""
    names = [f.name for f in checked.schema.fields if f.dataType.typeName() == "boolean"]
    long = F.explode(
        F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("passed")) for n in names])
    )
    return checked.select(*keys, long.alias("c")).select(*keys, "c.*").filter(
        ~F.coalesce("passed", F.lit(False))
    ).drop("passed")


def shard_checks(sidecars: DataFrame, shards: DataFrame, expected: dict) -> DataFrame:
    """Compare stored shard records with the shard data.

    ``sidecars``: project, row_count, membership_sha256, embedding_dimension and the
    provenance columns named in ``expected``; ``shards``: stable_id, source_project,
    embedding.
    """
    from tracefold.operators.fingerprints import membership_digest
    from tracefold.operators.vectors import vector_violations

    digest = membership_digest(shards, F.col("stable_id"), ["source_project"]).select(
        F.col("source_project").alias("project"),
        F.col("row_count").alias("actual_rows"),
        F.col("fingerprint").alias("actual_sha256"),
    )
    unique = (
        shards.groupBy("source_project", "stable_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.col("source_project").alias("project"))
        .agg((F.max("n") == 1).alias("identities_unique"))
    )
    dimension = expected["embedding_dimension"]
    bad = (
        vector_violations(shards, dimension)
        .groupBy(F.col("source_project").alias("project"))
        .agg(F.count(F.lit(1)).alias("bad_vectors"))
    )
    joined = (
        sidecars.join(digest, "project", "full_outer")
        .join(unique, "project", "left")
        .join(bad, "project", "left")
    )
    return joined.select(
        "project",
        F.col("row_count").eqNullSafe(F.col("actual_rows")).alias("row_count_matches"),
        F.col("membership_sha256").eqNullSafe(F.col("actual_sha256")).alias("membership_matches"),
        "identities_unique",
        F.col("bad_vectors").isNull().alias("vectors_valid"),
        *[F.col(k).eqNullSafe(F.lit(v)).alias(f"{k}_matches") for k, v in expected.items()],
    )


def result_checks(results: DataFrame, expected: dict, methods: DataFrame) -> DataFrame:
    """Compare stored fit results with their expected provenance and method per task.

    ``methods``: one row per task with the frozen configuration columns.
    """
    columns = [c for c in methods.columns if c != "task"]
    wanted = methods.select("task", *[F.col(c).alias(f"_{c}") for c in columns])
    return results.join(wanted, "task", "left").select(
        "experiment_id", "task", "fold",
        (F.col("status") == "SUCCESS").alias("status_success"),
        F.col("macro_f1").isNotNull().alias("metrics_present"),
        *[F.col(k).eqNullSafe(F.lit(v)).alias(f"{k}_matches") for k, v in expected.items()],
        *[F.col(c).eqNullSafe(F.col(f"_{c}")).alias(f"{c}_matches") for c in columns],
    )


def size_mismatches(observed: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rows) against (keys, expected_rows); empty when all sizes are as frozen."""
    both = observed.join(expected, list(keys), "full_outer")
    return both.filter(~F.col("rows").eqNullSafe(F.col("expected_rows")))
