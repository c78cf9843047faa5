"""Membership, prediction and artifact fingerprints.

The membership digest adds five 48- to 60-bit limbs of SHA-256(id) over all members.
Sums commute, so the digest does not depend on order, partitions or retries, partial
sums are merged map-side, and the only shuffle moves one row per task and group.  Where
order counts, :func:`ordered_digest` hashes fixed blocks of lines and then their digests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracefold.operators.ordering import with_position

_LIMBS = ((1, 15), (16, 15), (31, 15), (46, 15), (61, 4))
BLOCK_BITS = 16
BLOCK_LINES = 1 << BLOCK_BITS


def _limb(digest: Column, start: int, width: int) -> Column:
    return F.conv(digest.substr(start, width), 16, 10).cast("decimal(20,0)")


def membership_digest(
    members: DataFrame, key: Column, group: Sequence[str] = ()
) -> DataFrame:
    """(group, row_count, fingerprint): order-independent digest of a multiset of keys."""
    hashed = members.select(*group, F.sha2(key, 256).alias("_h"))
    sums = [
        F.sum(_limb(F.col("_h"), start, width)).alias(f"_s{i}")
        for i, (start, width) in enumerate(_LIMBS)
    ]
    total = F.count(F.lit(1)).alias("row_count")
    grouped = hashed.groupBy(*group).agg(total, *sums)
    parts = [F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("string") for i in range(len(_LIMBS))]
    joined = F.concat_ws("|", F.col("row_count").cast("string"), *parts)
    return grouped.select(*group, "row_count", F.sha2(joined, 256).alias("fingerprint"))


def prediction_digest(predictions: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Digest over ``id TAB label``: swapping two predictions changes it."""
    line = F.concat(F.col("stable_id"), F.lit("\t"), F.col("y_pred"))
    return membership_digest(predictions, line, group)


def ordered_digest(
    members: DataFrame, line: Column, order: Sequence[Column], group: Sequence[str] = ()
) -> DataFrame:
    """(group, row_count, fingerprint): digest of the lines in order, at any size.

    Blocks of ``BLOCK_LINES`` lines by position give one SHA-256 each, over the lines with
    a line break after each; blocks of these digests give the next level.  Four levels
    cover every long count, so the tree is the same at all sizes, and no task holds more
    than a block.  Rows that tie in ``order`` must have equal lines.  An empty group has no row.
    """
    numbered = members.select(
        *group, line.alias("_line"), *[key.alias(f"_order{i}") for i, key in enumerate(order)]
    )
    keys = [F.col(f"_order{i}") for i in range(len(order))]
    level = with_position(numbered, group, keys).select(
        *group, F.col("position").alias("_n"), F.lit(1).cast("long").alias("row_count"), "_line"
    )
    block = F.array_sort(F.collect_list(F.struct("_n", "_line")))
    text = F.array_join(F.transform(block, lambda s: F.concat(s["_line"], F.lit("\n"))), "")
    for _ in range(4):
        parent = F.shiftright("_n", BLOCK_BITS).alias("_parent")
        level = (
            level.groupBy(*group, parent)
            .agg(F.sum("row_count").alias("row_count"), F.sha2(text, 256).alias("_line"))
            .withColumnRenamed("_parent", "_n")
        )
    return level.select(*group, "row_count", F.col("_line").alias("fingerprint"))


def ordered_memberships(members: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Ordered digest over the sorted ids."""
    return ordered_digest(members, F.col("stable_id"), [F.col("stable_id")], group)


def ordered_predictions(
    predictions: DataFrame, order: str, group: Sequence[str] = ()
) -> DataFrame:
    """Ordered digest over ``id TAB label`` lines in row order."""
    line = F.concat(F.col("stable_id"), F.lit("\t"), F.col("y_pred"))
    return ordered_digest(predictions, line, [F.col(order)], group)


def dataset_fingerprint(artifacts: DataFrame) -> DataFrame:
    """Digest over sorted ``artifact:sha256`` lines; one line per catalogue source."""
    line = F.concat_ws(":", "artifact", "sha256")
    return artifacts.agg(
        F.count(F.lit(1)).alias("artifacts"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"),
    )


def cache_identity(artifacts: DataFrame) -> DataFrame:
    """Digest over the JSON list of [artifact, sha256] pairs; one pair per shard."""
    pairs = F.array_sort(F.collect_list(F.array("artifact", "sha256")))
    return artifacts.agg(
        F.count(F.lit(1)).alias("artifacts"), F.sha2(F.to_json(pairs), 256).alias("fingerprint")
    )


def compare_fingerprints(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MATCH only when both sides hold the artifact and agree."""
    both = expected.select(*keys, F.col("fingerprint").alias("expected_fingerprint")).join(
        actual.select(*keys, "row_count", F.col("fingerprint").alias("actual_fingerprint")),
        list(keys),
        "full_outer",
    )
    same = F.col("expected_fingerprint") == F.col("actual_fingerprint")
    return both.withColumn(
        "status", F.when(F.coalesce(same, F.lit(False)), "MATCH").otherwise("MISMATCH")
    )


def compare_measures(
    expected: DataFrame, actual: DataFrame, keys: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Stored against regenerated counts, measure by measure; missing keys mismatch."""
    left = expected.select(*keys, *[F.col(m).alias(f"expected_{m}") for m in measures])
    right = actual.select(*keys, *[F.col(m).alias(f"actual_{m}") for m in measures])
    same = F.lit(True)
    for m in measures:
        same = same & F.col(f"expected_{m}").eqNullSafe(F.col(f"actual_{m}"))
    return left.join(right, list(keys), "full_outer").withColumn(
        "status", F.when(same, "MATCH").otherwise("MISMATCH")
    )
