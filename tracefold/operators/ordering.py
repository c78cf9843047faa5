"""Exact ranks and running sums without one task per group.

``row_number() over (partition by project order by ...)`` sends a whole project to
one task, and one project may hold a third of all rows.  Here the rows are range
partitioned on (group, order), written once in sorted order, and each row's rank is
its offset inside its range plus the size of the group's earlier ranges.  Only the
table of range sizes (at most ranges + groups rows) is ever accumulated in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracefold.session import materialize, shuffle_width

_RANGE_BITS = 33  # monotonically_increasing_id: partition above, row index below


def range_sorted(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Rows written in total order of ``keys``; ``_range`` and ``_slot`` locate each row."""
    named = df
    names = []
    for i, key in enumerate(keys):
        named = named.withColumn(f"_key{i}", key)
        names.append(f"_key{i}")
    ordered = (
        named.repartitionByRange(shuffle_width(df), *names)
        .sortWithinPartitions(*names)
        .withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_seq", _RANGE_BITS))
        .withColumn("_slot", F.col("_seq").bitwiseAND(F.lit((1 << _RANGE_BITS) - 1)))
        .drop("_seq", *names)
    )
    return materialize(ordered, "range-sorted")


def with_position(
    df: DataFrame, group: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """Add 0-based ``position`` inside the group and ``group_rows``.

    ``order`` must be a total order inside each group.
    """
    ordered = range_sorted(df, [F.col(g) for g in group] + list(order))
    sizes = ordered.groupBy(*group, "_range").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_slot").alias("_first")
    )
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *group,
        "_range",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("group_rows"),
    )
    offsets = materialize(offsets, "range-offsets")
    return (
        ordered.join(offsets, [*group, "_range"])
        .withColumn("position", F.col("_slot") + F.col("_shift"))
        .drop("_range", "_slot", "_shift")
    )


def with_running_sums(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: Sequence[str]
) -> DataFrame:
    """Add ``<name>_through`` (inclusive running sum) and ``<name>_total`` per group."""
    ordered = range_sorted(df, [F.col(g) for g in group] + list(order))
    sizes = ordered.groupBy(*group, "_range").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*group)
    offsets = sizes.select(
        *group,
        "_range",
        *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_{s}").over(whole).alias(f"{s}_total") for s in sums],
    )
    offsets = materialize(offsets, "range-offsets")
    inside = Window.partitionBy(*group, "_range").orderBy("_slot").rowsBetween(
        Window.unboundedPreceding, 0
    )
    located = ordered.join(offsets, [*group, "_range"])
    for s in sums:
        located = located.withColumn(
            f"{s}_through", F.sum(s).over(inside) + F.col(f"_before_{s}")
        )
    return located.drop("_range", "_slot", *[f"_before_{s}" for s in sums])


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each group; Spark limits each group before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
