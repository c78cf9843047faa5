"""Connected components by alternating large-star and small-star rounds.

The method is the one of Kiveris et al., "Connected Components in MapReduce and
Beyond" (2014).  Each round is two grouped minima joined back to the edges; the
minima are pre-aggregated before their shuffle and the joins have one row per node
on the small side, so a node that holds a third of all edges does not gather in one
task.  Every round is written to the scratch area and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracefold.session import materialize


def _minima(pairs: DataFrame) -> DataFrame:
    """Smallest of a node and its neighbours, for pairs (u, v)."""
    return pairs.groupBy("u").agg(F.min("v").alias("low")).select(
        "u", F.least("u", "low").alias("low")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(_minima(both), "u").filter(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    minima = _minima(down)
    to_low = down.join(minima, "u").filter(F.col("v") != F.col("low")).select(
        F.col("v").alias("u"), F.col("low").alias("v")
    )
    own = minima.select("u", F.col("low").alias("v"))
    return to_low.unionByName(own).filter("u <> v").distinct()


def _write_edges(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Write a round's edges and read their count and checksum back."""
    written = materialize(edges, "edges")
    row = written.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return written, (row["n"], row["s"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) edges -> (node, component) for every node that has an edge to another node.

    ``component`` is the smallest node of the component.
    """
    current, state = _write_edges(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u <> v")
        .distinct()
    )
    before = None
    while state[0] and state != before:
        before = state
        current, state = _write_edges(_small_star(_large_star(current)))
    # Settled edges form stars: every node points at the smallest node of its component.
    roots = current.select(F.col("v").alias("node")).distinct().withColumn(
        "component", F.col("node")
    )
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots
    )
