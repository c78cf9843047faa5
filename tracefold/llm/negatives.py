"""Hard negatives by best-first search in STR-packed R-trees.

Vectors are integers; the score of a row is its inner product with an anchor.  Rows come by
score, highest first, ties by the smaller id.  An anchor's positives are its first rows of the
same label; for every positive, the negatives are the first rows of other labels whose score lies in a
window given by percentages of the positive's score.

1. Packing: rows are range-partitioned and sorted by (label, first component, id) and cut into
   tiles of ``TILE`` rows, so equal vectors and hot labels are split.  A tile is packed by
   sort-tile-recursive: slabs by label, then by its components of the largest spread, leaves of ``LEAF``
   rows.  A leaf carries the bounding box of its vectors and the range of its labels; the inner
   levels (``FAN`` children) follow from the leaves.  Leaves are written once.
2. Search: an anchor and a box give an interval of inner products, coordinate by coordinate (the
   positive part of the anchor takes the upper face, the negative part the lower one).  A queue gives
   the box with the highest upper bound first.  A box is pruned when its interval misses the score
   window or its upper bound is strictly below the kth score found (an equal score may still
   win by its id), or its labels cannot match.
3. Blocks of at most about ``BLOCK`` anchors meet one partition of tiles in one task.  Each
   returns its first rows per query; a window over these picks the final ones.

The anchors are a stated query set: all of them against all rows, in blocks.  A task holds one
partition's leaves and one block.

Defined cases: rows with a null id or label, a null vector or a null or non-finite component take no
part.  Of rows that share an id, the one with the smallest (label, vector) counts.  Shorter
vectors are filled with zeros.  Components beyond ``LIMIT`` in size are held at it, so that sums
stay exact.  A positive of negative score has no negatives, as its window is empty.  Other columns are
not read, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracefold.session import materialize

TILE, LEAF, FAN, BLOCK, GROUP = 8192, 64, 16, 8192, 64
SPREAD = 3  # components that a tile is cut by, besides the label
LIMIT = 1 << 24

_LEAVES = "part int, ids array<long>, labels array<long>, points binary"
_FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def quantized(embedding: Column, scale: int) -> Column:
    """floor(scale * x) per component, x as double, held within ``LIMIT``; null if one is null or not finite."""
    whole = F.transform(embedding, lambda x: F.greatest(
        F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(x.cast("double") * scale).cast("double"))
    ).cast("int"))
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, whole)


def tile_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Row order of sort-tile-recursive packing; the columns of ``points`` are sorted by in turn."""
    order = np.argsort(points[:, 0], kind="stable")
    if points.shape[1] == 1:
        return order
    leaves = -(-len(points) // leaf)
    slabs = int(np.ceil(leaves ** (1 / points.shape[1])))
    size = leaf * -(-leaves // slabs)
    return np.concatenate([
        order[a : a + size][tile_order(points[order[a : a + size], 1:], leaf)] for a in range(0, len(order), size)
    ])


def _pack(dims: int):
    def tile(part: int, ids: np.ndarray, labels: np.ndarray, points: np.ndarray):
        widest = np.argsort(-points.astype(np.float64).var(0), kind="stable")[:SPREAD]
        order = tile_order(np.column_stack([labels, points[:, widest].astype(np.int64)]))
        leaves = [order[a : a + LEAF] for a in range(0, len(order), LEAF)]
        return pa.RecordBatch.from_arrays([
            pa.array([part] * len(leaves), pa.int32()), pa.array([ids[x] for x in leaves], pa.list_(pa.int64())),
            pa.array([labels[x] for x in leaves], pa.list_(pa.int64())),
            pa.array([np.ascontiguousarray(points[x]).tobytes() for x in leaves], pa.binary()),
        ], names=["part", "ids", "labels", "points"])

    def run(batches):
        held, size, part = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            held.append((
                batch.column(1).to_numpy(), batch.column(2).to_numpy(),
                batch.column(3).flatten().to_numpy().astype(np.int32).reshape(-1, dims),
            ))
            size += batch.num_rows
            if size < TILE:
                continue
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            for a in range(0, size - TILE + 1, TILE):
                yield tile(part, *(x[a : a + TILE] for x in whole))
            rest = size - size % TILE
            held, size = [tuple(x[rest:] for x in whole)], size - rest
        if size:
            yield tile(part, *(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


class Tree:
    """Leaves of one partition with the boxes of all levels; node 0 of the last level is the root."""

    def __init__(self, ids: list[np.ndarray], labels: list[np.ndarray], points: list[np.ndarray]):
        self.ids, self.labels, self.points = ids, labels, points
        low = np.array([x.min(0) for x in points], np.float64)
        high = np.array([x.max(0) for x in points], np.float64)
        tags = np.array([(x.min(), x.max()) for x in labels], np.int64)
        self.levels = [(low, high, tags)]
        while len(low) > 1:
            cut = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            tags = np.column_stack([np.minimum.reduceat(tags[:, 0], cut), np.maximum.reduceat(tags[:, 1], cut)])
            self.levels.append((low, high, tags))
        self.size = max((np.abs(x).max(initial=0) for x in (self.levels[-1][0], self.levels[-1][1])), default=0)

    def search(self, anchors: np.ndarray, own: np.ndarray, labels: np.ndarray, owner: np.ndarray,
               low: np.ndarray, high: np.ndarray, k: int, same: bool) -> list[list[tuple[int, int]]]:
        """First k (-score, id) of each query.

        ``anchors``, ``own``, ``labels``: vector, id and label of each anchor; ``owner``: anchor of each query;
        ``low``, ``high``: score window of each query; ``same``: rows of the anchor's label, or of others.
        """
        exact = self.size * np.abs(anchors).max(initial=0) * anchors.shape[1] < 1 << 53
        kind = np.float64 if exact else np.int64
        vectors = anchors.astype(kind)
        plus, minus = np.maximum(vectors, 0).astype(np.float64), np.minimum(vectors, 0).astype(np.float64)
        # Bounds are float64; sums beyond 2**53 get room for their rounding.
        slack = 0.0 if exact else self.size * float(np.abs(anchors).max(initial=0)) * anchors.shape[1] * 1e-12
        found: list[list[tuple[int, int]]] = [[] for _ in owner]
        least = low.astype(np.float64)  # lower end of the window, or the kth score once there are k
        queue = [(-np.inf, len(self.levels) - 1, 0)]

        def wanted(level: int, node: slice) -> tuple[np.ndarray, np.ndarray]:
            """Upper bounds, and whether a query can find something, per query and box."""
            lo, hi, tags = (x[node] for x in self.levels[level])
            upper = (plus @ hi.T + minus @ lo.T + slack)[owner]
            lower = (plus @ lo.T + minus @ hi.T - slack)[owner]
            tag = labels[owner][:, None]
            fits = ((tags[:, 0] <= tag) & (tag <= tags[:, 1])) if same else ((tags[:, 0] != tag) | (tags[:, 1] != tag))
            return upper, (upper >= least[:, None]) & (lower <= high[:, None]) & fits

        while queue:
            _, level, node = heapq.heappop(queue)
            _, open_ = wanted(level, slice(node, node + 1))
            asked = np.flatnonzero(open_[:, 0])
            if not len(asked):
                continue
            if level:
                children = slice(node * FAN, (node + 1) * FAN)
                upper, open_ = wanted(level - 1, children)
                upper[~open_] = -np.inf
                for i, best in enumerate(upper.max(0).tolist()):
                    if best > -np.inf:
                        heapq.heappush(queue, (-best, level - 1, node * FAN + i))
                continue
            who = np.unique(owner[asked])
            place = np.searchsorted(who, owner[asked])
            score = (vectors[who] @ self.points[node].T.astype(kind))[place]
            ids, tag = self.ids[node], labels[owner[asked]][:, None]
            good = (score >= least[asked][:, None]) & (score <= high[asked][:, None]) & (ids != own[owner[asked]][:, None])
            good &= (self.labels[node] == tag) if same else (self.labels[node] != tag)
            for r in np.flatnonzero(good.any(1)).tolist():
                q, hit = int(asked[r]), np.flatnonzero(good[r])
                found[q] = sorted(found[q] + list(zip((-score[r, hit]).astype(np.int64).tolist(), ids[hit].tolist(), strict=True)))[:k]
                if len(found[q]) == k:
                    least[q] = max(least[q], -found[q][-1][0])
        return found


def _tree(leaves: pa.Table, dims: int) -> Tree:
    points = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, dims) for x in leaves["points"]]
    return Tree([x.values.to_numpy() for x in leaves["ids"]], [x.values.to_numpy() for x in leaves["labels"]], points)


def _searched(dims: int, k: int, window: tuple[int, int] | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """First k rows of one partition per query: the same label without ``window``, other labels within it."""

    def run(leaves: pa.Table, anchors: pa.Table) -> pa.Table:
        rows = []
        if leaves.num_rows and anchors.num_rows:
            tree = _tree(leaves, dims)
            anchors = anchors.combine_chunks().sort_by([("label", "ascending"), ("anchor_id", "ascending")])
            for a in range(0, anchors.num_rows, GROUP):
                rows += _group(tree, anchors.slice(a, GROUP), dims, k, window)
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        names = ["anchor_id", "positive_id", "positive_score", "vec_id", "score"]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    return run


def _group(tree: Tree, anchors: pa.Table, dims: int, k: int, window: tuple[int, int] | None) -> list[tuple]:
    own, labels = anchors["anchor_id"].to_numpy(), anchors["label"].to_numpy()
    vectors = anchors["vector"].combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, dims)
    if window is None:
        owner = np.arange(len(own))
        positives = [(None, None)] * len(own)
        low, high = np.full(len(own), -np.inf), np.full(len(own), np.inf)
    else:
        asked = anchors["positives"].to_pylist()
        owner = np.array([i for i, found in enumerate(asked) for _ in found], np.int64)
        positives = [(x["id"], x["score"]) for found in asked for x in found]
        low = np.array([-(-window[0] * score // 100) for _, score in positives], np.float64)
        high = np.array([window[1] * score // 100 for _, score in positives], np.float64)
    found = tree.search(vectors, own, labels, owner, low, high, k, window is None)
    return [
        (int(own[owner[q]]), *positives[q], row, -negated) for q, rows in enumerate(found) for negated, row in rows
    ]


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _meet(leaves: DataFrame, anchors: DataFrame, parts: int, blocks: int, search) -> DataFrame:
    """Search every partition of leaves for every block of anchors."""
    left = leaves.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.withColumn("block", F.pmod(F.hash("anchor_id"), F.lit(blocks))).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(search, _FOUND)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3,
                   window: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, vector (integers, null for rows without part); ``is_anchor`` picks the
    anchors; ``window``: percentages of the positive's score that a negative's score must lie between.
    """
    part = rows.filter("vec_id is not null and label is not null and vector is not null").groupBy(
        F.col("vec_id").cast("long").alias("vec_id")
    ).agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "vector")).alias("v")).select("vec_id", "v.*")
    part = materialize(part, "negative-rows")
    sizes = part.agg(F.max(F.size("vector")).alias("dims"), F.count(F.lit(1)).alias("n"),
                     F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    dims, parts = max(1, sizes["dims"] or 1), max(1, -(-sizes["n"] // TILE))
    blocks = max(1, -(-sizes["anchors"] // BLOCK))
    filled = part.withColumn("vector", F.slice(F.concat("vector", F.array_repeat(F.lit(0), dims)), 1, dims))
    leaves = materialize(
        filled.withColumn("_c", F.col("vector")[0]).repartitionByRange(parts, "label", "_c", "vec_id")
        .sortWithinPartitions("label", "_c", "vec_id")
        .select(F.spark_partition_id().alias("part"), "vec_id", "label", "vector").mapInArrow(_pack(dims), _LEAVES),
        "negative-leaves",
    )
    parts = (leaves.agg(F.max("part").alias("n")).first()["n"] or 0) + 1
    anchors = filled.filter(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "vector")
    first = _first(_meet(leaves, anchors, parts, blocks, _searched(dims, positives, None)), positives, "anchor_id")
    first = materialize(first.groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("positives")
    ), "negative-positives")
    found = _meet(leaves, anchors.join(first, "anchor_id"), parts, blocks, _searched(dims, negatives, window))
    return _first(found, negatives, "anchor_id", "positive_id").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
