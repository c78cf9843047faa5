"""MinHash near-duplicates: one permutation, optimal densification, stars in banded buckets.

1. Per text: set of distinct word shingles (64-bit hashes), a 128-bit digest of the set,
   and a one-permutation signature of 256 bins (the smallest hash of each bin).  An empty
   bin copies the first filled bin on a full-cycle walk of its own.
2. Equal sets collapse to the smallest doc_id before anything else.
3. 42 bands of 6 bins; rows with one band key form a bucket.  The star centre of a bucket
   is its member with the largest buckets over all bands.  Only (centre, member) pairs are
   made, so pairs grow with rows and not with the square of a bucket.  A link of similarity
   0.8 shares no bucket with probability (1 - 0.8**6)**42 = 3e-6.
4. Star pairs are confirmed on the full sets.
5. Members of one star that ended in different components are compared exactly in blocks of
   at most about ``BLOCK`` rows against ``BLOCK`` rows; a block task returns a spanning forest
   of its links.  Members already joined to the centre are not compared with each other.

Defined cases: null or blank text has an empty set, size 0, is linked with nothing and is
its own component.  Repeated rows keep their multiplicity; rows with one doc_id count as
one document (the smallest id of the component is kept).  Rows with a null doc_id are never
linked: component null, kept true.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracefold.llm import bitmap
from tracefold.llm.words import U, mix, pieces, shingles, word_hashes
from tracefold.operators.components import connected_components
from tracefold.session import materialize

BINS, BANDS, ROWS = 256, 42, 6
BLOCK = 128

_bin = np.arange(BINS, dtype=U)
_WALK_FROM = (mix(_bin + U(11)) & U(BINS - 1)).astype(np.int64)
_WALK_STEP = (mix(_bin + U(1 << 20)) & U(BINS - 1)).astype(np.int64) | 1


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Densified signatures (texts x bins) of sorted non-empty hash sets."""
    out = np.zeros((len(sets), BINS), U)
    filled = np.zeros((len(sets), BINS), bool)
    for d, h in enumerate(sets):
        bins = (h >> U(56)).astype(np.int64)
        head = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        out[d, bins[head]] = h[head]
        filled[d, bins[head]] = True
    row, col = np.nonzero(~filled)
    step = 0
    while len(row):
        donor = (_WALK_FROM[col] + step * _WALK_STEP[col]) & (BINS - 1)
        ok = filled[row, donor]
        out[row[ok], col[ok]] = out[row[ok], donor[ok]]
        row, col, step = row[~ok], col[~ok], step + 1
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """64-bit key of each band (texts x bands); the band number is part of the key."""
    parts = signature[:, : BANDS * ROWS].reshape(len(signature), BANDS, ROWS)
    key = np.arange(BANDS, dtype=U)[None, :] + U(1)
    for r in range(ROWS):
        key = mix(key * U(0x2545F4914F6CDD1D) + parts[:, :, r])
    return key


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _describe(k: int, with_sets: bool, asked=None):
    """Signatures of all texts, or the sets of those whose bit is set in ``asked``."""

    def run(batches):
        for batch in batches:
            if asked is not None:
                slots = batch.column(2).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(bitmap.hits(asked.value, slots)))
            ids = batch.column(0)
            for a, b, data, offsets in pieces(batch.column(1)):
                h, first = word_hashes(data, offsets)
                sets = [np.unique(s) for s in shingles(h, first, k)]
                sizes = np.array([len(s) for s in sets], np.int64)
                columns = [ids.slice(a, b - a), pa.array(sizes)]
                if with_sets:
                    columns.append(_lists(np.concatenate(sets) if sets else np.zeros(0, U), sizes))
                else:
                    full = np.flatnonzero(sizes)
                    keys = band_keys(signatures([sets[i] for i in full]))
                    h1 = np.array([mix(s).sum(dtype=U) for s in sets], U)
                    h2 = np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) for s in sets], U)
                    count = np.zeros(len(sets), np.int64)
                    count[full] = BANDS
                    columns += [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                                _lists(keys.reshape(-1), count)]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES[with_sets])

    return run


NAMES = {False: ["doc_id", "n", "h1", "h2", "keys"], True: ["doc_id", "n", "shingles"]}


def _block_links(percent: int):
    """Links of one block pair, reduced to a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        label = table["label"].to_numpy()
        joined = table["joined"].to_numpy(zero_copy_only=False).astype(bool)
        sets = table["shingles"].combine_chunks()
        ends = sets.offsets.to_numpy().astype(np.int64)
        values = sets.values.to_numpy()
        size = np.diff(ends)
        # Numbers only for values that stand in several sets; one sorted copy is all that is held besides.
        ordered = np.sort(values)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        parts = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for i in range(len(node)) if len(twice) else ():
            own = values[ends[i] : ends[i + 1]]
            place = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
            place = place[twice[place] == own].astype(np.int32)
            parts.append((place, np.full(len(place), i, np.int32)))
        code, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        common = np.zeros((len(node), len(node)), np.float32)
        for low in range(0, int(code.max()) + 1 if len(code) else 0, 8192):
            here = (code >= low) & (code < low + 8192)
            part = np.zeros((len(node), 8192), np.float32)
            part[owner[here], code[here] - low] = 1
            common += part @ part.T
        union = size[:, None] + size[None, :] - common
        linked = (100 * common >= percent * union) & (label[:, None] != label[None, :])
        linked &= ~(joined[:, None] & joined[None, :])
        root = list(range(len(node)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        kept = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1))), strict=True):
            p, q = top(i), top(j)
            if p != q:
                root[p] = q
                kept.append((i, j))
        left = np.array([i for i, _ in kept], np.int64)
        right = np.array([j for _, j in kept], np.int64)
        return pa.table({"u": node[left], "v": node[right]})

    return run


def _labelled(frame: DataFrame, components: DataFrame, column: str, name: str) -> DataFrame:
    named = components.select(F.col("node").alias(column), F.col("component").alias(name))
    return frame.join(named, column, "left").withColumn(name, F.coalesce(name, column))


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept; one row per input row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = materialize(
        texts.mapInArrow(_describe(words, False), "doc_id long, n long, h1 long, h2 long, keys array<long>"),
        "minhash-signatures",
    )
    usable = described.filter("n > 0 and doc_id is not null")
    classes = materialize(
        usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "minhash-classes"
    )
    # One row per different set: equal sets are one node of the graph.
    nodes = materialize(
        usable.join(classes, (usable.h1 == classes.h1) & (usable.h2 == classes.h2) & (usable.doc_id == classes.node))
        .select("node", "n", "keys").dropDuplicates(["node"]),
        "minhash-nodes",
    )
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = materialize(keyed.join(crowded, "key"), "minhash-members")
    weight = members.groupBy("node").agg(F.sum("members").alias("weight"))
    weighed = members.join(weight, "node")
    centres = weighed.groupBy("key").agg(
        F.max(F.struct("weight", (-F.col("node")).alias("minus"), F.col("n").alias("hub_n"))).alias("c")
    ).select("key", (-F.col("c.minus")).alias("hub"), "c.hub_n")
    stars = materialize(
        members.join(centres, "key").filter("hub <> node").select("hub", "hub_n", "node", "n").distinct(),
        "minhash-stars",
    )
    wanted = stars.select("node").union(stars.select(F.col("hub").alias("node"))).distinct()
    wanted = materialize(wanted, "minhash-wanted")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.build(wanted, bitmap.slot_of_id("node")))
    sets = materialize(
        texts.withColumn("_slot", bitmap.slot_of_id("doc_id"))
        .mapInArrow(_describe(words, True, shared), "doc_id long, n long, shingles array<long>")
        .select(F.col("doc_id").alias("node"), "shingles").join(wanted, "node", "left_semi")
        .dropDuplicates(["node"]),
        "minhash-sets",
    )
    close = stars.filter(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
    common = F.size(F.array_intersect("shingles", "hub_shingles")).cast("long")
    links = materialize(
        close.join(sets, "node")
        .join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles")), "hub")
        .withColumn("common", common)
        .filter(f"100 * common >= {percent} * (n + hub_n - common)")
        .select(F.col("hub").alias("u"), F.col("node").alias("v")),
        "minhash-links",
    )
    components = connected_components(links)
    rest = _open_blocks(stars, components, sets, percent)
    components = connected_components(links.unionByName(rest))
    plain = described.select("doc_id", "n", "h1", "h2")
    named = plain.join(classes, ["h1", "h2"], "left").join(components, "node", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "node", "doc_id")).otherwise(F.col("doc_id"))
    return named.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _open_blocks(stars: DataFrame, components: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside stars that the centre has not joined, found block by block."""
    rows = stars.select("hub", "node").unionByName(
        stars.select("hub", F.col("hub").alias("node")).distinct()
    )
    rows = _labelled(_labelled(rows, components, "node", "label"), components, "hub", "hub_label")
    rows = rows.withColumn("joined", F.col("label") == F.col("hub_label"))
    sizes = rows.groupBy("hub").agg(
        F.sum(F.col("joined").cast("long")).alias("inside"),
        F.sum((~F.col("joined")).cast("long")).alias("outside"),
    ).filter("outside > 0 and inside + outside > 2")
    blocks = rows.join(sizes, "hub").withColumn(
        "inner", F.ceil(F.col("inside") / BLOCK).cast("int")
    ).withColumn("outer", F.ceil(F.col("outside") / BLOCK).cast("int"))
    spread = F.xxhash64("node")
    own = F.when(F.col("joined"), F.pmod(spread, F.col("inner"))).otherwise(
        F.col("inner") + F.pmod(spread, F.col("outer"))
    ).cast("int")
    last = F.col("inner") + F.col("outer") - 1
    # A joined block meets every open block; an open block meets all blocks.
    others = F.when(F.col("joined"), F.sequence(F.col("inner"), last)).otherwise(
        F.sequence(F.lit(0), last)
    )
    units = (
        blocks.withColumn("own", own).withColumn("other", F.explode(others))
        .select("hub", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                "node", "label", "joined")
        .join(sets, "node")
    )
    return materialize(
        units.groupBy("hub", "a", "b").applyInArrow(_block_links(percent), "u long, v long"),
        "minhash-block-links",
    )
