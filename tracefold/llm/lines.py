"""Line dedup by a segment-partition edit join.

A line is removed when an equal line, or one within its byte edits, first appears earlier in
the corpus (order: doc_id, line number; judged on the input).  The shorter of two lines sets
the edits: ``TAU`` from ``MIN_BYTES`` bytes, below that in proportion (1 from 12 bytes, then
none, which leaves equality).  Blank lines and lines of fewer than ``least`` bytes are never
removed; with ``least`` 1 every other line counts.

1. Every line is cut into one even segment more than its edits.  It is indexed under (its
   length, segment number, segment bytes) and probes, for each length up to the edits below
   its own, the substrings at the positions that the multi-match-aware rule leaves.  Two lines
   within the edits meet in at least one key.  Lines without edits only repeat by equality.
2. Keys travel as sorted binary blocks per bucket (16 bytes an entry, one shuffle).  A bucket
   task sorts its entries and returns pairs of different lines that meet.
3. A key with more than ``HOT`` lines makes no pairs: its lines are compared exactly in blocks
   of about ``BLOCK`` against ``BLOCK`` lines, each block returning one row per line at most.
4. Pairs are confirmed by banded bit-parallel edit distance.

Lines are equal when their 128-bit digests (BLAKE2b) are; half of a digest names a line in the
edit join, which compares bytes.  Lines repeat as (id, first place) everywhere, so a very
frequent line is one node.

Defined cases: null text stays null, empty text stays empty.  Rows with a null doc_id are
left as they are and are no earlier line for others.  Repeated rows hold equal places, which
are not earlier than each other: all are treated alike.  Rows that share an id but not a text
are told apart by a text hash.  Other columns are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracefold.llm import bitmap
from tracefold.llm.words import SPACE, U, mix, pieces, prefix_hashes, run_hashes, runs
from tracefold.session import materialize, shuffle_width

TAU = 2
MIN_BYTES = 24
HOT = 64
BLOCK = 256
FLUSH = 8 << 20  # bytes of entries held by a task before they are emitted; sorting holds them three times

_ENTRY = np.dtype([("key", U), ("line", np.int64)])


def find_lines(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Starts, ends and text numbers of non-blank lines of at least ``least`` bytes."""
    starts, ends = runs(data, offsets, (data != 10).view(np.uint8))
    seen = np.r_[0, np.cumsum(~SPACE[data])]
    full = (ends - starts >= least) & (seen[ends] > seen[starts])
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def line_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each line."""
    view = memoryview(np.ascontiguousarray(data))
    spans = zip(starts.tolist(), ends.tolist(), strict=True)
    joined = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in spans)
    return np.frombuffer(joined, np.int64).reshape(-1, 2)


def _segment(length: np.ndarray, i: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment ``i``; longer segments stand last."""
    base, longer = length // (tau + 1), length % (tau + 1)
    extra = np.maximum(0, i - (tau + 1 - longer))
    return i * base + extra, base + (i >= tau + 1 - longer)


def edits(length: int, tau: int) -> int:
    """Edits that a line of ``length`` bytes may have from a line that is not shorter."""
    return min(tau, length * tau // MIN_BYTES)


def edit_ranges(least: int, tau: int) -> list[tuple[int, int, int]]:
    """(edits, first length, length after the last) of the lines that may have edits."""
    first = [max(least, -(-n * MIN_BYTES // tau)) for n in range(1, tau + 1)]
    return [(n, a, b) for n, (a, b) in enumerate(zip(first, [*first[1:], 1 << 62], strict=False), 1) if a < b]


def join_entries(
    c: np.ndarray, starts: np.ndarray, ends: np.ndarray, line: np.ndarray, tau: int, low_size: int = 1, high_size: int = 1 << 62
) -> np.ndarray:
    """Index entries (even keys) and probe entries (odd keys) of indexed lengths in the range."""
    found = []
    near = (ends - starts >= low_size) & (ends - starts - tau < high_size)
    starts, ends, line = starts[near], ends[near], line[near]
    length = ends - starts
    own = length < high_size
    span = length.max(initial=0)

    def add(role: int, size: np.ndarray, i: int, a: np.ndarray, b: np.ndarray, who: np.ndarray) -> None:
        key = mix(run_hashes(c, a, b) + mix((size * (tau + 1) + i).astype(U)))
        entry = np.empty(len(key), _ENTRY)
        entry["key"] = (key & ~U(1)) | U(role)
        entry["line"] = who
        found.append(entry)

    for i in range(tau + 1):
        p, q = _segment(length, i, tau)
        add(0, length[own], i, (starts + p)[own], (starts + p + q)[own], line[own])
        for less in range(tau + 1):
            size = length - less
            p, q = _segment(size, i, tau)
            low = np.maximum(np.maximum(p - i, p + less - (tau - i)), 0)
            high = np.minimum(np.minimum(p + i, p + less + (tau - i)), length - q)
            for step in range(2 * tau + 1):
                at = low + step
                ok = (at <= high) & (size >= low_size) & (size < high_size)
                if span and ok.any():
                    add(1, size[ok], i, (starts + at)[ok], (starts + at + q)[ok], line[ok])
    return np.concatenate(found)


def _places(least: int):
    """(doc, text hash, line number, line id, other half of its digest) of every line long enough."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(2)):
                starts, ends, text = find_lines(data, offsets, least)
                breaks = np.r_[0, np.cumsum(data == 10)]
                row = pa.array(text)
                digest = line_digests(data, starts, ends)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).take(row), batch.column(1).slice(a, b - a).take(row),
                    pa.array((breaks[starts] - breaks[offsets[text]]).astype(np.int64)),
                    pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()),
                ], names=["doc_id", "text_key", "line_no", "line", "rest"])

    return run


def _blocks(buckets: int, ranges: list[tuple[int, int, int]]):
    def flush(held: list[np.ndarray]):
        entries = np.concatenate(held)
        bucket = ((entries["key"] >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        entries, bucket = entries[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        yield pa.RecordBatch.from_arrays([
            pa.array(full.astype(np.int32)), pa.array([entries[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
        ], names=["bucket", "entries"])

    def run(batches):
        held, size = [], 0
        shortest = min((a for _, a, _ in ranges), default=0)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                starts, ends, _ = find_lines(data, offsets, shortest)
                if not ranges or not len(starts):
                    continue
                c = prefix_hashes(data)
                line, once = np.unique(line_digests(data, starts, ends)[:, 0], return_index=True)
                for n, low, high in ranges:
                    held.append(join_entries(c, starts[once], ends[once], line, n, low, high))
                    size += held[-1].nbytes
                if size > FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _meetings(batches):
    """Pairs of lines that meet in a key; for a crowded key its (key, line) rows."""
    held = [np.frombuffer(x.as_buffer(), _ENTRY) for batch in batches for x in batch.column(1)]
    if not held:
        return
    entries = np.unique(np.concatenate(held))
    key, line = entries["key"], entries["line"]
    group = key >> U(1)
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    probes = np.add.reduceat((key & U(1)).astype(np.int64), head)
    size = np.diff(np.r_[head, len(key)])
    differ = np.minimum.reduceat(line, head) != np.maximum.reduceat(line, head)
    pairs, crowded = [], []
    for g in np.flatnonzero((probes > 0) & (probes < size) & differ):
        a, b = head[g], head[g] + size[g]
        split = b - probes[g]  # even keys (index entries) sort first
        if size[g] > HOT:
            who = np.unique(line[a:b])
            crowded.append(np.stack([np.full(len(who), group[g].view(np.int64)), who], 1))
            continue
        left, right = np.meshgrid(line[a:split], line[split:b])
        both = np.stack([np.minimum(left, right).ravel(), np.maximum(left, right).ravel()], 1)
        pairs.append(both[both[:, 0] != both[:, 1]])
    for rows, hot in ((pairs, False), (crowded, True)):
        if rows:
            rows = np.unique(np.concatenate(rows), axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(np.full(len(rows), hot))], names=["u", "v", "hot"]
            )


def _texts(shared, least: int):
    """(line id, bytes) of the lines that may be asked for."""

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                starts, ends, _ = find_lines(data, offsets, least)
                line, once = np.unique(line_digests(data, starts, ends)[:, 0], return_index=True)
                slots = (line.view(U) >> U(64 - bitmap.LOG)).astype(np.int64)
                asked = np.flatnonzero(bitmap.hits(shared.value, slots))
                asked = [i for i in asked.tolist() if line[i] not in sent]
                if len(sent) < 1 << 20:
                    sent.update(line[asked].tolist())
                yield pa.RecordBatch.from_arrays([
                    pa.array(line[asked]), pa.array([data[starts[once[i]] : ends[once[i]]].tobytes() for i in asked], pa.binary())
                ], names=["line", "bytes"])

    return run


def within(a: bytes, b: bytes, tau: int) -> bool:
    """Whether the edit distance is at most ``tau``: bit-parallel columns of a diagonal band.

    In column j, bit k stands for row j - tau + k of the shorter text.  VP and VN are kept
    aligned to the next column, so moving along the diagonal needs no shift of their own.
    Cells outside the band are taken too large, which changes no distance up to ``tau``.
    """
    if len(a) > len(b):
        a, b = b, a
    rows, columns = len(a), len(b)
    if columns - rows > tau:
        return False
    if a == b:
        return True
    where: dict[int, int] = {}
    for i, char in enumerate(a, 1):
        where[char] = where.get(char, 0) | 1 << (i + tau)
    mask = (1 << (2 * tau + 1)) - 1
    centre = 1 << tau
    vp = mask & ~(centre - 1)  # rows 1.. of column 0 rise by one
    vn = 0
    score = 0
    for j, char in enumerate(b, 1):
        eq = where.get(char, 0) >> j & mask
        d0 = (((eq & vp) + vp) ^ vp | eq | vn) & mask
        hp = vn | mask & ~(d0 | vp)
        hn = d0 & vp
        if j <= rows:
            if not d0 & centre:
                score += 1
                if score > tau + columns - rows:
                    return False
        else:
            row = 1 << (rows - j + tau)
            score += bool(hp & row) - bool(hn & row)
        below = d0 >> 1
        vp = (hn | mask & ~(below | hp)) & mask
        vn = below & hp
    return score <= tau


def _confirm(tau: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            same = np.array([within(x, y, edits(min(len(x), len(y)), tau)) for x, y in zip(left, right, strict=True)], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(same)), batch.column(1).filter(pa.array(same))], names=["u", "v"]
            )

    return run


def _block_neighbours(tau: int):
    """For each line of a block pair, the earliest first place among lines within its edits."""

    def run(table: pa.Table) -> pa.Table:
        line, side = table["line"].to_pylist(), table["own"].to_pylist()
        texts = table["bytes"].to_pylist()
        place = list(zip(table["doc_id"].to_pylist(), table["line_no"].to_pylist(), strict=True))
        order = sorted(range(len(line)), key=lambda i: len(texts[i]))
        a_side = table["a"][0].as_py()
        apart = a_side != table["b"][0].as_py()
        best: dict[int, tuple[int, int]] = {}
        for n, i in enumerate(order):
            most = edits(len(texts[i]), tau)
            for j in order[n + 1 :]:
                if len(texts[j]) - len(texts[i]) > most:
                    break
                if apart and (side[i] == a_side) == (side[j] == a_side):
                    continue
                if within(texts[i], texts[j], most):
                    best[line[i]] = min(best.get(line[i], place[j]), place[j])
                    best[line[j]] = min(best.get(line[j], place[i]), place[i])
        return pa.table({
            "line": pa.array(list(best), pa.int64()), "doc_id": pa.array([d for d, _ in best.values()], pa.int64()),
            "line_no": pa.array([n for _, n in best.values()], pa.int64()),
        })

    return run


def _place():
    return F.struct("doc_id", "line_no")


def removals(docs: DataFrame, tau: int = TAU, least: int = MIN_BYTES) -> DataFrame:
    """doc_id, text_key, removed (line numbers) of the texts that lose lines."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")
    ).filter("doc_id is not null and text is not null")
    places = materialize(
        texts.mapInArrow(_places(least), "doc_id long, text_key long, line_no long, line long, rest long"), "line-places"
    )
    firsts = materialize(
        places.groupBy("line", "rest").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("times")), "line-firsts"
    )
    buckets = shuffle_width(docs, 8 << 20)
    ranges = edit_ranges(least, tau)
    met = materialize(
        texts.select("text").mapInArrow(_blocks(buckets, ranges), "bucket int, entries binary")
        .repartition(buckets, "bucket").mapInArrow(_meetings, "u long, v long, hot boolean"),
        "line-meetings",
    )
    pairs = materialize(met.filter("not hot").select("u", "v").distinct(), "line-pairs")
    crowded = met.filter("hot").select(F.col("u").alias("key"), F.col("v").alias("line"))
    asked = pairs.select("u").union(pairs.select("v")).union(crowded.select("line"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.build(asked, bitmap.slot_of_hash("u")))
    candidates = materialize(
        texts.select("text").mapInArrow(_texts(shared, least), "line long, bytes binary").dropDuplicates(["line"]), "line-texts"
    )
    close = (
        pairs.join(candidates.select(F.col("line").alias("u"), F.col("bytes").alias("left")), "u")
        .join(candidates.select(F.col("line").alias("v"), F.col("bytes").alias("right")), "v")
        .select("u", "v", "left", "right").mapInArrow(_confirm(tau), "u long, v long")
    )
    close = materialize(close, "line-links")
    both = close.unionByName(close.select(F.col("v").alias("u"), F.col("u").alias("v")))
    neighbours = both.join(firsts.select(F.col("line").alias("v"), "first"), "v").select(
        F.col("u").alias("line"), "first.doc_id", "first.line_no"
    ).unionByName(_crowded_neighbours(crowded, firsts, candidates, tau))
    earliest = materialize(
        neighbours.groupBy("line").agg(F.min(_place()).alias("near")), "line-earliest"
    )
    # A line matters if it stands in two places or has a neighbour.
    marked = firsts.join(earliest, "line", "left").filter("times > 1 or near is not null").select(
        "line", "rest", F.least("first", F.coalesce("near", "first")).alias("earliest")
    )
    return (
        places.join(marked, ["line", "rest"]).filter(F.col("earliest") < _place())
        .groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("removed"))
    )


def _crowded_neighbours(crowded: DataFrame, firsts: DataFrame, candidates: DataFrame, tau: int) -> DataFrame:
    """Neighbours inside crowded keys, block against block."""
    sizes = crowded.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("lines"))
    units = (
        crowded.distinct().join(sizes, "key")
        .withColumn("blocks", F.ceil(F.col("lines") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "line")
        .join(firsts.select("line", "first.doc_id", "first.line_no"), "line").join(candidates, "line")
    )
    return units.groupBy("key", "a", "b").applyInArrow(_block_neighbours(tau), "line long, doc_id long, line_no long")


def dedup_lines(docs: DataFrame, tau: int = TAU, least: int = MIN_BYTES) -> DataFrame:
    """All columns of ``docs``, the text without its removed lines, and ``lines_removed``."""
    taken = {c.lower() for c in docs.columns}
    doc, key, removed, parts = (next(n for i in range(len(taken) + 1) if (n := f"_{k}{i}") not in taken)
                                for k in ("doc", "key", "removed", "lines"))
    lost = removals(docs, tau, least).withColumnsRenamed({"doc_id": doc, "text_key": key, "removed": removed})
    kept = [c for c in docs.columns if c.lower() != "lines_removed"]
    joined = docs.join(
        lost, (docs["doc_id"].cast("long") == lost[doc]) & (F.xxhash64(docs["text"]) == lost[key]), "left"
    ).select(*[docs[c] for c in kept], removed, F.when(F.col(removed).isNotNull(), F.split(docs["text"], "\n", -1)).alias(parts))
    # The numbers that stay, by a hash set; then one look-up each.
    numbers = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1).cast("array<bigint>"), F.col(removed))
    # Bound by the outer lambda, so that the text is cut once and not for every line.
    left = F.aggregate(F.array(F.col(parts)), F.lit(""), lambda _, p: F.array_join(
        F.transform(numbers, lambda i: F.get(p, i.cast("int"))), "\n"
    ))
    return joined.select(
        *[F.when(F.col(removed).isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(f"`{c}`") for c in kept],
        F.coalesce(F.size(removed), F.lit(0)).alias("lines_removed"),
    )
