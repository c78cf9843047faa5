"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

A window of an item's length is compared with the item by weighted similarity of word
shingles (five words; weight = number of occurrences): sum of minima over sum of maxima, at
least 0.8.  A text with fewer words than the item is one window of all its words.

1. Two texts with that similarity share (0.8 / 1.8) of their shingles together, occurrences
   counted.  An item is looked for in a text only if the text holds so many occurrences of its
   shingles, and only in windows around these; this leaves out no match.
2. A window's 64-bit SimHash is taken over (shingle, number of its occurrence in the window), each
   with weight one.  Minima and maxima of counts are intersections and unions of such pairs, so for any
   weights similarity 0.8 is a cosine of at least 0.88: an expected distance of 10 bits
   with a deviation of 3.  Sliding by a word takes one pair out and puts one in.
3. Eight 8-bit block indexes hold each item under all values within two bits; by the pigeonhole
   rule they give every item within Hamming distance 23.  That leaves out a true match with a
   probability of about 2e-6.
4. Items within that distance are confirmed by the exact weighted similarity.

The items' index is sent to all tasks in parts of at most ``PART_BYTES`` of item text; with
more items the documents are scanned once per part.

Defined cases: null and empty texts and items match nothing.  Items of fewer than five words
are one shingle of their whole length.  Repeated items and repeated documents are reported
each.  An item with a null id is reported with a null id.  Columns of the documents other than
doc_id and text may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracefold.llm.named import lanes, named_words
from tracefold.llm.words import LOWER, U, join_hashes, mix, pieces

SHINGLE, PERCENT = 5, 80
BLOCKS, RADIUS = 8, 23
PART_BYTES = 4 << 20
SLAB = 1 << 15

_BITS = np.arange(64, dtype=U)
_NEAR = np.array([v for v in range(256) if v.bit_count() <= RADIUS // BLOCKS], np.uint8)
_STEP = U(0xA0761D6478BD642F)


def word_digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digest of each lower-cased word, and the first word number per text."""
    codes, names, first = named_words(LOWER[data], offsets)
    return lanes(names)[0][codes], first


def _signs(h: np.ndarray) -> np.ndarray:
    return (((h[:, None] >> _BITS) & U(1)).astype(np.int8) * 2 - 1)


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(U).reshape(-1)


def _numbered(h: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """Hash of (shingle, number of its occurrence)."""
    return mix(h + occurrence.astype(U) * _STEP)


def window_prints(h: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every run of ``width`` shingles of ``h``."""
    n = len(h)
    place = np.arange(n)
    name = np.unique(h, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(name, kind="stable")
    keys = (name * n + place)[order]
    rank = np.empty(n, np.int64)
    rank[order] = place
    # Occurrences up to a shingle in the window that it enters, and from it in the window that it leaves.
    entering = rank - np.searchsorted(keys, name * n + np.maximum(place - width + 1, 0)) + 1
    leaving = np.searchsorted(keys, name * n + np.minimum(place + width, n) - 1, "right") - rank
    enter = _signs(_numbered(h, entering))
    sums = np.empty((n - width + 1, 64), np.int32)
    sums[0] = enter[:width].sum(0, dtype=np.int32)
    sums[1:] = enter[width:]
    sums[1:] -= _signs(_numbered(h[: n - width], leaving[: n - width]))
    return _pack(np.cumsum(sums, axis=0, dtype=np.int32, out=sums))


def needed(width: int, full: int) -> int:
    """Shared shingles, occurrences counted, that windows of these sizes need."""
    return -(-PERCENT * (width + full) // (100 + PERCENT))


class _Group:
    """Items of one length: shingle counts and the block indexes, one bit per item."""

    def __init__(self, length: int, items: list[tuple[int, np.ndarray]]):
        self.length, self.items = length, items
        self.counts = [dict(zip(*(x.tolist() for x in np.unique(h, return_counts=True)), strict=True)) for _, h in items]
        self.prints = np.concatenate([window_prints(h, len(h)) for _, h in items])
        table = np.zeros((BLOCKS, 256, len(items)), bool)
        for i, value in enumerate(self.prints.view(np.uint8).reshape(-1, 8)):
            for b in range(BLOCKS):
                table[b, value[b] ^ _NEAR, i] = True
        self.table = np.packbits(table, axis=2)

    def candidates(self, prints: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, items) within the radius, among the ``allowed`` items (one flag per item)."""
        blocks = prints.view(np.uint8).reshape(-1, 8)
        found = self.table[0, blocks[:, 0]]
        for b in range(1, BLOCKS):
            found |= self.table[b, blocks[:, b]]
        found &= np.packbits(allowed)
        window = np.flatnonzero(found.any(1))
        row, item = np.nonzero(np.unpackbits(found[window], axis=1, count=len(self.items)))
        window = window[row]
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[close], item[close]


class Index:
    """Benchmark items by shingle size and length, and the items of each shingle."""

    def __init__(self, items: list[tuple[int, str]]):
        self.groups: dict[int, list[_Group]] = defaultdict(list)
        self.anchors: dict[int, np.ndarray] = {}
        self.quick: dict[int, np.ndarray] = {}
        self.postings: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length = defaultdict(list)
        for item, text in items:
            for _, _, data, offsets in pieces(pa.array([text], pa.string())):
                h, _ = word_digests(data, offsets)
                if len(h):
                    k = min(SHINGLE, len(h))
                    by_length[k, len(h)].append((item, join_hashes(h, k)))
        for (k, length), group in sorted(by_length.items(), key=lambda x: x[0]):
            self.groups[k].append(_Group(length, group))
        for k, groups in self.groups.items():
            own = [np.unique(h) for g in groups for _, h in g.items]
            self.anchors[k] = np.unique(np.concatenate(own))
            self.quick[k] = np.zeros(1 << 16, bool)
            self.quick[k][(self.anchors[k] >> U(48)).astype(np.int64)] = True
            anchor = np.searchsorted(self.anchors[k], np.concatenate(own))
            item = np.repeat(np.arange(len(own)), [len(x) for x in own])
            order = np.argsort(anchor, kind="stable")
            starts = np.searchsorted(anchor[order], np.arange(len(self.anchors[k]) + 1))
            self.postings[k] = starts, item[order]

    def search(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, object, float, int, int]]:
        """(text number, item, similarity, first word, words): best window per text and item."""
        best: dict[tuple[int, int, int, int], tuple[float, int]] = {}
        for k in self.groups:
            joined = join_hashes(h, k)
            maybe = np.flatnonzero(self.quick[k][(joined >> U(48)).astype(np.int64)])
            place = np.searchsorted(self.anchors[k], joined[maybe])
            place[place == len(self.anchors[k])] = 0
            same = self.anchors[k][place] == joined[maybe]
            at, anchor = maybe[same], place[same]
            text = np.searchsorted(first, at, "right") - 1
            inside = at + k <= first[text + 1]
            at, anchor, text = at[inside], anchor[inside], text[inside]
            cuts = np.r_[0, np.flatnonzero(np.diff(text)) + 1, len(text)] if len(text) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                d = int(text[a])
                self._text(joined, at[a:b], anchor[a:b], k, int(first[d]), int(first[d + 1]), d, best)
        return [(d, self.groups[k][g].items[i][0], s, p, min(self.groups[k][g].length, int(first[d + 1] - first[d])))
                for (d, k, g, i), (s, p) in best.items()]

    def _text(self, joined, at, anchor, k, begin, end, d, best) -> None:
        """Look in one text for the items of which it holds enough shingles."""
        starts, items = self.postings[k]
        seen, times = np.unique(anchor, return_counts=True)
        counts = starts[seen + 1] - starts[seen]
        jump = np.repeat(starts[seen] - np.r_[0, np.cumsum(counts)[:-1]], counts)
        hits = np.bincount(items[np.arange(len(jump)) + jump], np.repeat(times, counts), int(items.max()) + 1)
        base = 0
        for g, group in enumerate(self.groups[k]):
            own = hits[base : base + len(group.items)]
            width, full = min(group.length, end - begin) - k + 1, group.length - k + 1
            allowed = own >= needed(width, full)
            if 100 * width >= PERCENT * full and allowed.any():
                held = np.zeros(len(self.anchors[k]), bool)
                for i in np.flatnonzero(allowed).tolist():
                    held[np.searchsorted(self.anchors[k], group.items[i][1])] = True
                self._windows(joined, at[held[anchor]], k, begin, end, group, allowed, (d, k, g), best)
            base += len(group.items)

    @staticmethod
    def _windows(joined, at, k, begin, end, group, allowed, key, best) -> None:
        """Compare the windows of one text that hold an anchor with one length's items."""
        length = min(group.length, end - begin)
        full, width = group.length - k + 1, length - k + 1  # shingles of an item and per window
        low = np.maximum(at - width + 1, begin)
        high = np.minimum(at, end - length) + 1
        low, high = low[high > low], high[high > low]
        if not len(low):
            return
        # Union of the start ranges, in slabs.
        starts = np.zeros(int(high.max() - low.min()) + 1, np.int32)
        np.add.at(starts, low - low.min(), 1)
        np.add.at(starts, high - low.min(), -1)
        windows = np.flatnonzero(np.cumsum(starts[:-1]) > 0) + low.min()
        for a in range(0, len(windows), SLAB):
            part = windows[a : a + SLAB]
            for run in np.split(part, np.flatnonzero(np.diff(part) > width) + 1):
                base = int(run[0])
                prints = window_prints(joined[base : int(run[-1]) + width], width)[run - base]
                for w, i in zip(*(x.tolist() for x in group.candidates(prints, allowed)), strict=True):
                    p = int(run[w])
                    similarity = _similarity(joined[p : p + width], group.counts[i], full + width)
                    if 100 * similarity[0] >= PERCENT * similarity[1]:
                        value = (similarity[0] / similarity[1], p - begin)
                        old = best.get((*key, i))
                        if old is None or (-value[0], value[1]) < (-old[0], old[1]):
                            best[*key, i] = value


def _similarity(window: np.ndarray, counts: dict[int, int], both: int) -> tuple[int, int]:
    """Sum of minima and sum of maxima of the shingle counts; ``both``: shingles of window and item."""
    same = 0
    for value, n in zip(*(x.tolist() for x in np.unique(window, return_counts=True)), strict=True):
        same += min(n, counts.get(value, 0))
    return same, both - same


def _indexes(benchmark: DataFrame) -> list:
    """One broadcast index per part of at most about ``PART_BYTES`` of item text."""
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // PART_BYTES))
    # Items are dealt by text hash and length, so a part holds about its share of the bytes.
    part = F.pmod(F.xxhash64("text", "item_id"), F.lit(parts))
    context = benchmark.sparkSession.sparkContext
    for p in range(parts):
        rows = items.filter(part == p).collect()
        yield context.broadcast(Index(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words of the best window of each match."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scan(shared):
        def run(batches):
            for batch in batches:
                for a, _, data, offsets in pieces(batch.column(1)):
                    found = shared.value.search(*word_digests(data, offsets))
                    if found:
                        d, item, similarity, place, length = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).take(pa.array([a + x for x in d])), pa.array(item, pa.int64()),
                            pa.array(similarity, pa.float64()), pa.array(place, pa.int64()), pa.array(length, pa.int64()),
                        ], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        return texts.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long")

    return reduce(DataFrame.unionByName, [scan(shared) for shared in _indexes(benchmark)])


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; no join and no shuffle."""
    for shared in _indexes(benchmark):
        at = docs.columns.index("text")

        def run(batches, shared=shared, at=at):
            for batch in batches:
                for a, b, data, offsets in pieces(batch.column(at)):
                    clean = np.ones(b - a, bool)
                    for d, *_ in shared.value.search(*word_digests(data, offsets)):
                        clean[d] = False
                    yield batch.slice(a, b - a).filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
