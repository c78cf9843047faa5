"""Periodic runs of words inside documents, by seed and extend on diagonals.

A run is a maximal stretch whose words repeat at distance q (its smallest period) with at least
``LENGTH`` words and ``TIMES`` periods.  On the diagonal of lag q (word i against word i + q) a
run of period q is a stretch of at least max(LENGTH - q, (TIMES - 1) * q) equal pairs.

1. Index: for every level k = 16, 32, 64, ... the k-grams of a text are named by doubling (a pair
   of names of half the length), and only repeated grams go on to the next level.  Level 16
   serves the lags 1 to 16, level k the lags k/2 + 1 to k; a run of such a lag
   overlaps itself by k words at least, so it holds an equal pair of k-grams at its lag.
2. Seeds: each k-gram with its next occurrence in the same text.  A k-gram is as long as its
   lag at least, so inside a run of smallest period q the next occurrence stands exactly q words on
   (the period's word is primitive); no other pair of the same gram is needed, and pairs
   grow with the words.
3. Extension: a seed is extended along its diagonal to both sides, by word codes that are equal only
   for equal bytes.  The table of furthest covered positions, one per lag, suppresses seeds that
   an earlier extension of the lag has passed.
4. Stretches that are long enough are runs; by the primitivity above their lag is the smallest period.

Texts are independent: no shuffle, and a task holds one text and its names.  Texts in which no
16-gram hash stands twice have no seed and are passed at once.

Defined cases: null and empty texts have no words and no run.  Repeated rows have equal results.
A null id changes no words (``planted``).  Other columns are kept by none of the functions here
and may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracefold.llm.named import lanes, named_words
from tracefold.llm.words import join_hashes, pieces

LENGTH, TIMES = 24, 3
LEAST = 16  # smallest overlap max(LENGTH - q, (TIMES - 1) * q) over all q
CHUNK = 256

RUNS = "runs array<struct<start:long,length:long,period:long>>"


def _names(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row, equal for equal rows, and how often it stands."""
    key = columns[0]
    for other in columns[1:]:
        key = key * (int(other.max()) + 1) + other
    _, name, count = np.unique(key, return_inverse=True, return_counts=True)
    return name, count


def grams(codes: np.ndarray):
    """(k, positions, names) of the repeated k-grams of a text, for k = LEAST, 2 * LEAST, ..."""
    at, name = np.arange(len(codes)), _names(codes.astype(np.int64))[0]
    k = 1
    whole = np.full(len(codes), -1, np.int64)
    while True:
        if k >= LEAST:
            yield k, at, name
        # A gram of 2k words is a pair of k-grams; both halves of a repeated one are repeated.
        whole[:] = -1
        whole[at] = name
        at = at[at + k < len(codes)]
        at = at[whole[at + k] >= 0]
        if len(at) < 2:
            return
        name, count = _names(whole[at], whole[at + k])
        often = count[name] > 1
        at, name = at[often], name[often]
        k *= 2
        if len(at) < 2:
            return


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal first elements, compared in growing chunks."""
    n, done, step = min(len(a), len(b)), 0, CHUNK
    while done < n:
        differs = np.flatnonzero(a[done : done + step] != b[done : done + step])
        if len(differs):
            return done + int(differs[0])
        done, step = done + step, step * 2
    return n


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text, by start, then period."""
    n = len(codes)
    runs = []
    if n < LENGTH:
        return runs
    covered: dict[int, int] = {}  # lag: position before which its diagonal is done
    for k, at, name in grams(codes):
        order = np.lexsort((at, name))
        here, there = at[order][:-1], at[order][1:]
        lag = there - here
        near = (name[order][1:] == name[order][:-1]) & (lag <= k) & ((lag > k // 2) | (k == LEAST))
        here, lag = here[near], lag[near]
        order = np.lexsort((here, lag))
        here, lag = here[order], lag[order]
        # Neighbouring seeds of one lag lie on one stretch; the first stands for them.
        head = np.ones(len(here), bool)
        head[1:] = (lag[1:] != lag[:-1]) | (here[1:] != here[:-1] + 1)
        for i, q in zip(here[head].tolist(), lag[head].tolist(), strict=True):
            done = covered.get(q, 0)
            if i < done:
                continue
            left = _reach(codes[done:i][::-1], codes[done + q : i + q][::-1])
            right = _reach(codes[i : n - q], codes[i + q :])
            covered[q] = i + right + 1
            length = left + right + q
            if length >= max(LENGTH, TIMES * q):
                runs.append((i - left, length, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def plant(doc_id: int | None, n: int) -> np.ndarray:
    """Number of the original word at each place of a text with planted runs (see the query)."""
    place = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return place
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place[a:] = a + (place[a:] - a) % p
    return place


def _repeating(one: np.ndarray, two: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether some LEAST-gram hash stands twice in a text."""
    again = np.zeros(len(first) - 1, bool)
    gram = join_hashes(one, LEAST)
    if not len(gram):
        return again
    text = np.searchsorted(first, np.arange(len(gram)), "right") - 1
    inside = np.arange(len(gram)) + LEAST <= first[text + 1]
    gram, text = gram[inside], text[inside]
    order = np.lexsort((gram, text))
    same = (gram[order][1:] == gram[order][:-1]) & (text[order][1:] == text[order][:-1])
    again[text[order][1:][same]] = True
    return again


def _search(planted: bool):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, data, offsets in pieces(batch.column(1)):
                codes, names, first = named_words(data, offsets)
                one, two = lanes(names)
                maybe = _repeating(one[codes], two[codes], first)
                found, counts, kept = [], [], []
                for d in range(b - a):
                    own = codes[first[d] : first[d + 1]]
                    place = plant(ids[a + d], len(own)) if planted else None
                    changed = place is not None and len(own) and int(place[-1]) != len(own) - 1
                    if changed:
                        own = own[place]
                    runs = find_runs(own) if changed or maybe[d] else []
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    counts.append(len(own))
                    stay = names.take(pa.array(own[collapsed(len(own), runs)]))
                    kept.append(b" ".join(stay.to_pylist()).decode())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()),
                    pa.array(found, pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))),
                    pa.array(kept, pa.string()),
                ], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed (text without the repeats).

    ``planted``: search the words that ``plant`` makes of a text instead of the text itself.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return texts.mapInArrow(_search(planted), f"doc_id long, n_words long, {RUNS}, collapsed string")
