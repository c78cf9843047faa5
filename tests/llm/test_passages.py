"""Repeated passages against brute force."""

from __future__ import annotations

import random
import re

import pytest

from tracefold.llm.passages import LENGTH, remove_passages

SCHEMA = "doc_id long, text string"


def brute(rows):
    """(n_words, n_removed, kept) per row, in order; windows start at (doc_id, word)."""
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    for (doc, _), own in zip(rows, words, strict=True):
        for i in range(len(own) - LENGTH + 1) if doc is not None else ():
            key = tuple(own[i : i + LENGTH])
            first[key] = min(first.get(key, (doc, i)), (doc, i))
    out = []
    for (doc, _), own in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(own) - LENGTH + 1) if doc is not None else ():
            if first[tuple(own[i : i + LENGTH])] < (doc, i):
                gone.update(range(i, i + LENGTH))
        out.append((doc, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return sorted(out, key=str)


def texts(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(r.choice([2, 6, 40, 400]))]

    def prose(n):
        return [r.choice(vocabulary) for _ in range(n)]

    passage, frame = prose(60), prose(45)
    found = [prose(r.randrange(0, 60)) for _ in range(10)]
    for _ in range(25):
        a = r.randrange(40)
        part = passage[a : a + r.randrange(15, 45)]
        if r.random() < 0.4:
            part[r.randrange(len(part))] = "changed"
        found.append(prose(r.randrange(12)) + part + prose(r.randrange(12)) + (part if r.random() < 0.2 else []))
    found += [frame, list(frame), frame[:20], frame[25:], ["a"] * 90, ["a", "b"] * 40, ["a"] * 19, ["a"] * 20]
    return [r.choice([" ", "\t", "\n ", "  "]).join(x) for x in found]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_brute_force(spark, seed):
    rows = [(3 * i, t) for i, t in enumerate(texts(seed))] + [(400, None), (401, ""), (402, " \n ")]
    got = remove_passages(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows)
    for r in got:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_shared_ids_null_ids_and_other_columns(spark):
    same = " ".join(f"x{i}" for i in range(30))
    rows = [(1, same), (1, same), (1, f"own {same}"), (None, same), (2, same), (2, same)]
    docs = spark.createDataFrame([(*r, 7, "k") for r in rows], f"{SCHEMA}, doc int, key string")
    docs = docs.withColumnsRenamed({"key": "ranges"})
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_passages(docs).collect()), key=str)
    assert got == brute(rows)
    assert remove_passages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_text(spark):
    r = random.Random(5)
    long = " ".join(str(r.randrange(10**6)) for _ in range(200_000))
    rows = [(1, long), (2, "start " + long[: len(long) // 2]), (3, "y" * 3_000_000)]
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in remove_passages(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)
