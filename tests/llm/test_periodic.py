"""Periodic runs against brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tracefold.llm.periodic import find_runs, periodic_runs

SCHEMA = "doc_id long, text string"


def brute(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                s = w[i : i + length]
                if not any(s[p:] == s[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sample(r):
    few = r.choice([1, 2, 3, 20])
    block = [r.randrange(few) for _ in range(r.randrange(1, 60))]
    kind = r.randrange(5)
    if kind == 0:
        return [r.randrange(few) for _ in range(r.randrange(300))]
    if kind == 1:
        return [r.randrange(30) for _ in range(r.randrange(40))] + block * r.randrange(1, 9) + [r.randrange(3) for _ in range(30)]
    if kind == 2:  # Fibonacci words are full of runs
        a, b = [0], [0, 1]
        for _ in range(r.randrange(3, 12)):
            a, b = b, b + a
        return b[:400]
    if kind == 3:  # Thue-Morse words, repeated
        return [i.bit_count() % 2 for i in range(r.randrange(10, 120))] * r.randrange(1, 5)
    return ((block[:12] * r.randrange(1, 6) + [r.randrange(3)]) * r.randrange(1, 8)) * r.randrange(1, 4)


def test_runs_equal_brute_force():
    r = random.Random(5)
    found = 0
    for _ in range(600):
        w = sample(r)
        want = brute(w)
        assert find_runs(np.array(w, np.int32)) == want
        found += len(want)
    assert found > 500


def planted(doc, words):
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("plant", [False, True])
def test_documents(spark, plant):
    r = random.Random(9)
    rows = [(i, r.choice([" ", "\n", "\t "]).join(f"é{x}" for x in sample(r))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "a " * 40), (203, "a " * 24), (203, "a " * 24), (204, "a " * 23)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], f"{SCHEMA}, n_words int").repartition(3)
    got = sorted(((x.doc_id, x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in periodic_runs(docs, plant).collect()), key=str)
    want = []
    for doc, text in rows:
        words = (text or "").split()
        words = planted(doc, words) if plant and doc is not None else words
        runs = brute(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((doc, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert got == sorted(want, key=str)
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_text(spark):
    text = "b c " * 300_000 + "x " * 100_000
    row = periodic_runs(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert [tuple(x) for x in row.runs] == [(0, 600_000, 2), (600_000, 100_000, 1)]
    assert row.collapsed == "b c x"
