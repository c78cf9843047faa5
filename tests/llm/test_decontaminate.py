"""Decontamination against brute force, repeated runs and uneven weights included."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest

from tracefold.llm.decontaminate import Index, contaminated, word_digests
from tracefold.llm.words import pieces


def search(items, texts):
    index, out = Index(items), {}
    for a, _, data, offsets in pieces(pa.array(texts)):
        for d, item, similarity, place, length in index.search(*word_digests(data, offsets)):
            out[a + d, item] = (round(similarity, 9), place, length)
    return out


def shingles(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(items, texts):
    out = {}
    for item, body in items:
        own = body.lower().split()
        k = min(5, len(own))
        for d, text in enumerate(texts):
            words = text.lower().split()
            length, best = min(len(own), len(words)), None
            if not own or length < k:
                continue
            for p in range(len(words) - length + 1):
                a, b = shingles(words[p : p + length], k), shingles(own, k)
                same, every = sum((a & b).values()), sum((a | b).values())
                if 100 * same >= 80 * every and (best is None or (-same / every, p) < best):
                    best = (-same / every, p)
            if best:
                out[d, item] = (round(-best[0], 9), best[1], length)
    return out


@pytest.mark.parametrize("size,times", [(250, 28), (120, 12)])
def test_repeated_runs_are_found(size, times):
    for seed in range(30):
        r = random.Random(seed)
        own = [f"w{r.randrange(10**6)}" for _ in range(size)]
        assert (0, 1) in search([(1, " ".join(own + ["x"] * times))], [" ".join(own + ["y"] * times)])


@pytest.mark.parametrize("seed", range(12))
def test_equal_to_brute_force(seed):
    r = random.Random(seed)
    vocabulary = [f"V{i}" for i in range(r.choice([3, 8, 40, 2000]))]

    def prose(n):
        out = []
        while len(out) < n:
            out += [r.choice(vocabulary)] * r.choice([1, 1, 1, 1, 6, 15])
        return out[:n]

    items = [(i, prose(r.randrange(1, 70))) for i in range(12)]
    texts = ["", " \n"]
    for _ in range(25):
        words = list(r.choice(items)[1])
        for _ in range(r.randrange(max(1, len(words) // 12) + 1)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        if r.random() < 0.3:
            words = words[: max(1, len(words) - r.randrange(5))]
        texts.append(" ".join(prose(r.randrange(30)) + words + prose(r.randrange(30))))
    named = [(i, " ".join(x)) for i, x in items]
    assert search(named, texts) == brute(named, texts)


def test_tables(spark):
    item = " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame(
        [(1, f"x {item} y", 1), (2, None, 1), (None, item, 1), (3, item, 1), (3, item, 1), (4, "other words " * 50, 1)], "doc_id long, text string, item_id int"
    )
    bench = spark.createDataFrame([(7, item, "a"), (7, item, "b"), (None, item, "c"), (8, None, "d"), (9, "", "e")], "item_id long, text string, doc_id string")
    got = Counter((r.doc_id, r.item_id, r.first_word) for r in contaminated(docs, bench).collect())
    for doc, n in ((1, 1), (None, 1), (3, 2)):
        assert got[doc, 7, int(doc == 1)] == 2 * n and got[doc, None, int(doc == 1)] == n
    assert sum(got.values()) == 12
    assert contaminated(docs, bench.limit(0)).collect() == [] == contaminated(docs.limit(0), bench).collect()
