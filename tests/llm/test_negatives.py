"""Hard negatives against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import negatives
from tracefold.llm.negatives import hard_negatives, quantized

SCHEMA = "vec_id long, label long, vector array<int>"


def brute(rows, anchor, positives=5, negatives_=3):
    rows = [r for r in rows if None not in r]
    width = max((len(v) for *_, v in rows), default=0)
    ids = [r[0] for r in rows]
    points = np.array([list(v) + [0] * (width - len(v)) for *_, v in rows], object).reshape(len(rows), width)
    out = []
    for i, (own, label, _) in enumerate(rows):
        if not anchor(own):
            continue
        score = points @ points[i]
        order = sorted(range(len(rows)), key=lambda j: (-score[j], ids[j]))
        for p in [j for j in order if j != i and rows[j][1] == label][:positives]:
            found = [j for j in order if rows[j][1] != label and 50 * score[p] <= 100 * score[j] <= 95 * score[p]]
            out += [(own, ids[p], k + 1, ids[j], score[p], score[j]) for k, j in enumerate(found[:negatives_])]
    return sorted(out)


def mined(df, **more):
    return sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 5 == 0, **more).collect()))


@pytest.mark.parametrize("n,dims,labels,scale,seed", [(700, 6, 3, 50, 1), (250, 2, 40, 4, 2), (400, 16, 5, 2000, 3), (30, 3, 1, 9, 4)])
def test_equal_to_brute_force(spark, monkeypatch, n, dims, labels, scale, seed):
    monkeypatch.setattr(negatives, "TILE", 100)
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(negatives, "BLOCK", 30)
    r = np.random.default_rng(seed)
    points = (r.normal(size=(n, dims)) * scale).astype(int)
    points[: n // 8] = points[0]
    rows = [(int(i), int(k), p.tolist()) for i, k, p in zip(r.permutation(3 * n)[:n], r.integers(0, labels, n), points)]
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows, lambda i: i % 5 == 0)


def test_rows_without_part_and_clashing_names(spark):
    rows = [(i, i % 2, [i, 3 * i % 7, -i]) for i in range(1, 60)] + [(None, 1, [1, 2, 3]), (61, None, [1, 2, 3]), (62, 0, None), (65, 1, [4])]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], f"{SCHEMA}, part int, anchor_id string")
    assert mined(docs) == brute(rows, lambda i: i % 5 == 0)
    assert mined(docs.unionByName(docs)) == mined(docs)  # rows that share an id count once
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(docs.filter("vec_id % 5 <> 0")) == []


def test_large_components_stay_exact(spark):
    big = negatives.LIMIT
    rows = [(i, i % 2, [big - i * i, big - 7 * i, -big + i]) for i in range(40)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows, lambda i: i % 5 == 0)


def test_quantized(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([0.5, -0.001, 0.25],), ([nan, 1.0],), ([inf],), ([None, 1.0],), (None,), ([],), ([1e30, -1e30],)]
    got = [r[0] for r in spark.createDataFrame(rows, "e array<float>").select(quantized(F.col("e"), 256)).collect()]
    big = negatives.LIMIT
    assert got == [[128, -1, 64], None, None, None, None, [], [big, -big]]
