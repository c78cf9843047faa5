"""Terms as integers against plain counting, with rows of one id and cuts at every place."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tracefold.operators import features as X, terms


def plain(spec, tokens):
    if spec.analyzer == "word":
        for n in range(spec.ngram_min, spec.ngram_max + 1):
            yield from (" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1))
        return
    for word in tokens:
        p = f" {word} "
        if len(p) < spec.ngram_min:
            yield p
        for n in range(spec.ngram_min, spec.ngram_max + 1):
            yield from (p[i : i + n] for i in range(len(p) - n + 1))


@pytest.mark.parametrize("spec", [
    X.TermSpec("word", 1, 3), X.TermSpec("word", 2, 2), X.TermSpec("char_wb", 3, 5), X.TermSpec("char_wb", 4, 6),
])
@pytest.mark.parametrize("size", [3, 1 << 19])
def test_counts_match_plain_counting(monkeypatch, spec, size):
    monkeypatch.setattr(terms, "TOKENS", size)
    monkeypatch.setattr(terms, "PAIRS", size)
    rng = np.random.default_rng(5)
    words = ["a", "bb", "aaaa", "é\0", "\0", "日本語", "😀x", "long" * 9, "ab"]
    ids = sorted(f"d{i}" for i in rng.integers(0, 12, 30))
    rows = [[words[k] for k in rng.integers(0, len(words), rng.integers(0, 8))] for _ in ids]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(ids[a : a + 4]), pa.array(rows[a : a + 4], pa.list_(pa.string()))], names=["i", "t"])
        for a in range(0, 30, 4)
    ]
    want = defaultdict(Counter)
    for i, tokens in zip(ids, rows):
        want[i].update(plain(spec, tokens))
    df, total = Counter(), Counter()
    for _, document, (tokens,) in terms.documents(iter(batches)):
        names, d, t = terms.statistics(spec, document, tokens)
        for name, x, y in zip(names.to_pylist(), d.tolist(), t.tolist()):
            df[name] += x
            total[name] += y
    assert total == sum(want.values(), Counter())
    assert df == Counter(t for c in want.values() for t in c)
    known = pa.array(sorted(total)[::2])
    found = {}
    for part, document, (tokens,) in terms.documents(iter(batches)):
        for d, t, n in zip(*(x.tolist() for x in terms.known_counts(spec, document, tokens, known))):
            found[part[d].as_py(), known[t].as_py()] = n
    assert found == {(i, t): n for i, c in want.items() for t, n in c.items() if t in set(known.to_pylist())}


def test_statistics_are_not_grouped_by_document(spark):
    docs = spark.createDataFrame([("a", "x y x"), ("b", "x y")], "stable_id string, text string")
    plan = X.term_statistics(docs, X.CHAR[0])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate(keys=[stable_id" not in plan
