"""Texts with fewer words than a benchmark item."""

from __future__ import annotations

from tracefold.llm import decontaminate


def test_truncated_item_is_found_in_a_short_text(spark):
    item = [f"word{i}" for i in range(30)]
    texts = [item[:28], item[2:], item[:24], item[:25], [*item[:26], "other"], ["before", *item[:28]], item[:4], []]

    def similarity(words):
        a = {tuple(item[i : i + 5]) for i in range(26)}
        b = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        return len(a & b) / len(a | b)

    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (round(r.similarity, 9), r.first_word, r.n_words) for r in decontaminate.contaminated(docs, bench).collect()}
    want = {i: (round(similarity(t), 9), 0, len(t)) for i, t in enumerate(texts) if similarity(t) >= 0.8}
    assert got == want and set(got) == {0, 1, 3, 4, 5}
    assert {r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()} == {2, 6, 7}
