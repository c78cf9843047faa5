"""Operators against brute force and defined cases on small tables."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracefold.llm import decontaminate, html_text, lines, media, minhash, mixing, pii, quality, queries, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, start=0):
    return spark.createDataFrame(
        [(start + i, t, None, f"s{i % 2}" if i else None, len(t or "")) for i, t in enumerate(texts)], SCHEMA
    )


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randrange(2, 8))) for _ in range(60)]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    passage, base = prose(30), prose(80)
    near = [" ".join(w if r.random() > 0.02 else "changed" for w in base.split()) for _ in range(6)]
    found = [None, "", "  ", "one two", "One TWO", base, base, *near]
    found += [f"{prose(20)}\n{passage} {prose(5)}\n{prose(12)}" for _ in range(6)]
    return [*found, prose(3000), "x" * 400]


def shingle_set(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def test_minhash_components(spark, texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    for i, a in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(a), root[i], root[i] == i)


def test_repeated_strings(spark, texts):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        own = [data[j : j + 50] for j in range(len(data) - 49)]
        gone = {j + k for j, w in enumerate(own) if w in seen for k in range(50)}
        seen.update(own)
        want[i] = (len(data), len(gone), bytes(b for j, b in enumerate(data) if j not in gone))
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in substrings.remove_repeats(frame(spark, texts)).collect()}
    assert got == want


def test_crowded_anchors_give_the_same(spark, texts, monkeypatch):
    plain = {r.doc_id: bytes(r.kept) for r in substrings.remove_repeats(frame(spark, texts)).collect()}
    monkeypatch.setattr(substrings, "HOT", 1)
    assert {r.doc_id: bytes(r.kept) for r in substrings.remove_repeats(frame(spark, texts)).collect()} == plain


def test_lines(spark):
    long_line = "this is a line that is long enough"
    docs = frame(spark, [f"{long_line}\nshort", f"{long_line}!\nshort\nown words of the second text", None, "", long_line])
    got = {r.doc_id: (r.text, r.lines_removed) for r in lines.dedup_lines(docs).collect()}
    assert got[0] == (f"{long_line}\nshort", 0)
    assert got[1] == ("short\nown words of the second text", 1)
    assert got[2] == (None, 0) and got[3] == ("", 0) and got[4] == ("", 1)


def test_short_lines_repeat_too(spark, tmp_path):
    r = random.Random(7)
    short = ["Share this", "版权所有", "a", "}", "  x", " ", "", "All rights reserved.", "Read more", "posted in news"]
    own = ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(1, 40))) for _ in range(80)]
    pool = [*short, *own, *(f"{x[: len(x) // 2]}Z{x[len(x) // 2 + 1 :]}" for x in own), *(f"{x}!!" for x in own)]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randrange(1, 9))) for _ in range(60)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    seen, want = set(), {}
    for i, text in enumerate(texts):
        kept = []
        for line in text.split("\n"):
            data = line.encode()
            near = any(distance(data, x) <= min(2, min(len(data), len(x)) // 12) for x in seen)
            if not near or not line.strip():
                kept.append(line)
            if line.strip():
                seen.add(data)
        removed = len(text.split("\n")) - len(kept)
        want[i] = (removed, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.lines_removed, x.kept_sha256) for x in queries.op4(spark, str(tmp_path)).collect()}
    assert got == want


def test_documents_of_own_short_lines_stay(spark):
    header = "a header line that many documents share"
    own = "\n".join(f"own {i}" for i in range(100))
    docs = frame(spark, [header, f"{header}\n{own}", f"{header}\n \nown 7\n", f"{header}\n\n版权", None, "", " \n"])
    got = {x.doc_id: (x.text, x.n_chars) for x in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {
        0: (header, len(header)), 1: (own, len(own)), 3: ("\n版权", 3), 4: (None, 0), 5: ("", 0), 6: (" \n", 2)
    }


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "tiny item")], "item_id long, text string")
    docs = frame(spark, [f"before {item.upper()} after", "nothing here", None, "a tiny item b", item.replace("lambda mu", "else")])
    got = {(r.doc_id, r.item_id, r.first_word) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, 1, 1), (3, 3, 1)}
    assert {r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()} == {1, 2, 4}


def test_personal_data(spark):
    text = "Mail é a.b@c.example.org, ip 10.0.0.255 or 999.1.1.1, card 4111 1111 1111 1111, call +1 (456) 555-2186 now"
    rows = pii.find(frame(spark, [text, None, ""])).select("doc_id", pii.spelled(F.col("base")).alias("s")).collect()
    got = {r.doc_id: r.s for r in rows}
    want = [("email", "a.b@c.example.org"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (456) 555-2186")]
    assert got[0] == ",".join(f"{k}:{text.index(v)}:{text.index(v) + len(v)}" for k, v in want)
    assert got[1] == got[2] == ""


def test_patterns_discover_unseen_identifiers(spark):
    seeds = [(3, f"+1 (20{i}) 555-218{i}", "phone:") for i in range(8)]
    found = pii.discover(
        spark.createDataFrame(seeds, "kind int, hit string, before string"),
        spark.createDataFrame([("+1 (999) 555-0000", "phone:"), ("v2", "phone:"), ("+1 (111) 555-0000", "other")], "hit string, before string"),
    )
    assert {(r.kind, r.hit) for r in found.collect()} == {(3, "+1 (999) 555-0000")}


def test_media_round_trip(spark, texts):
    rows = media.media_columns(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = media.payload_of((texts[r.doc_id] or "").encode())
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.width * r.height == len(payload)
        assert media.decode(media.encode(payload)) == payload


def test_html_layout():
    page = (
        "<title>no</title><p>one<p>two <b>three</b><ul><li>a<li>b</ul><table><tr><td>x<td>yy<tr><td>zzz<td>w</table>"
        "<div style='display:none'>hidden</div><script>var a='</p>'</script><pre>k\n  l</pre>tail &amp; end <"
    )
    assert html_text.render(html_text.parse(page)) == "one\n\ntwo three\n\n- a\n- b\n\nx    yy\nzzz  w\n\nk\n  l\n\ntail & end <"
    assert html_text.render(html_text.parse("")) == ""
    assert html_text.render(html_text.parse("<div>" * 3000 + "deep")) == "deep"


def test_mixing_reaches_targets(spark, texts):
    rows = mixing.mix(frame(spark, texts)).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert r.taken <= 3 * r["size"]
        by.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    assert abs(sum(t for _, t, _ in by.values()) - total) < 1e-6
    for taken, target, size in by.values():
        assert abs(taken - target) <= 1 and target <= 3 * size
    order = [r.position for r in mixing.curriculum(frame(spark, texts)).collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1


def test_classifiers_learn_and_take_empty_texts(spark):
    r = random.Random(1)
    good = [" ".join(r.choice(["sun", "moon", "river", "stone"]) for _ in range(30)) for _ in range(60)]
    bad = [t.replace("sun", "awful!!") for t in good]
    docs = frame(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 60), int(i >= 60)) for i in range(120)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, F.col("doc_id") % 3 != 0)
    got = {x.doc_id: x.predicted for x in quality.score(docs, model).collect()}
    assert sum(got[i] == int(i < 60) for i in range(120)) > 110 and len(got) == 122
    network = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 0)
    got = {x.doc_id: x.predicted for x in toxicity.score(docs, network).collect()}
    assert sum(got[i] == int(i >= 60) for i in range(120)) > 105 and got[120] == got[121]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0
    assert substrings.remove_repeats(docs).count() == 0
    assert lines.dedup_lines(docs).count() == 0
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert pii.find(docs).count() == 0
    assert media.media_columns(docs).count() == 0
    assert mixing.curriculum(docs).count() == 0
    assert quality.score(docs, quality.fit(docs, labels, F.lit(True))).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).count() == 0
