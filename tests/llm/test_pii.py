"""Personal data: base spans against plain matching, discovery end to end, long texts."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from tracefold.llm.pii import KINDS, find

SCHEMA = "doc_id long, text string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), KINDS.index(kind), m.end()))
    return sorted(found)


def spans(row, name):
    return sorted((x["start"], x["kind"], x["stop"]) for x in row[name])


def test_base_spans_equal_plain_matching(spark):
    r = random.Random(2)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+49 (30) 1234567", "+1", "+12 3", "4785380592391139", "é", "word", "\n", "  ", "..", "a@b", "9" * 25, "+4+49 30 1234 5678", "00000000000000"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", ",", "x"]) for _ in range(r.randrange(1, 30))) for _ in range(300)]
    rows = [*enumerate(texts), (900, None), (901, ""), (None, "a@b.c"), (902, "a@b.c"), (902, "a@b.c")]
    docs = spark.createDataFrame([(*x, "k", 1) for x in rows], f"{SCHEMA}, base string, free int")
    got = sorted((str(x["doc_id"]), spans(x, "base")) for x in find(docs).collect())
    assert got == sorted((str(d), plain(t)) for d, t in rows)


def test_context_discovers_unseen_forms(spark):
    rows = [(i, f"some text, phone: +49 30 {i:03d}1234 and so on") for i in range(40)]
    rows += [(100, "call me, phone: 555-218-7766 thanks"), (101, "phone: (020) 7946 0958"), (102, "order 555-218-9999 arrived"),
             (103, "phone: 5 pieces"), (104, "version 10.4.2 and 12 items")]
    got = {x["doc_id"]: x for x in find(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = {d: [rows_text(rows, d)[s:e] for s, k, e in spans(got[d], "more") if KINDS[k] == "phone"] for d in range(100, 105)}
    assert found == {100: ["555-218-7766"], 101: ["(020) 7946 0958"], 102: [], 103: [], 104: []}
    assert all(not spans(got[d], "more") for d in range(40))


def test_rounds_go_on_until_they_settle(spark):
    # One word leads to a form, its other occurrences to another word, and that one to the next form.
    rows = [(i, f"tel +49 30 {i:03d}1234 x") for i in range(40)]
    rows += [(100 + i, f"tel 555-218-{1000 + i} x") for i in range(8)]
    rows += [(200 + i, f"ring 555-218-{1000 + i} x") for i in range(8)] + [(300, "ring 777-000-1111 x")]
    got = {x["doc_id"]: spans(x, "more") for x in find(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got[100]) == len(got[203]) == len(got[300]) == 1


def rows_text(rows, doc):
    return next(t for d, t in rows if d == doc)


def test_long_texts_take_linear_time(spark):
    def text(n):
        return " ".join(f"a{i}@b.c x{i}" for i in range(n))

    def seconds(n):
        started = time.time()
        docs = spark.createDataFrame([(1, text(n))], SCHEMA)
        row = find(docs).select(F.size("base").alias("n")).first()
        assert row["n"] == n
        return time.time() - started

    seconds(100)
    assert seconds(30_000) < 120
