from __future__ import annotations

import hashlib
import re
import unicodedata
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tracefold.functions import ids, instants, scores, text, windows


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_nfc_stable_code_points_never_change():
    spans = re.findall(r"\\x\{([0-9a-f]+)\}-\\x\{([0-9a-f]+)\}", text.NFC_STABLE)
    assert len(spans) >= 8
    for low, high in spans:
        for code in range(int(low, 16), int(high, 16) + 1):
            ch = chr(code)
            assert unicodedata.combining(ch) == 0
            assert unicodedata.is_normalized("NFC", ch)
            # Neither the mark before nor after it may compose with a stable character.
            assert unicodedata.normalize("NFC", "a" + ch + "b") == "a" + ch + "b"


def test_canonical_text_hash_and_combination(spark):
    df = spark.createDataFrame(
        [("Cafe\u0301\r\n", None), ("a\rb", "plain"), ("\u1100\u1161 \u212b", "x")],
        "s string, d string",
    )
    canon = text.with_canonical_text(df, "s", "d")
    out = rows(
        canon.select(
            "s", "d", text.combined_text(F.col("s"), F.col("d")),
            text.exact_text_hash(F.col("s"), F.col("d")),
        )
    )
    assert out[0][:3] == ("Caf\u00e9\n", "", "Caf\u00e9\n\n\n")
    assert out[1][0] == "a\nb"
    assert out[2][0] == unicodedata.normalize("NFC", "\u1100\u1161 \u212b")
    for s, d, _, digest in out:
        assert digest == hashlib.sha256(s.encode() + b"\x00" + d.encode()).hexdigest()
    single = df.select(text.canonical_text(F.col("s")))
    assert [r[0] for r in rows(single)] == [r[0] for r in out]


def test_blank_and_strip_follow_python(spark):
    samples = ["", " ", "\t\n", "\u00a0", "\u2003x", "\x1c", "x", " x ", "\u3000 y\x1f", "a b"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = rows(df.select("s", text.is_blank(F.col("s")), text.strip(F.col("s"))))
    assert got == [(s, s.strip() == "", s.strip()) for s in samples]


@pytest.mark.parametrize("name", ["has_html", "has_url", "has_email", "has_code"])
def test_content_signals_follow_python_patterns(spark, name):
    samples = [
        "", "plain words", "<b>bold</b>", "a < b > c", "</P>", "see HTTPS://x.y", "WWW.site.org",
        "mail me@host.org now", "a@b", "@ . @", "at com.x.Y(File.java:12)", "Traceback (most recent call last)",
        "NullPointerException: x", "public  Foo", "Public\u00a0Été", "```code```", "classify this", "claſs x",
        "http:/broken", "ww.w", "é@é.é", "exceptional case",
    ]
    flags = re.IGNORECASE
    pattern = {
        "has_html": re.compile(text.HTML_PATTERN, flags), "has_url": re.compile(text.URL_PATTERN, flags),
        "has_email": re.compile(text.EMAIL_PATTERN), "has_code": re.compile(text.CODE_PATTERN, flags),
    }[name]
    df = spark.createDataFrame([(s, d) for s in samples for d in ("", "tail")], "s string, d string")
    got = rows(df.select("s", "d", text.content_signals(F.col("s"), F.col("d"))[name]))
    assert got == [
        (s, d, bool(pattern.search(s) or pattern.search(d))) for s in samples for d in ("", "tail")
    ]


def test_timestamps_follow_fromisoformat(spark):
    samples = [
        "2020-01-02T03:04:05Z", " 2020-01-02T03:04:05+02:00 ", "2020-01-02 03:04", "2020-01-02",
        "2020-02-30T00:00:00Z", "2020-01-02T25:00:00Z", "", "yesterday", "2020-01-02T03:04:05.123456-0530",
        "20200102T030405Z", "2020-01-02T03:04:05.1234567Z", "2020-1-2", "2020", "2020-01-02Z",
        "2020-01-02T03+01", "2020-01-02T03:04:05,5Z",
    ]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    instant, aware = instants.parse_iso(F.col("s"))
    out = rows(df.select("s", F.date_format(instant, "yyyy-MM-dd HH:mm:ss.SSSSSS"), aware))
    for raw, got, got_aware in out:
        value = raw.strip()
        try:
            parsed = datetime.fromisoformat(value[:-1] + "+00:00" if value.endswith("Z") else value)
        except ValueError:
            assert got is None, raw
            continue
        assert got_aware == (parsed.tzinfo is not None), raw
        utc = parsed.replace(tzinfo=UTC) if parsed.tzinfo is None else parsed.astimezone(UTC)
        assert got == utc.strftime("%Y-%m-%d %H:%M:%S.%f"), raw
    only_aware = rows(df.select(instants.parse_aware(F.col("s"))))
    assert only_aware[2][0] is None and only_aware[0][0] is not None


def test_issue_ids_sort_by_number_then_text(spark):
    issue_ids = ["10", "2", "b", "1", "007", "7", "a", "123456789012345678901234567890123456789012"]
    df = spark.createDataFrame([(i,) for i in issue_ids], "i string")
    got = [r[0] for r in df.orderBy(*ids.issue_sort_columns(F.col("i"))).collect()]
    key = lambda v: (0, int(v), v) if v.isdecimal() else (1, 0, v)
    assert got == sorted(issue_ids, key=key)


def test_duplicate_references(spark):
    cases = {
        "": None, "  ": None, None: None, " 42 ": "42", "https://x/show_bug.cgi?id=7": "7",
        "a?ID=5 b&bug_id=5": "5", "x?id=1 y?id=2": "", "see 42": "", "id=9": "",
    }
    df = spark.createDataFrame([(c,) for c in cases], "raw string")
    got = dict(rows(df.select("raw", ids.duplicate_reference(F.col("raw")))))
    assert got == cases


def test_hash_ranks_and_experiment_ids(spark):
    df = spark.createDataFrame([("P:1",), ("P:2",)], "k string")
    for key, rank, exp in rows(
        df.select("k", ids.hash_rank("9", F.col("k")), ids.experiment_id(F.lit("A"), F.col("k")))
    ):
        digest = hashlib.sha256(f"9|{key}".encode()).digest()[:8]
        assert int(rank, 16) == int.from_bytes(digest)
        assert exp == ids.experiment_key("A", key) == hashlib.sha256(f"A|{key}".encode()).hexdigest()[:20]
    record = {"b": 1, "a": None, "c": "x"}
    one = spark.range(1).select(
        ids.provenance_digest(
            F.struct(F.lit(None).cast("string").alias("a"), F.lit(1).alias("b"), F.lit("x").alias("c"))
        )
    )
    assert one.first()[0] == ids.provenance_key(record)


def test_token_windows(spark):
    df = spark.createDataFrame([(n,) for n in (0, 20, 382, 383, 1000)], "n int").withColumn(
        "t", F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
    )
    out = df.select("n", windows.chunk_count(F.col("n")).alias("k"), windows.chunk_windows(F.col("t")).alias("w")).collect()
    assert {r["n"]: r["k"] for r in out} == {0: 1, 20: 1, 382: 1, 383: 2, 1000: 3}
    by = {r["n"]: r["w"] for r in out}
    assert [len(w) for w in by[383]] == [382, 65]
    assert [w[0] for w in by[1000]] == [1, 319, 637] and by[1000][-1][-1] == 1000
    assert by[1000][0][-64:] == by[1000][1][:64]
    buckets = rows(spark.createDataFrame([(5,), (6,)], "k long").select(windows.chunk_bucket(F.col("k"))))
    assert buckets == [("5",), (">5",)]


def test_scores(spark):
    one = spark.range(1)
    assert one.select(scores.percentage(F.lit(1), F.lit(3)), scores.percentage(F.lit(1), F.lit(0))).first() == (
        33.33333333, 0.0)
    a, b = F.array(F.lit(0.5), F.lit(0.7), F.lit(0.6)), F.array(F.lit(0.4), F.lit(0.8), F.lit(0.5))
    row = one.select(scores.join_fold_deltas(a, b), scores.fold_wins(a, b)).first()
    assert row == ("0.1000000000|-0.1000000000|0.1000000000", 2)
    assert one.select(scores.precision_guard(F.lit(0.29)), scores.precision_guard(F.lit(0.30))).first() == ("FAIL", "PASS")
    tie = F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))
    assert one.select(scores.argmax_label(tie, ("A", "B", "C"))).first()[0] == "A"
    unit = one.select(scores.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))).first()[0]
    assert unit == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="vector norm"):
        one.select(scores.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))).collect()
