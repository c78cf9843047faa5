"""Cases that once went wrong: equal line hashes, odd pages, clashing columns, media columns."""

from __future__ import annotations

import hashlib
import zlib

from tracefold.llm.html_text import parse, render
from tracefold.llm.lines import dedup_lines
from tracefold.llm.media import media_columns


def text(source):
    return render(parse(source))


def test_lines_are_told_by_more_than_a_polynomial(spark):
    morse = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    got = {r.doc_id: r.lines_removed for r in dedup_lines(spark.createDataFrame([(1, morse), (2, other), (3, morse)], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_lines_with_clashing_columns_and_many_removals(spark):
    many = "\n".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(20_000))
    rows = [(1, many, "a", "b", "c", "d"), (2, f"own words stay here\n{many}\nand here as well", "a", "b", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _removed string, _doc string, _key0 string, _lines0 string")
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert got[2].text == "own words stay here\nand here as well"
    assert (got[2].lines_removed, got[1].lines_removed) == (20_000, 0)
    assert (got[2]._removed, got[2]._doc, got[2]._key0, got[2]._lines0) == ("a", "b", "c", "d") and got[1].text == many


def test_pages():
    assert text("<a title=it's>Hello</a> shown text <b>it's</b>") == "Hello shown text it's"
    assert text("<head><title>t</title>shown <b>x</b>") == "shown x"
    assert text("<head><meta charset=x><p>shown</head>") == "shown"
    assert text("<select><option>a<option>b</select>") == "a\nb"
    assert "label" in text("<svg><text>label</text></svg>") and "x+1" in text("<math>x+1</math>")
    assert text("<table><tr><td colspan=" + "9" * 5000 + ">a<td>b</table>").split() == ["a", "b"]
    assert text("<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>") == "a     b\nc  d  e"
    cell = text("<table><tr><td><p>one<p>two<ul><li>x</ul><td>side</table>").split("\n")
    assert cell[0].split() == ["one", "side"] and [x for x in cell if x] == [cell[0], "two", "- x"]
    wide = "".join(f"<tr><td>{'w' * 5000 if i == 0 else 'c'}<td>d" for i in range(500))
    assert len(text(f"<table>{wide}</table>")) < 10_000
    assert text('<a href="x>y">ok</a><br>< not a tag') == "ok\n< not a tag"


def test_media_columns(spark):
    texts = [None, "", "a" * 576, "é" * 400, "same", "same", "x" * 5000]
    docs = spark.createDataFrame([(i, t, "k", 3) for i, t in enumerate(texts)], "doc_id long, text string, digest string, width int")
    df = media_columns(docs)
    assert df.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    got = {r.doc_id: r for r in df.collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        row = got[i]
        assert (row.n_bytes, row.payload_bytes) == (len(data), len(payload))
        assert row.payload_sha256 == row.digest == hashlib.sha256(payload).hexdigest()
        assert row.tail_crc32 == zlib.crc32(payload[-32:]) and row.shard and row.shard_length == row.media_bytes
    assert got[4][2:] == got[5][2:] and got[0][2:] == got[1][2:]
