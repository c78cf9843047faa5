"""Content signals of the named queries against their SQL, on texts where readings of a pattern differ."""

from __future__ import annotations

import duckdb
import pytest

from tracefold.queries import load

QUERIES, ORACLES = load()

TEXTS = [
    None, "", " \t", "one line", "class \u00e9t\u00e9", "cla\u017fs x", "class \u017f", "pr\u0131vate x", "pr\u0130vate x",
    "class\x0bx", "class\u00a0x", "\u00e9class x", "public  Foo", "Exception\u00e9", "Exceptions", "exception: x", "an exception",
    "at com.x.Y(File.java:12)", "at \u212a.x(y:1)", "at\u00a0a(b:1)", "\u00e9at a(b:1)", "Tracebac\u212a (most recent call last)",
    "```", "<b>", "<\u212a>", "<\u0131>", "a < b", "</P\n>", "http\u017f://x", "HTTPS://x", "WWW.x", "\u00e9@\u00e9.\u00e9", "a@b.\u00e9",
    "a@b.c", "a@\u00a0b.c", "a@b\x0b.c", "me@host.org.", "x\nat b(c:1)\nme@host.org", "\x0b", "\u00a0",
]


@pytest.mark.parametrize("name, table", [("audit_content_signals", "documents"), ("page_content_signals", "pages")])
def test_signals_match_sql(spark, tmp_path, name, table):
    # Ids are set so that every planted fault, all of them together included, meets these texts.
    shared = 31 * 29 * 11 * 19
    ids = [k * len(TEXTS) + i for k in range(3) for i in range(len(TEXTS))] + [shared - 1, 41 * shared - 1]
    texts = (TEXTS * 3 + ["one line", "two\nlines"])[: len(ids)]
    if table == "documents":
        rows = [(d, t, ("en", "fr")[d % 2], t if d % 3 == 0 else f"src{d % 4}" if d % 4 else " ", 0) for d, t in zip(ids, texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    else:
        rows = [(d, None if d % 7 == 0 else f"http://{t}" if d % 3 else t, t) for d, t in zip(ids, texts)]
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    db = duckdb.connect()
    db.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    expected = {r[columns.index("project")]: dict(zip(columns, r)) for r in cursor.fetchall()}
    got = {r["project"]: r.asDict() for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == expected
