"""Split CSV reading against the standard reader, with splits of a few bytes."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tracefold.plans import stored_audit as A
from tracefold.protocol import IntegrityError
from tracefold.sources import raw_csv as R
from tracefold.sources.csv_splits import IN, OUT, csv_records, split_starts


@pytest.fixture
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def plain(data: bytes):
    """(number, ending line, fields) of every record."""
    reader = csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""))
    return [(i, reader.line_num, row) for i, row in enumerate(reader)]


def content(seed: int) -> bytes:
    r = random.Random(seed)
    fields = ["", "a", "é", '"quoted"', '"two\nlines"', '"crlf\r\nx"', '"lone\rreturn"', '"a ""b"" c"', '"x, y"', 'it"s', '"\n\n\n"', "z" * 40,
              '"' + "long\n" * 60 + '"']
    lines = [",".join(r.choice(fields) for _ in range(r.randrange(1, 6))) for _ in range(120)] + ["", "", "a,b"]
    return "".join(x + r.choice(["\n", "\r\n", "\r", "\n"]) for x in ["h1,h2", *lines]).encode()


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_records_equal_the_standard_reader(spark, tmp_path, tiny_splits, seed):
    data = (b"\xef\xbb\xbf" if seed % 2 else b"") + content(seed)
    data = data if seed < 4 else data.rstrip(b"\r\n")
    path = tmp_path / "x.csv"
    path.write_bytes(data)
    df = csv_records(spark, str(path), ",")
    assert spark.read.text(str(path), lineSep="\n").rdd.getNumPartitions() > 10
    got = sorted((r.record_number, r.ending_line, list(r.fields)) for r in df.collect())
    assert got == plain(data)
    assert df.filter("problem is not null").count() == 0


def test_problems_are_reported_with_their_record(spark, tmp_path, tiny_splits):
    good = [f'{i},"line\none {i}"' for i in range(30)]
    bad = [*good[:10], '10,"stray" quote', *good[11:20], "20,bad \udcff byte", *good[21:], '30,"open', "to the end"]
    path = tmp_path / "bad.csv"
    path.write_bytes(("ID,text\n" + "\n".join(bad) + "\n").encode("utf-8", "surrogateescape"))
    records = R.scan_raw_csv(spark, "P", str(path))
    found = {(r.record_number, r.problem) for r in R.csv_problems(records).collect()}
    assert found == {(11, "STRAY_QUOTE"), (21, "INVALID_UTF8"), (31, "UNTERMINATED_QUOTE")}
    assert records.count() == 31 and records.filter("record_number = 21").first()["ID"] == "20"
    with pytest.raises(IntegrityError, match="INVALID_UTF8"):
        R.read_raw_csv(spark, "P", str(path))


def test_split_states_compose(spark):
    r = random.Random(3)
    rows, want = [], {}
    for path in "ab":
        state = records = lines = 0
        for block in range(0, 4000, 100):
            ends = r.choice([(OUT, IN), (IN, OUT), (OUT, OUT), (IN, IN), (OUT, IN)])
            row = (path, block, r.randrange(9), ends[0], r.randrange(5), ends[1], r.randrange(5))
            rows.append(row)
            want[path, block] = (state, records, lines)
            records += row[4] if state == OUT else row[6]
            lines += row[2]
            state = ends[state]
    splits = spark.createDataFrame(rows, "path string, block long, lines long, out_state int, out_records long, in_state int, in_records long")
    got = {(x.path, x.block): (x.state, x.records, x.lines) for x in split_starts(splits.repartition(7)).collect()}
    assert got == want


def test_empty_file_and_several_projects(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text('ID,t\n1,"x\ny"\n2,z\n')
    (tmp_path / "sub" / "b.csv").write_text("ID,t\n7,q\n")
    (tmp_path / "empty.csv").write_text("")
    got = {(r.source_project, r.record_number, r.ID, r.ending_line) for r in
           R.read_catalogue(spark, str(tmp_path), {"A": "a.csv", "B": "sub/b.csv"}).collect()}
    assert got == {("A", 1, "1", 3), ("A", 2, "2", 4), ("B", 1, "7", 2)}
    assert csv_records(spark, str(tmp_path / "empty.csv"), ",").count() == 0
    (tmp_path / "c.csv").write_text("ID,other\n7,q\n")
    with pytest.raises(R.SchemaError, match="headers differ"):
        R.read_catalogue(spark, str(tmp_path), {"A": "a.csv", "C": "c.csv"})


def test_stored_audit_reads_changed_sources_only(spark, tmp_path):
    asked = []
    facts = spark.createDataFrame(
        [("P", p, s, n, m) for p, s, n, m in [("x", "major", 3, False), ("x", "", 5, True), ("y", "minor", 1, False)]],
        "source_project string, path string, severity string, description_length long, summary_missing boolean",
    ).withColumns({"severity_blank": F.col("severity") == "", "summary_length": F.lit(0)})

    def read(pending):
        asked.append({r.path for r in pending.collect()})
        return facts.join(pending.select("path"), "path", "left_semi")

    def sources(*rows):
        return spark.createDataFrame([("P", *r) for r in rows], "project string, path string, size_bytes long")

    store = A.StoredAudit(spark, str(tmp_path / "audit"))
    assert A.summary(store.run(sources(("x", 10)), read)).first()["rows"] == 2
    both = store.run(sources(("x", 10), ("y", 4), ("void", 0)), read)
    row = A.summary(both).first()
    assert (row["rows"], row["summary_missing"], row["severity_blank"]) == (3, 1, 1)
    assert {(r.severity_raw, r.n) for r in A.labels(both).collect()} == {("major", 1), ("minor", 1)}
    assert A.lengths(both).filter("field = 'description'").first()["median"] == 3
    store.run(sources(("x", 10), ("y", 4), ("void", 0)), read)
    store.run(sources(("x", 11), ("y", 4)), read)  # another size is another source
    assert asked == [{"x"}, {"y", "void"}, {"x"}]
