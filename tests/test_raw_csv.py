from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracefold.operators import audit as A, eligibility as E, schemas as C
from tracefold.plans.prepare import prepare
from tracefold.plans.quality import audit_tables, write_audit
from tracefold.protocol import AUDIT_REQUIRED, PREPARE_REQUIRED, RAW_COLUMNS, SEVERITY, IntegrityError
from tracefold.sources import catalogue as K, raw_csv as R

COLUMNS = ["ID", "Severity", "Summary", "Description", "Creation time", "Dupe of", "Depends on"]


def write(path, lines, bom=False, newline="\r\n"):
    data = newline.join(lines) + newline
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + data.encode())
    return str(path)


def raw42(**values):
    return ",".join('"' + values.get(c, "").replace('"', '""') + '"' for c in RAW_COLUMNS)


def test_header_discovery(spark, tmp_path):
    header = R.discover_header(spark, write(tmp_path / "a.csv", ["ID;Summary;Summary", "1;2;3"], bom=True))
    assert (header.delimiter, header.columns) == (";", ("ID", "Summary", "Summary"))
    assert header.has_bom and header.duplicates == ("Summary",)
    quoted = R.discover_header(spark, write(tmp_path / "q.csv", ['ID,"a ""b"", c",d', "1,2,3"]))
    assert quoted.columns == ("ID", 'a "b", c', "d")
    bad = tmp_path / "bad.csv"
    bad.write_bytes(b"ID,Sum\xffmary\n1,2\n")
    with pytest.raises(R.SchemaError, match="UTF-8"):
        R.discover_header(spark, str(bad))
    assert R.invalid_utf8_files(spark, [str(bad)]).count() == 1
    with pytest.raises(R.SchemaError, match="delimiter"):
        R.discover_header(spark, write(tmp_path / "n.csv", ["single", "1"]))
    with pytest.raises(R.SchemaError, match="Description"):
        R.required_width(R.CsvHeader(("ID", "Severity"), ",", False, ()), AUDIT_REQUIRED)
    with pytest.raises(R.SchemaError):
        R.require_contract(header, RAW_COLUMNS)


def test_audit_of_the_four_row_file(spark, tmp_path):
    path = write(
        tmp_path / "p.csv",
        [
            ",".join(COLUMNS),
            '1,normal,"Same","two\r\nlines <b>x</b> http://a.b me@h.org",2020-01-01T00:00:00Z,,',
            '1,critical,"Same","two\nlines <b>x</b> http://a.b me@h.org",2020-01-02 00:00:00,,',
            '3,enhancement," ","",not-a-time,,',
            "4,odd-label,Title,Body,,,",
        ],
        newline="\n",
    )
    records = R.read_raw_csv(spark, "ALPHA", path)
    width = R.required_width(R.discover_header(spark, path), AUDIT_REQUIRED)
    counters = R.record_counters(records, width).first()
    assert (counters["raw_rows"], counters["field_audited_rows"], counters["malformed_rows"]) == (4, 4, 0)
    issues = R.as_issue_rows(R.audit_records(records, width))
    tables = audit_tables(issues, SEVERITY)
    gaps = tables["text_missing_audit"].first()
    assert (gaps["summary_blank"], gaps["description_missing"], gaps["both_unavailable"]) == (1, 1, 1)
    time = tables["temporal_coverage"].first()
    assert (time["parse_success_count"], time["parse_failure_count"], time["null_timestamp_count"]) == (2, 1, 1)
    assert (time["timezone_aware_count"], time["timezone_naive_count"]) == (1, 1)
    ids = tables["identifier_audit"].first()
    assert (ids["non_null_issue_ids"], ids["unique_issue_ids"], ids["duplicate_issue_id_rows"]) == (4, 3, 2)
    within = tables["duplicate_summary"].filter("scope = 'within_project'").first()
    assert (within["duplicate_groups"], within["rows_in_duplicate_groups"]) == (1, 2)
    signals = tables["text_content_signals"].first()
    assert (signals["has_html_rows"], signals["has_url_rows"], signals["has_email_rows"]) == (2, 2, 2)
    assert [r["severity_raw"] for r in tables["unexpected_severity_labels"].collect()] == ["odd-label"]
    group = tables["duplicate_groups"].first()
    assert (group["sample_issue_ids"], group["row_count"]) == ("1|1", 2)
    write_audit({"gaps": tables["text_missing_audit"]}, str(tmp_path / "reports"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "reports/gaps")).count() == 1


def test_ragged_records(spark, tmp_path):
    path = write(tmp_path / "r.csv", [",".join(COLUMNS), '1,normal,"x, y"', "2,normal,a,b,2020-01-01T00:00:00Z,,",
                                      '3,normal,"m\nn",b,2020-01-01T00:00:00Z,,,extra', "4,normal,a,b,c"], newline="\n")
    records = R.read_raw_csv(spark, "ALPHA", path)
    width = R.required_width(R.discover_header(spark, path), AUDIT_REQUIRED)
    samples = [tuple(r) for r in R.malformed_samples(records).orderBy("record_number").collect()]
    assert samples == [("ALPHA", 1, 2, 3, 7), ("ALPHA", 3, 5, 8, 7), ("ALPHA", 4, 6, 5, 7)]
    counters = R.record_counters(records, width).first()
    assert (counters["malformed_rows"], counters["field_audited_rows"]) == (3, 3)
    kept = R.audit_records(records, width).filter("record_number = 4").first()
    assert kept["Dupe of"] == "" and kept["Creation time"] == "c"
    with pytest.raises(IntegrityError, match="malformed"):
        R.prepare_records(records, width)


def test_preparation_of_raw_files(spark, tmp_path):
    base = {"Creation time": "2020-01-01T00:00:00Z"}
    lines = [
        ",".join(RAW_COLUMNS),
        raw42(ID="1", Severity="enhancement", Summary="s", **base),
        raw42(ID=" 2 ", Severity="major", Description="only description", **base),
        raw42(ID="3", Severity="minor", Summary="only\nsummary", **base),
        raw42(ID="4", Severity="normal", Summary=" ", **base),
    ]
    path = write(tmp_path / "a.csv", lines, bom=True)
    header = R.discover_header(spark, path)
    R.require_contract(header, RAW_COLUMNS)
    needed = R.required_width(header, PREPARE_REQUIRED)
    records = R.prepare_records(R.read_raw_csv(spark, "ALPHA", path, header), needed)
    statused = E.row_status(R.as_issue_rows(records), SEVERITY)
    population = E.population(statused).first()
    assert population["eligible_rows"] == 2
    assert (population["excluded_label_rows"], population["excluded_missing_text_rows"]) == (1, 1)
    eligible = {r["issue_id"]: r for r in E.eligible_rows(statused, SEVERITY).collect()}
    assert set(eligible) == {"2", "3"}
    assert eligible["2"]["target_s3"] == "HIGH" and eligible["3"]["target_s2"] == "LOWER_IMPACT"
    assert eligible["3"]["record_number"] == 3

    short = write(tmp_path / "short.csv", [",".join(RAW_COLUMNS), ",".join(["u", "9"] + [""] * 37)])
    rows = R.prepare_records(R.read_raw_csv(spark, "ALPHA", short), needed)
    assert rows.first()["observed_fields"] == 39

    unknown = write(tmp_path / "u.csv", [",".join(RAW_COLUMNS), raw42(ID="1", Severity="unknown", Summary="s", **base)])
    with pytest.raises(IntegrityError, match="unknown_label"):
        prepare(R.as_issue_rows(R.read_raw_csv(spark, "ALPHA", unknown)), SEVERITY)
    twice = write(tmp_path / "t.csv", [",".join(RAW_COLUMNS)] + [raw42(ID="1", Severity="major", Summary="s", **base)] * 2)
    with pytest.raises(IntegrityError, match="repeated"):
        prepare(R.as_issue_rows(R.read_raw_csv(spark, "ALPHA", twice)), SEVERITY)


def test_schema_reports(spark):
    listed = [("A", 1, "ID"), ("A", 2, "Summary"), ("B", 1, "ID"), ("B", 2, "summary"), ("B", 3, "Dupe of")]
    columns = spark.createDataFrame(listed, "project string, position int, column string")
    found = {r["column"]: r for r in C.column_presence(columns).collect()}
    assert found["ID"]["in_every_project"] and found["Dupe of"]["unique_to_project"] == "B"
    missing = {tuple(r) for r in C.missing_from_union(columns).collect()}
    assert missing == {("A", "summary"), ("A", "Dupe of"), ("B", "Summary")}
    assert C.capitalization_differences(columns).first()["spellings"] == "Summary|summary"
    assert [r[0] for r in C.relation_fields(columns).collect()] == ["Dupe of"]
    broken = {tuple(r) for r in C.contract_violations(columns, ("ID", "Summary")).collect()}
    assert broken == {("B", 2, "Summary", "summary"), ("B", 3, None, "Dupe of")}


def test_catalogue_and_files(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.csv").write_bytes(b"abcd")
    toml = tmp_path / "c.toml"
    toml.write_text('version = 1\n[projects]\nA = "a.csv"\nB = "sub/b.csv"\n')
    frame = K.load_catalogue(spark, str(toml), ["A", "B"])
    checks = {r["project"]: (r["exists"], r["size_bytes"]) for r in
              K.verify_files(spark, str(tmp_path / "data"), frame).collect()}
    assert checks == {"A": (True, 4), "B": (False, None)}
    bad = K.catalogue_frame(spark, {"A": "/a.csv", "C": "../c.csv", "D": "d.txt"})
    wanted = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "project string")
    rules = {tuple(r) for r in K.catalogue_violations(bad, wanted).collect()}
    assert rules == {("A", "unsafe_path"), ("C", "unsafe_path"), ("D", "not_csv"), ("B", "missing_project")}
    with pytest.raises(K.CatalogueError):
        K.load_catalogue(spark, str(toml), ["A"])
    sources = spark.createDataFrame([("A", "a.csv", 4), ("B", "b.csv", 5)], "project string, path string, size_bytes long")
    done = spark.createDataFrame([("A", "a.csv", 4), ("B", "b.csv", 6)], "project string, path string, size_bytes long")
    assert [r["project"] for r in K.pending_sources(sources, done).collect()] == ["B"]


def test_count_comparison(spark):
    observed = spark.createDataFrame([("A", 3), ("B", 4)], "project string, raw_rows long")
    expected = spark.createDataFrame([("A", 3), ("B", 5), ("C", 1)], "project string, expected_rows long")
    got = {r["project"]: r["comparison"] for r in A.compare_counts(observed, expected).collect()}
    assert got == {"A": "MATCH", "B": "MISMATCH", "C": "MISMATCH"}
    assert F is not None
