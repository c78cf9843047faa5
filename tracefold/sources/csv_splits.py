"""Records of quoted CSV files, read in byte splits.

A line break inside a quoted field does not end a record, so a split cannot tell by itself where
its first record starts.  What a line does is a function of the state it starts in (between records
or inside quotes) to the state it ends in.  These functions compose:

1. every split computes the function and the number of records and lines of all of its lines, for both
   states at its start;
2. the table of splits (one row each) gives the state, the record number and the line number at
   the start of every split;
3. every split cuts its records.  A record that runs over the end of a split leaves fragments,
   which are joined by (file, record number).

Only fragments are shuffled.  Lines are parsed by the standard CSV reader, so quoting, blank lines and
line breaks (CR, LF, CRLF) mean what they mean there.

A strict reader refuses some records; they are kept and marked in ``problem``: INVALID_UTF8 (bytes
that are not UTF-8 are replaced), STRAY_QUOTE (text after a closing quote), UNTERMINATED_QUOTE
(the file ends inside quotes).  An empty file gives no row.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracefold.protocol import IntegrityError

OUT, IN = 0, 1
#: One row per split of 128 MB is held by every task; more splits than this are refused.
MAX_SPLITS = 1 << 20
SCHEMA = "path string, record_number long, ending_line long, fields array<string>, problem string"

_BOM = b"\xef\xbb\xbf"
_LONE_RETURN = re.compile(rb"(?<=\r)(?!\n)")
_SPLIT = "path string, block long, lines long, out_state int, out_records long, in_state int, in_records long"
_SPLIT_ROW = pa.schema([
    ("path", pa.string()), ("block", pa.int64()), ("lines", pa.int64()), ("out_state", pa.int32()),
    ("out_records", pa.int64()), ("in_state", pa.int32()), ("in_records", pa.int64()),
])
_CUT = f"{SCHEMA}, block long, fragment binary"
_ROW = pa.schema([
    ("path", pa.string()), ("record_number", pa.int64()), ("ending_line", pa.int64()),
    ("fields", pa.list_(pa.string())), ("problem", pa.string()),
])
_CUT_ROW = pa.schema([*_ROW, ("block", pa.int64()), ("fragment", pa.binary())])


def _physical_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, block, value): lines cut at LF, in file order inside a task."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _by_split(batches) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """((path, block), its physical lines with their ends) in order."""

    def rows():
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(3))
            for path, block, value in zip(*columns, strict=True):
                yield (path, block), value

    def lines(key, group):
        for i, (_, value) in enumerate(group):
            if not i and key[1] == 0:
                value = value.removeprefix(_BOM)
            yield from (x for x in _LONE_RETURN.split(value + b"\n") if x)

    for key, group in groupby(rows(), key=lambda r: r[0]):
        yield key, lines(key, group)


def _state_after(line: bytes, state: int, delimiter: str) -> int:
    """State at the end of a line.  The reader asks for another line only inside quotes."""
    if b'"' not in line:
        return state
    text = line.decode("utf-8", "replace")
    fed = iter([('"' + text) if state == IN else text, ""])
    next(csv.reader(fed, delimiter=delimiter))
    return IN if next(fed, None) is None else OUT


def _summaries(delimiter: str):
    def run(batches):
        csv.field_size_limit(1 << 30)
        for (path, block), lines in _by_split(batches):
            n, states, records = 0, [OUT, IN], [0, 0]
            for line in lines:
                n += 1
                for i in (OUT, IN):
                    records[i] += states[i] == OUT
                after = {s: _state_after(line, s, delimiter) for s in set(states)}
                states = [after[s] for s in states]
            yield pa.RecordBatch.from_pylist([{
                "path": path, "block": block, "lines": n, "out_state": states[OUT], "out_records": records[OUT],
                "in_state": states[IN], "in_records": records[IN],
            }], _SPLIT_ROW)

    return run


def split_starts(splits: DataFrame) -> DataFrame:
    """(path, block, state, records, lines): what holds at the start of each split.

    A split whose two end states are equal fixes the state; the ones between keep or flip it.
    """
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("out_state") == F.col("in_state")
    flip = F.when(~fixed & (F.col("out_state") == IN), 1).otherwise(0)
    flips = F.sum("flip").over(before)
    counted = splits.withColumn("flip", flip).withColumn("flips", F.coalesce(flips, F.lit(0)) + F.col("flip"))
    last = F.last(F.when(fixed, F.struct("out_state", "flips")), ignorenulls=True).over(before)
    known = counted.withColumn("last", last).withColumn("now", F.coalesce(flips, F.lit(0)))
    state = F.when(F.col("last").isNull(), F.col("now") % 2).otherwise(
        (F.col("last.out_state") + F.col("now") - F.col("last.flips")) % 2
    ).cast("int")
    own = F.when(F.col("state") == OUT, F.col("out_records")).otherwise(F.col("in_records"))
    return known.withColumn("state", state).withColumn("own", own).select(
        "path", "block", "state", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("records"),
        F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines"),
    )


def parse_record(data: bytes, delimiter: str) -> tuple[list[str], str | None]:
    """Fields of one record and what a strict reader would refuse."""
    problem = None
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text, problem = data.decode("utf-8", "replace"), "INVALID_UTF8"
    try:
        return next(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True), []), problem
    except csv.Error as error:
        fields = next(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), [])
        found = "UNTERMINATED_QUOTE" if "unexpected end" in str(error) else "STRAY_QUOTE"
        return fields, problem or found


def _cut(starts: dict, delimiter: str):
    def row(path, number, line, block, data: bytes, whole: bool) -> dict:
        fields, problem = parse_record(data, delimiter) if whole else (None, None)
        return {"path": path, "record_number": number, "ending_line": line, "fields": fields, "problem": problem,
                "block": block, "fragment": None if whole else data}

    def records(path, block, lines):
        if (path, block) not in starts:
            raise IntegrityError(f"{path}: the splits changed between two scans; set spark.sql.files.minPartitionNum")
        state, number, line = starts[path, block]
        number -= 1  # the record that is open or was the last; the first of a file is 0, its header
        whole, held = state == OUT, []
        for data in lines:
            if state == OUT:
                number, whole, held = number + 1, True, []
            held.append(data)
            line += 1
            state = _state_after(data, state, delimiter)
            if state == OUT:
                yield row(path, number, line, block, b"".join(held), whole)
                whole, held = True, []
        if held:
            yield row(path, number, line, block, b"".join(held), False)

    def run(batches):
        csv.field_size_limit(1 << 30)
        rows, size = [], 0
        for (path, block), lines in _by_split(batches):
            for r in records(path, block, lines):
                rows.append(r)
                size += 256 + sum(map(len, r["fields"] or ())) + len(r["fragment"] or b"")
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _CUT_ROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _CUT_ROW)

    return run


def _joined(delimiter: str):
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                data = b"".join(x["fragment"] for x in r["fragments"])
                fields, problem = parse_record(data, delimiter)
                rows.append({"path": r["path"], "record_number": r["record_number"], "ending_line": r["ending_line"],
                             "fields": fields, "problem": problem})
            yield pa.RecordBatch.from_pylist(rows, _ROW)

    return run


def csv_records(spark: SparkSession, path: str | list[str], delimiter: str) -> DataFrame:
    """path, record_number (0: header), ending_line, fields, problem of every record."""
    lines = _physical_lines(spark, path)
    splits = split_starts(lines.mapInArrow(_summaries(delimiter), _SPLIT)).limit(MAX_SPLITS + 1).collect()
    if len(splits) > MAX_SPLITS:
        raise IntegrityError(f"{path}: more than {MAX_SPLITS} splits; raise spark.sql.files.maxPartitionBytes")
    starts = {(r["path"], r["block"]): (r["state"], r["records"], r["lines"]) for r in splits}
    cut = lines.mapInArrow(_cut(starts, delimiter), _CUT)
    fragments = cut.filter("fragment is not null").groupBy("path", "record_number").agg(
        F.max("ending_line").alias("ending_line"),
        F.array_sort(F.collect_list(F.struct("block", "fragment"))).alias("fragments"),
    )
    whole = cut.filter("fragment is null").select("path", "record_number", "ending_line", "fields", "problem")
    return whole.unionByName(fragments.mapInArrow(_joined(delimiter), SCHEMA))
