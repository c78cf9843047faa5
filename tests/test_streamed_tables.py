"""Streamed audits of tables that are one file, a folder of files, or without files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracefold.queries import load


@pytest.mark.parametrize("files", [1, 3])
def test_streamed_audits_read_files_and_folders(spark, tmp_path, files):
    source = "/root/testdata/sf0.001"
    for name in ("pages", "events"):
        table = spark.read.parquet(f"{source}/{name}.parquet")
        if files > 1:
            table.repartition(files).write.parquet(f"{tmp_path}/{name}.parquet")
        else:
            table.toPandas().to_parquet(
                f"{tmp_path}/{name}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True
            )
    queries, _ = load()
    pages = queries["streamed_page_audit"](spark, str(tmp_path)).collect()
    assert sum(r["rows"] for r in pages) == spark.read.parquet(f"{source}/pages.parquet").count()
    events = queries["streamed_event_audit"](spark, str(tmp_path)).collect()
    wanted = spark.read.parquet(f"{source}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n")).collect()
    assert {r["source_project"]: r["rows"] for r in events} == {r["event_type"]: r["n"] for r in wanted}


def test_a_stream_without_rows_has_empty_totals(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").schema
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/pages.parquet")
    assert load()[0]["streamed_page_audit"](spark, str(tmp_path)).collect() == []
