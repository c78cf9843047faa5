"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tracefold.queries import load

DATA = Path("/root/testdata/sf0.001")
QUERIES, ORACLES = load()
TABLES = ("customer", "orders", "events", "documents", "embeddings", "pages", "labels", "conversations", "benchmark")
CHOSEN = (
    "split_class_distribution", "chronological_positions", "eligible_text_rows", "purge_reasons",
    "fold_class_counts", "audit_label_histogram", "audit_duplicate_groups", "header_discovery",
    "lexical_leaderboard", "ranking_areas", "stratified_sample", "token_windows", "char_tfidf_validation",
    "vector_shard_check_failures", "streamed_event_audit", "csv_round_trip", "csv_malformed_records", "audit_resume",
    "schema_missing_columns",
)

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="tables not present")


def plain(value):
    assert not isinstance(value, Decimal)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.7g}"
    return f"{type(value).__name__}:{value}"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, str(DATA))
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    expected = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == expected


def test_every_query_with_sql_is_registered():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) >= 110
