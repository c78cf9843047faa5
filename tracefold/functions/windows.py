"""Overlapping token windows of long documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracefold.protocol import CHUNK_LENGTH, CHUNK_STEP


def chunk_count(n: Column, length: int = CHUNK_LENGTH, step: int = CHUNK_STEP) -> Column:
    return F.when(n <= length, F.lit(1)).otherwise(1 + F.ceil((n - length) / step)).cast("long")


def chunk_windows(tokens: Column, length: int = CHUNK_LENGTH, step: int = CHUNK_STEP) -> Column:
    last = chunk_count(F.size(tokens), length, step) - 1
    return F.transform(
        F.sequence(F.lit(0).cast("long"), last),
        lambda i: F.slice(tokens, (i * step + 1).cast("int"), length),
    )


def chunk_bucket(count: Column) -> Column:
    return F.when(count <= 5, count.cast("string")).otherwise(">5")


def word_tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def blank_split_tokens(text: Column) -> Column:
    """Tokens between runs of white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")
