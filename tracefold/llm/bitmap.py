"""Fixed-size bitmap of ids, to thin out texts before an exact join.

The size is fixed and does not follow the data; a fuller bitmap lets more rows pass to the
join behind it, which decides.  Bits are combined by Spark (``bit_or`` per word), so the
driver receives at most ``BITS / 64`` numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

LOG = 23
BITS = 1 << LOG


def slot_of_id(column: str) -> Column:
    """Bit number of an id."""
    return F.shiftrightunsigned(F.xxhash64(column), 64 - LOG)


def slot_of_hash(column: str) -> Column:
    """Bit number of a value that is a hash already: its top bits."""
    return F.shiftrightunsigned(column, 64 - LOG)


def build(ids: DataFrame, slot: Column) -> np.ndarray:
    """The bitmap, as 64-bit words, of the slots of all rows."""
    words = (
        ids.select(slot.alias("slot"))
        .groupBy("slot").agg(F.lit(1).alias("one"))
        .select(F.shiftright("slot", 6).alias("word"), F.col("slot").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
    )
    table = np.zeros(BITS // 64, np.int64)
    rows = words.collect()
    if rows:
        table[[r["word"] for r in rows]] = [r["mask"] for r in rows]
    return table


def hits(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((table[slots >> 6] >> (slots & 63)) & 1).astype(bool)
