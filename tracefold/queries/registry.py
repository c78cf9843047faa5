"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Instants are written and compared as UTC text.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def ts(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Round every double, so that the order of additions cannot show."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name)
            if f.dataType.typeName() == "double" else F.col(f.name)
            for f in df.schema.fields
        ]
    )
