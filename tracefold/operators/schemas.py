"""Reports over discovered schemas: (project, position, column) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracefold.functions.text import casefold
from tracefold.protocol import DELIMITERS, RELATION_TERMS

# A delimiter outside quotes cannot be told by a count alone, so quoted runs go first.
_QUOTED = r'"[^"]*"'


def header_delimiter(line: Column) -> Column:
    """Candidate that occurs most often in the header; the first listed wins a tie."""
    bare = F.regexp_replace(line, _QUOTED, "")
    counts = [F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))) for d in DELIMITERS]
    most = F.greatest(*counts)
    chosen = F.lit(None).cast("string")
    for delimiter, count in reversed(list(zip(DELIMITERS, counts))):
        chosen = F.when((count == most) & (count > 0), F.lit(delimiter)).otherwise(chosen)
    return chosen


def header_columns(line: Column, delimiter: Column) -> Column:
    """Header fields; delimiters inside quotes stay part of the name."""

    def unquote(field: Column) -> Column:
        quoted = field.startswith('"') & field.endswith('"') & (F.length(field) >= 2)
        inner = F.substring(field, F.lit(2), F.length(field) - 2)
        return F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(field)

    fields = F.array(line)
    for d in DELIMITERS:
        mark = rf"\x{ord(d):02x}"
        one = rf'{mark}("[^"]*(?:""[^"]*)*"|[^{mark}]*)'
        found = F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(one), F.lit(1))
        fields = F.when(delimiter == d, found).otherwise(fields)
    return F.transform(fields, unquote)


def column_presence(columns: DataFrame) -> DataFrame:
    """How many projects hold a column, and the project when it is the only one."""
    projects = columns.select("project").distinct().agg(F.count(F.lit(1)).alias("project_total"))
    per_column = (
        columns.select("project", "column")
        .distinct()
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("project_count"), F.min("project").alias("only"))
    )
    total = F.lit(projects.first()["project_total"])
    return per_column.select(
        "column",
        "project_count",
        (F.col("project_count") == total).alias("in_every_project"),
        F.when(F.col("project_count") == 1, F.col("only")).alias("unique_to_project"),
    )


def _absent(columns: DataFrame) -> DataFrame:
    """(column, absent): per column that not every project holds, the projects without it.

    Built by one grouped comparison.  The list of projects is as long as the catalogue.
    """
    present = columns.select("project", "column").distinct()
    everyone = [r["project"] for r in present.select("project").distinct().orderBy("project").collect()]
    holders = present.groupBy("column").agg(F.collect_set("project").alias("holders")).filter(
        F.size("holders") < len(everyone)
    )
    listed = F.array(*[F.lit(p) for p in everyone]) if everyone else F.array().cast("array<string>")
    return holders.select("column", F.array_except(listed, F.col("holders")).alias("absent"))


def missing_projects(columns: DataFrame) -> DataFrame:
    """column, missing_projects: one row per column that some project lacks."""
    return _absent(columns).select("column", F.array_join(F.array_sort("absent"), "|").alias("missing_projects"))


def missing_from_union(columns: DataFrame) -> DataFrame:
    """(project, column) pairs of the union of columns that a project lacks."""
    return _absent(columns).select(F.explode("absent").alias("project"), "column")


def project_schemas(columns: DataFrame) -> DataFrame:
    """project, column, position, present: the column's place in every project, null where it is absent."""
    held = columns.groupBy("project", "column").agg(F.min("position").alias("position"))
    found = held.select("project", "column", "position", F.lit(True).alias("present"))
    return found.unionByName(missing_from_union(columns).select(
        "project", "column", F.lit(None).cast(columns.schema["position"].dataType).alias("position"), F.lit(False).alias("present")
    ))


def duplicate_columns(columns: DataFrame) -> DataFrame:
    return (
        columns.groupBy("project", "column")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter("occurrences > 1")
    )


def capitalization_differences(columns: DataFrame) -> DataFrame:
    """Column names that are equal after case folding."""
    return (
        columns.select("column")
        .distinct()
        .groupBy(casefold(F.col("column")).alias("folded"))
        .agg(
            F.array_join(F.array_sort(F.collect_set("column")), "|").alias("spellings"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter("n > 1")
        .drop("n")
    )


def relation_fields(columns: DataFrame) -> DataFrame:
    """Columns whose name suggests a link between issues."""
    hit = F.lit(False)
    for term in RELATION_TERMS:
        hit = hit | casefold(F.col("column")).contains(term)
    return columns.select("column").distinct().filter(hit)


def contract_violations(columns: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """Positions where a project's header differs from the expected column order.

    ``position`` is 1-based; a header that is too short or too long is reported at the
    positions concerned.
    """
    spark = columns.sparkSession
    wanted = spark.createDataFrame(
        [(i + 1, name) for i, name in enumerate(expected)], "position int, expected string"
    )
    projects = columns.select("project").distinct()
    positions = F.explode(F.sequence(F.lit(1), F.lit(len(expected)))).alias("position")
    spine = projects.select("project", positions).join(wanted, "position")
    both = spine.join(columns, ["project", "position"], "full_outer")
    return both.filter(~F.col("column").eqNullSafe(F.col("expected"))).select(
        "project", "position", "expected", "column"
    )
