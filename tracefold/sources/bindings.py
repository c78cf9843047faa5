"""The star-schema tables read as issue corpora.

Structured issues come from orders and customers, text issues from documents; labels,
times and links are plain expressions over their columns, so every row of the tables
takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracefold.functions.ids import stable_id
from tracefold.operators.eligibility import eligible_rows, row_status, with_targets
from tracefold.protocol import PRIORITY, SEVERITY
from tracefold.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def structured_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as labelled, time-stamped rows: project = market segment."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.col("o_orderkey").cast("string").alias("issue_id"),
        F.col("o_orderdate").cast("timestamp").alias("creation_time"),
        F.col("o_orderpriority").alias("severity_raw"),
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("source_project")
    )
    return orders.join(customers, "o_custkey").drop("o_custkey")


def eligible_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structured_issues(spark, sf_dir).filter(~F.col("severity_raw").isin(*PRIORITY.excluded))
    return with_targets(rows, PRIORITY).withColumn(
        "stable_id", stable_id(F.col("source_project"), F.col("issue_id"))
    )


# Label by language and id, so that words carry signal; every 23rd row is excluded.
_SEVERITY = """
case when doc_id % 23 = 0 then 'enhancement'
     when lang = 'en' then element_at(array('normal', 'minor', 'trivial'), cast(doc_id % 3 as int) + 1)
     else element_at(array('blocker', 'critical', 'major'), cast(doc_id % 3 as int) + 1) end
"""

_DUPE_OF = """
case when doc_id % 65 = 0 then cast(doc_id + 1000000000 as string)
     when doc_id % 39 = 0 then concat('x?id=', doc_id - 17, ' y?id=', doc_id - 18)
     when doc_id % 26 = 0 then concat('https://tracker.example/show_bug.cgi?id=', doc_id - 17)
     when doc_id % 13 = 0 then concat(' ', doc_id - 17, ' ')
     else '' end
"""

_INSTANT = "timestamp '2020-01-01 00:00:00' + make_interval(0,0,0,0,cast((doc_id * 7919) % 100003 as int),0,0)"


def raw_text_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw text rows: summary = first line, description = the rest."""
    docs = documents_table(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return docs.select(
        F.col("source").alias("source_project"),
        (F.col("doc_id") + 1).alias("record_number"),
        F.col("doc_id").cast("string").alias("issue_id"),
        F.expr(_SEVERITY).alias("severity"),
        F.date_format(F.expr(_INSTANT), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("creation_time"),
        F.substring_index("text", "\n", 1).alias("summary"),
        F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("description"),
        F.expr(_DUPE_OF).alias("dupe_of"),
    )


def untidy_text_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with the faults an audit looks for, placed by document id."""
    rows = raw_text_issues(spark, sf_dir)
    n = F.col("record_number")
    return rows.withColumns(
        {
            "issue_id": F.when(n % 31 == 0, "").when(
                n % 20 == 1, (n - n % 40).cast("string")
            ).otherwise(F.col("issue_id")),
            "severity": F.when(n % 29 == 0, "  ").when(n % 37 == 0, "odd-label").otherwise(
                F.col("severity")
            ),
            "creation_time": F.when(n % 11 == 0, "")
            .when(n % 13 == 0, "2020-02-30T10:00:00Z")
            .when(n % 7 == 0, F.substring("creation_time", 1, 19))
            .when(n % 5 == 0, F.concat(F.substring("creation_time", 1, 19), F.lit("+05:30")))
            .otherwise(F.col("creation_time")),
            "summary": F.when(n % 19 == 0, " \t").otherwise(F.col("summary")),
            "description": F.when(n % 41 == 0, "").otherwise(F.col("description")),
        }
    ).drop("dupe_of")


def eligible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible_rows(row_status(raw_text_issues(spark, sf_dir), SEVERITY), SEVERITY)


def text_free(rows: DataFrame) -> DataFrame:
    """The narrow columns that splits and graphs read."""
    return rows.select(
        "stable_id", "source_project", "issue_id", "creation_time", "severity_raw",
        "target_s6", "target_s3", "target_s2", "dupe_of", "exact_text_hash",
    )


def pages_as_issues(pages: DataFrame) -> DataFrame:
    """Pages as raw rows: summary = address, description = markup."""
    return pages.select(
        F.regexp_extract("url", r"^([a-z]+)://", 1).alias("source_project"),
        (F.col("page_id") + 1).alias("record_number"),
        F.col("page_id").cast("string").alias("issue_id"),
        F.lit("normal").alias("severity"),
        F.lit("2020-01-01T00:00:00Z").alias("creation_time"),
        F.col("url").alias("summary"),
        F.col("html").alias("description"),
    )


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_as_issues(spread(table(spark, sf_dir, "pages"), "page_id"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as time-stamped rows: project = event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source_project"),
        F.col("event_id").cast("string").alias("issue_id"),
        F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("stable_id"),
        F.col("ts").cast("timestamp").alias("creation_time"),
        "value",
        "props",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings keyed like shards: project = label."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("source_project"),
        F.col("vec_id").cast("string").alias("issue_id"),
        F.concat(F.lit("L"), F.col("label").cast("string"), F.lit(":"), F.col("vec_id").cast("string")).alias("stable_id"),
        "vec_id",
        "label",
        "embedding",
    )
