"""Queries that write the tables as raw files and read them back, and audits that are resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracefold.operators.audit import row_facts
from tracefold.plans import stored_audit as A
from tracefold.queries.registry import query
from tracefold.session import scratch_path
from tracefold.sources import bindings as B, raw_csv as R


def _quoted(rows: DataFrame, path: str) -> None:
    """Strict CSV: every value quoted, blanks and line breaks kept."""
    (rows.write.option("header", "true").option("quoteAll", "true").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))


@query(
    "csv_round_trip",
    """
select doc_id, source, md5(coalesce(text, '')) as text_md5, coalesce(text, '') like '%' || chr(10) || '%' as several_lines from documents
""",
)
def csv_round_trip(spark, sf_dir):
    """Documents through quoted CSV files, whose fields hold line breaks and quotes."""
    path = scratch_path(spark, "csv")
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    _quoted(docs, path)
    records = R.read_raw_csv(spark, "documents", path)
    return records.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", F.md5("text").alias("text_md5"),
        F.col("text").contains("\n").alias("several_lines"),
    )


def _ragged(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, str]]:
    """A folder of files per source whose records are short or wide by rule."""
    root = scratch_path(spark, "ragged")
    docs = B.table(spark, sf_dir, "documents")
    extra = F.when(F.col("doc_id") % 10 == 3, F.lit(',"x, y",z')).otherwise(F.lit(""))
    line = F.when(F.col("doc_id") % 10 == 5, F.concat(F.col("doc_id").cast("string"), F.lit(',"a ""b"""'))).otherwise(
        F.concat_ws(",", "doc_id", "lang", F.col("n_chars").cast("string"), F.lit("end"))
    )
    # One column under another separator: the writer leaves commas and quotes alone.
    (docs.select(F.col("source").alias("project"), F.concat(line, extra).alias("ID,lang,n_chars,mark"))
     .write.partitionBy("project").option("header", "true").option("sep", "\x01").option("quote", "\x02").csv(root))
    names = [r["source"] for r in docs.select("source").distinct().collect()]
    return root, {n: f"project={n}" for n in names}


@query(
    "csv_record_counters",
    """
select source as project, count(*) as raw_rows, count(*) as parsed_rows, (count(*) filter (doc_id % 10 <> 5)) as field_audited_rows,
  (count(*) filter (doc_id % 10 in (3, 5))) as malformed_rows from documents group by 1
""",
)
def csv_record_counters(spark, sf_dir):
    """Counters of ragged files, one scan for the files of all sources."""
    records = R.read_catalogue(spark, *_ragged(spark, sf_dir))
    return R.record_counters(records, 3)


@query(
    "csv_malformed_records",
    """
select source as project, doc_id::varchar as id, (case when doc_id % 10 = 3 then 6 else 2 end)::bigint as observed_fields, 4::bigint as expected_fields
from documents where doc_id % 10 in (3, 5)
""",
)
def csv_malformed_records(spark, sf_dir):
    """Every ragged record with its width; quoted commas do not count."""
    records = R.read_catalogue(spark, *_ragged(spark, sf_dir))
    return records.filter("observed_fields <> expected_fields").select(
        F.col("source_project").alias("project"), F.col("ID").alias("id"), "observed_fields", "expected_fields"
    )


@query(
    "audit_resume",
    """
with d as (select source as project, coalesce(lang, '') as severity, coalesce(text, '') as text from documents),
s as (select project, length(text) as n from d),
m as (select project, median(n) as median_length, avg(n) as mean_length, max(n) as longest from s group by 1)
select d.project, count(*) as rows, (count(*) filter (text = '')) as description_missing, (count(*) filter (severity <> '')) as labelled,
  round(max(m.median_length), 4) as median_length, round(max(m.mean_length), 6) as mean_length, max(m.longest) as longest,
  max(q.pending_then) as pending_then
from d join m on m.project = d.project
left join (select source as project, count(distinct doc_id % 5) as pending_then from documents where doc_id % 5 in (1, 3) group by 1) q on q.project = d.project
group by 1
""",
)
def audit_resume(spark, sf_dir):
    """Documents in five parts per source: three are audited first, the rest when all are asked for."""
    docs = B.table(spark, sf_dir, "documents").select(
        F.col("source").alias("source_project"), F.concat(F.lit("part-"), (F.col("doc_id") % 5).cast("string")).alias("path"),
        F.col("doc_id").alias("record_number"), F.col("doc_id").cast("string").alias("issue_id"),
        F.coalesce("lang", F.lit("")).alias("severity"), F.lit("").alias("creation_time"), F.lit("").alias("summary"),
        F.coalesce("text", F.lit("")).alias("description"),
    )
    sources = docs.groupBy(F.col("source_project").alias("project"), "path").agg(F.count(F.lit(1)).alias("size_bytes"))
    store = A.StoredAudit(spark, scratch_path(spark, "audit-states"))

    def facts(pending: DataFrame) -> DataFrame:
        wanted = pending.select(F.col("project").alias("source_project"), "path")
        # The part of a row follows from its record number.
        part = F.concat(F.lit("part-"), (F.col("record_number") % 5).cast("string"))
        return row_facts(docs.join(wanted, ["source_project", "path"], "left_semi").drop("path")).withColumn("path", part)

    first = sources.filter("path in ('part-0', 'part-2', 'part-4')")
    store.run(first, facts)
    pending = store.pending(sources).groupBy("project").agg(F.count(F.lit(1)).alias("pending_then"))
    merged = store.run(sources, facts)
    long = A.lengths(merged).filter("field = 'description'").select(
        "project", F.round("median", 4).alias("median_length"), F.round("mean", 6).alias("mean_length"), F.col("max").alias("longest")
    )
    labelled = A.labels(merged).groupBy("project").agg(F.sum("n").alias("labelled"))
    return (
        A.summary(merged).select("project", "rows", "description_missing").join(labelled, "project", "left").fillna(0, ["labelled"])
        .join(long, "project").join(pending, "project", "left")
        .select("project", "rows", "description_missing", "labelled", "median_length", "mean_length", "longest", "pending_then")
    )
