"""Training corpus: classify, drop repeated lines and near-duplicates, decontaminate, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last return the
columns of ``documents``.

* ``quality_classifier`` drops the documents whose score is below 0.5.
* ``line_dedup`` removes lines that stand earlier in the corpus.  A document goes when it loses
  lines and nothing but blank lines is left of it.  ``n_chars`` follows the text.
* ``minhash_near_dedup`` keeps the document with the smallest id of each group (five-word
  shingles, similarity 0.8).
* ``benchmark_decontamination`` drops documents that hold a benchmark item.
* ``source_mixing`` returns one row per delivery: the columns of ``documents`` with epoch,
  words taken and position, sorted by position.

Null and empty texts pass the filters that find nothing in them; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracefold.llm import decontaminate, lines, minhash, mixing, quality
from tracefold.session import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, F.lit(True))
    return quality.score(docs, model).filter("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup_lines(docs, least=1)
    kept = cleaned.filter((F.col("lines_removed") == 0) | F.col("text").rlike(r"[^\x09-\x0d\x20]"))
    return kept.withColumn(
        "n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = minhash.near_duplicates(docs, words=5, percent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.curriculum(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: The classifier and the similarity searches have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
