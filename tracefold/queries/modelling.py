"""Fits, grids and held-out scoring over the tables; streams over them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracefold.operators import features as X, linear, metrics as M, split as S
from tracefold.operators.vectors import encode_documents, hashing_encoder
from tracefold.plans import bundles, modelling as G
from tracefold.plans.prepare import split_rows
from tracefold.protocol import SEVERITY
from tracefold.queries.registry import query
from tracefold.session import materialize, scratch_path
from tracefold.sources import bindings as B
from tracefold.sources.stores import ResultStore
from tracefold.streaming.incremental_audit import (
    audit_stream,
    latest_totals,
    running_counters,
    scratch_stream_paths,
    table_glob,
)

ORDERS = {"S10": tuple(f"L{i}" for i in range(10)), "S2": ("HIGH", "LOW")}
POSITIVE = {"S2": "HIGH_IMPACT"}

# The frozen (classifier, weight, c) per task of the final models.
METHODS = {
    "S6": ("LINEARSVC", "BALANCED", 0.25),
    "S3": ("LOGREG", "BALANCED", 2.0),
    "S2": ("LOGREG", "BALANCED", 2.0),
}


def _vectors(spark: SparkSession, sf_dir: str, task: str) -> tuple[DataFrame, DataFrame]:
    label = F.concat(F.lit("L"), F.col("label").cast("string"))
    y = label if task == "S10" else F.when(F.col("label") < 3, "HIGH").otherwise("LOW")
    rows = B.vectors(spark, sf_dir).withColumn("y_true", y)
    third = F.col("vec_id") % 3 == 0
    parts = []
    for part in (rows.filter(~third), rows.filter(third)):
        parts.append(X.sparse_rows(part.select("stable_id", "y_true"), None, 0, part, 64))
    return parts[0], parts[1]


def _guesses(spark: SparkSession, sf_dir: str, spec: linear.Spec, positive: dict | None = None) -> DataFrame:
    train, validation = _vectors(spark, sf_dir, spec.task)
    targets = {spec.task: "y_true"}
    models = linear.train(train, 64, targets, ORDERS, [spec])
    return linear.predict(validation, models, targets, positive)


@query("dense_logistic_regression")
def dense_logistic_regression(spark, sf_dir):
    """Ten classes from the vectors: fit on two thirds, one prediction per other row."""
    guesses = _guesses(spark, sf_dir, linear.Spec("dense", "S10", "LOGREG", "BALANCED"))
    return guesses.select("stable_id", "y_true", "y_pred")


@query("dense_score_areas")
def dense_score_areas(spark, sf_dir):
    """Two classes from the vectors: ranking areas of the logistic score."""
    scored = _guesses(spark, sf_dir, linear.Spec("dense", "S2", "LOGREG"), {"S2": "HIGH"})
    return M.ranking_areas(scored.select("score", (F.col("y_true") == "HIGH").alias("positive")))


def _corpus(spark: SparkSession, sf_dir: str, views: bool = True) -> tuple[G.Corpus, DataFrame]:
    """Development rows with folds; all rows with their membership.

    Without ``views`` the combined text is written, but not its two parts.
    """
    rows = B.eligible_text(spark, sf_dir)
    eligible = materialize(rows if views else rows.drop("summary", "description"), "eligible-text")
    rows, _ = split_rows(materialize(B.text_free(eligible), "narrow"))
    folds = materialize(S.fold_memberships(rows), "folds")
    development = eligible.join(
        rows.filter("membership = 'DEVELOPMENT'").select("stable_id"), "stable_id", "left_semi"
    )
    return G.Corpus(development, folds, SEVERITY), eligible.join(rows.select("stable_id", "membership"), "stable_id")


def _with_vectors(corpus: G.Corpus, dimension: int) -> G.Corpus:
    """The corpus with hashed vectors of its texts."""
    texts = corpus.rows.select("stable_id", F.col("text_combined").alias("text"))
    dense = materialize(encode_documents(texts, hashing_encoder(dimension)), "dense")
    return replace(corpus, dense=dense, dimension=dimension)


def _board(spark: SparkSession, corpus: G.Corpus, grid: list[G.Experiment], provenance: str) -> DataFrame:
    results = G.run_grid(corpus, grid, ResultStore(spark, scratch_path(spark, "results")), provenance)
    return G.staged_board(results).select("task", "configuration_id", "fold_macro_f1", "mean_macro_f1", "rank")


@query("dense_benchmark_board")
def dense_benchmark_board(spark, sf_dir):
    """The 36 fits of tasks, folds, classifiers and weights for each of two encoders, ranked per encoder."""
    out = None
    plain, _ = _corpus(spark, sf_dir)
    for dimension in (32, 64):
        corpus = _with_vectors(plain, dimension)
        board = _board(spark, corpus, G.dense_experiments(SEVERITY.tasks), f"dense-{dimension}")
        board = board.withColumn("encoder", F.lit(f"HASHED{dimension}"))
        out = board if out is None else out.unionByName(board)
    return out


@query("holdout_scoring")
def holdout_scoring(spark, sf_dir):
    """Refit every task on development text, publish, load, then score held-out text once."""
    corpus, every = _corpus(spark, sf_dir, views=False)
    final = G.train_final(corpus.rows, SEVERITY, METHODS, "WORD")
    root, identity = scratch_path(spark, "final"), {"protocol": "holdout"}
    bundles.publish(spark, final, root, identity)
    locked = every.filter("membership = 'LOCKED_TEST'")
    scored = bundles.score_once(
        spark, root, scratch_path(spark, "receipts"), identity, locked, locked, SEVERITY, POSITIVE
    )
    return scored["metrics"].join(scored["areas"], "task", "left").join(scored["fingerprints"], "task")


@query(
    "streamed_event_audit",
    """
select event_type as source_project, count(*) as rows, (count(*) filter (value < 1)) as small_values,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') as earliest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as latest
from events group by 1
""",
)
def streamed_event_audit(spark, sf_dir):
    """Events read as a file stream; counters accumulate per type."""
    checkpoint, sink = scratch_stream_paths(spark, "event-audit")
    schema = B.table(spark, sf_dir, "events").schema

    def aggregate(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("event_type").alias("source_project")).agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("value") < 1).alias("small_values"),
            F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("earliest"),
            F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"),
        )

    audit_stream(spark, table_glob(sf_dir, "events"), schema, lambda s: s, aggregate, checkpoint, sink, "*")
    return latest_totals(spark, sink)


@query(
    "streamed_page_audit",
    """
with p as (select regexp_extract(url, '^([a-z]+)://', 1) as source_project, url as summary, html as description from pages)
select source_project, count(*) as rows, (count(*) filter (summary = '')) as summary_missing, (count(*) filter (description = '')) as description_missing,
  (count(*) filter (regexp_matches(summary || ' ' || description, '(?i)</?[a-z][^>]*>'))) as has_html,
  (count(*) filter (regexp_matches(summary || ' ' || description, '(?i)(?:https?://|www\\.)'))) as has_url from p group by 1
""",
)
def streamed_page_audit(spark, sf_dir):
    """Pages read as a file stream through the same row facts as the batch audit."""
    from tracefold.operators.audit import row_facts

    checkpoint, sink = scratch_stream_paths(spark, "page-audit")
    schema = B.table(spark, sf_dir, "pages").schema
    audit_stream(
        spark, table_glob(sf_dir, "pages"), schema, lambda s: row_facts(B.pages_as_issues(s)),
        lambda facts: running_counters(facts, "source_project"), checkpoint, sink, "*",
    )
    return latest_totals(spark, sink).select(
        "source_project", "rows", "summary_missing", "description_missing", "has_html", "has_url"
    )
