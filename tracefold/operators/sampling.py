"""Hash-ranked samples, stratified samples, budgets, batches and token-length audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracefold.functions.ids import hash_rank
from tracefold.functions.windows import chunk_bucket, chunk_count
from tracefold.operators.audit import weighted_statistics
from tracefold.operators.ordering import with_position, with_running_sums
from tracefold.protocol import CHUNK_LENGTH, STUDY_SEED
from tracefold.session import materialize


def smallest_ranks(rows: DataFrame, k: int, seed: int = STUDY_SEED) -> DataFrame:
    """The k rows of smallest hash rank, in rank order."""
    ranked = rows.withColumn("hash_rank", hash_rank(str(seed), F.col("stable_id")))
    return ranked.orderBy("hash_rank", "stable_id").limit(k)


def bounded_slice(rows: DataFrame, n: int) -> DataFrame:
    """First n rows by stable id."""
    return rows.orderBy("stable_id").limit(n)


def covering_slice(rows: DataFrame, n: int, label: str, order: Sequence[str]) -> DataFrame:
    """First n rows by id, with the first row of every class moved to the front."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label))
    owners = rows.groupBy(label).agg(F.min("stable_id").alias("_first"))
    marked = rows.join(owners, label).withColumn(
        "_lead", F.when(F.col("stable_id") == F.col("_first"), rank)
    )
    return marked.orderBy(F.col("_lead").asc_nulls_last(), "stable_id").limit(n).drop(
        "_first", "_lead"
    )


def stratum_allocation(rows: DataFrame, size: int, label: str) -> DataFrame:
    """Largest-remainder allocation of ``size`` over strata (one row per stratum)."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("stratum_rows"))
    everything = Window.partitionBy()
    total = F.sum("stratum_rows").over(everything)
    base = counts.select(
        "label", "stratum_rows", F.expr(f"cast({size} as bigint) * stratum_rows").alias("_p"),
        total.alias("_n"),
    ).withColumns({"_floor": F.expr("_p div _n"), "_rest": F.expr("_p % _n")})
    order = Window.orderBy(F.desc("_rest"), "label")
    spare = F.lit(size) - F.sum("_floor").over(everything)
    return base.select(
        "label", "stratum_rows",
        (F.col("_floor") + (F.row_number().over(order) <= spare).cast("long")).alias("allocation"),
    )


def stratified_sample(rows: DataFrame, size: int, label: str, salt: str) -> DataFrame:
    """Proportional sample: hash order inside each stratum, largest-remainder sizes."""
    ranked = rows.withColumn("_rank", hash_rank(salt, F.col("stable_id")))
    placed = with_position(ranked, [label], [F.col("_rank"), F.col("stable_id")])
    allocation = stratum_allocation(rows, size, label).select(F.col("label").alias(label), "allocation")
    return (
        placed.join(allocation, label)
        .filter("position < allocation")
        .drop("_rank", "position", "group_rows", "allocation")
    )


def prefix_until(rows: DataFrame, order: Sequence[Column], weight: str, target: int) -> DataFrame:
    """Rows in order until the running weight reaches ``target``, crossing row included."""
    run = with_running_sums(rows, [], order, [weight])
    before = F.col(f"{weight}_through") - F.col(weight)
    return run.filter(before < target).drop(f"{weight}_total")


def length_batches(
    rows: DataFrame, length: str, batch_size: int, seed: int = STUDY_SEED, epoch: int = 0
) -> DataFrame:
    """Batches of similar length; batch order is a seeded hash order.

    ``batch`` numbers batches by length, ``batch_rank`` is the hash the loader sorts on.
    """
    keyed = rows.withColumn("_rank", hash_rank(f"{seed}|{epoch}", F.col("stable_id")))
    placed = with_position(keyed, [], [F.col(length), F.col("_rank"), F.col("stable_id")])
    batch = F.expr(f"position div {batch_size}")
    return placed.withColumn("batch", batch).withColumn(
        "batch_rank", hash_rank(f"{seed}|{epoch}|batch", F.col("batch").cast("string"))
    ).drop("_rank", "group_rows")


def length_counts(rows: DataFrame, length: Column) -> DataFrame:
    """Documents per (project, length): the input of every length report."""
    return rows.groupBy(F.col("source_project").alias("project"), length.cast("long").alias("length")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _with_total(counted: DataFrame) -> DataFrame:
    """Every count once under its project and once under ALL."""
    return counted.withColumn("project", F.explode(F.array(F.col("project"), F.lit("ALL"))))


def token_length_audit(counted: DataFrame, limit: int) -> DataFrame:
    """Per project and ALL: documents, min/mean/median/max tokens, fits, truncated, share."""
    both = _with_total(counted)
    stats = weighted_statistics(both, ["project"], "length")
    over = both.groupBy("project").agg(
        F.sum(F.when(F.col("length") > limit, F.col("n")).otherwise(0)).alias("requires_truncation")
    )
    return stats.join(over, "project").select(
        "project",
        F.col("count").alias("development_records"),
        (F.col("count") - F.col("requires_truncation")).alias("fits_without_truncation"),
        "requires_truncation",
        (F.col("requires_truncation") / F.col("count") * 100).alias("truncation_percentage"),
        F.col("min").alias("minimum_tokens"),
        F.col("mean").alias("mean_tokens"),
        F.col("median").alias("median_tokens"),
        F.col("max").alias("maximum_tokens"),
    )


def length_percentiles(counted: DataFrame) -> DataFrame:
    """Exact p90, p95 and p99 over all documents, linear between neighbours."""
    whole = counted.groupBy("length").agg(F.sum("n").alias("n"))
    cut = F.percentile(F.col("length"), F.array(F.lit(0.9), F.lit(0.95), F.lit(0.99)), F.col("n"))
    return whole.agg(cut.alias("p")).select(
        F.col("p")[0].alias("p90_tokens"), F.col("p")[1].alias("p95_tokens"), F.col("p")[2].alias("p99_tokens")
    )


def chunk_audit(counted: DataFrame, limit: int = CHUNK_LENGTH) -> DataFrame:
    """Per project and ALL: documents by number of windows, totals, mean, median, maximum."""
    chunked = _with_total(counted.withColumn("chunks", chunk_count(F.col("length"), limit)))
    named = {"1": "one_chunk", "2": "two_chunks", "3": "three_chunks", "4": "four_chunks",
             "5": "five_chunks", ">5": "over_five_chunks"}
    bucketed = chunked.withColumn("bucket", chunk_bucket(F.col("chunks")))
    weight = F.col("n")
    return bucketed.groupBy("project").agg(
        F.sum("n").alias("total_records"),
        *[
            F.sum(F.when(F.col("bucket") == value, weight).otherwise(0)).alias(name)
            for value, name in named.items()
        ],
        F.sum(F.col("chunks") * weight).alias("total_chunks"),
        (F.sum(F.col("chunks") * weight) / F.sum(weight)).alias("mean_chunks"),
        F.percentile(F.col("chunks"), F.lit(0.5), weight).alias("median_chunks"),
        F.max("chunks").alias("maximum_chunks"),
        (F.sum(F.col("chunks") * weight) - F.sum(weight)).alias("additional_chunks"),
    )


def balanced_weights(rows: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """n / (k * count) per class of the fixed list, and the same rescaled to mean one."""
    counts = rows.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    spine = rows.sparkSession.createDataFrame([(x,) for x in order], "class string")
    found = materialize(spine.join(counts, "class", "left"), "class-counts")
    absent = [r["class"] for r in found.filter("n is null").collect()]
    if absent:
        raise ValueError(f"classes without training rows: {absent}")
    whole = Window.partitionBy()
    weight = F.sum("n").over(whole) / (F.lit(len(order)) * F.col("n"))
    return found.select("class", "n", weight.alias("weight")).withColumn(
        "weight_mean_one", F.col("weight") / F.avg("weight").over(whole)
    )
