"""Fold summaries, rankings, runtime tables and comparisons over fit results.

A fit row carries its configuration columns, ``task, fold, status`` and the scalar
metrics; per-class scores live in a long table keyed by ``experiment_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracefold.functions.scores import (
    fold_string,
    fold_wins,
    join_fold_deltas,
    parse_fold_string,
    precision_guard,
    relative_percent,
)

REQUIRED_FOLDS = 3


def fold_summary(fits: DataFrame, config: Sequence[str]) -> DataFrame:
    """Means over folds for configurations that have every fold; population deviation."""
    good = fits.filter("status = 'SUCCESS'")
    extras = []
    if "feature_count" in fits.columns:
        extras.append(F.avg("feature_count").alias("mean_feature_count"))
    return (
        good.groupBy(*config)
        .agg(
            fold_string(F.col("fold"), F.col("macro_f1")).alias("fold_macro_f1"),
            F.avg("macro_f1").alias("mean_macro_f1"),
            F.min("macro_f1").alias("min_fold_macro_f1"),
            F.stddev_pop("macro_f1").alias("std_macro_f1"),
            F.avg("balanced_accuracy").alias("mean_balanced_accuracy"),
            F.avg("accuracy").alias("mean_accuracy"),
            F.avg("weighted_f1").alias("mean_weighted_f1"),
            *extras,
            F.count(F.lit(1)).alias("_folds"),
        )
        .filter(F.col("_folds") == REQUIRED_FOLDS)
        .drop("_folds")
    )


def positive_class_summary(
    fits: DataFrame, classes: DataFrame, config: Sequence[str], task: str, label: str
) -> DataFrame:
    """Mean precision, recall and F1 of one class of one task, with the precision guard."""
    chosen = fits.filter((F.col("status") == "SUCCESS") & (F.col("task") == task))
    joined = chosen.select(*config, "experiment_id").join(
        classes.filter(F.col("class") == label), "experiment_id"
    )
    return joined.groupBy(*config).agg(
        F.avg("precision").alias("positive_precision"),
        F.avg("recall").alias("positive_recall"),
        F.avg("f1").alias("positive_f1"),
    ).withColumn("precision_guard", precision_guard(F.col("positive_precision")))


def ranked(summary: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    window = Window.partitionBy(*group).orderBy(*order)
    return summary.withColumn(name, F.row_number().over(window).cast("long"))


def rank_lexical(summary: DataFrame) -> DataFrame:
    """Macro-F1, balanced accuracy, weighted F1, then configuration names."""
    order = [
        F.desc("mean_macro_f1"), F.desc("mean_balanced_accuracy"), F.desc("mean_weighted_f1"),
        F.col("representation"), F.col("classifier"), F.col("class_weight"),
    ]
    return ranked(summary, ["task"], order, "rank_within_task")


def rank_staged(summary: DataFrame) -> DataFrame:
    """Macro-F1, worst fold, balanced accuracy, fewer features, configuration id."""
    order = [
        F.desc("mean_macro_f1"), F.desc("min_fold_macro_f1"), F.desc("mean_balanced_accuracy"),
        F.col("mean_feature_count"), F.col("configuration_id"),
    ]
    return ranked(summary, ["stage", "task"], order)


def rank_dense(summary: DataFrame) -> DataFrame:
    """Macro-F1, worst fold, balanced accuracy, configuration id."""
    order = [
        F.desc("mean_macro_f1"), F.desc("min_fold_macro_f1"), F.desc("mean_balanced_accuracy"),
        F.col("configuration_id"),
    ]
    return ranked(summary, ["task"], order, "rank_within_task")


def winners(board: DataFrame, rank: str = "rank") -> DataFrame:
    return board.filter(F.col(rank) == 1)


def best_per_task(board: DataFrame, rank: str, columns: Sequence[str]) -> DataFrame:
    return board.groupBy("task").agg(*[F.min_by(c, rank).alias(c) for c in columns])


def runtime_summary(fits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fits and seconds per group plus one TOTAL row; reused results do not count."""
    executed = fits.filter(~F.coalesce(F.col("reused"), F.lit(False)))
    sums = (
        executed.rollup(*by)
        .agg(
            F.grouping_id().alias("_level"),
            F.count(F.lit(1)).alias("fit_count"),
            F.sum("fit_seconds").alias("fit_seconds"),
            F.sum("prediction_seconds").alias("prediction_seconds"),
        )
    )
    last = (1 << len(by)) - 1
    return sums.filter(F.col("_level").isin(0, last)).select(
        *[F.when(F.col("_level") == last, "TOTAL").otherwise(F.col(c)).alias(c) for c in by],
        "fit_count", "fit_seconds", "prediction_seconds",
    )


def flatten_fits(fits: DataFrame) -> DataFrame:
    """Report rows: nested metrics dropped, four scalars promoted, warnings joined."""
    nested = {"metrics", "warnings"}
    return fits.select(
        *[c for c in fits.columns if c not in nested],
        *[F.col(f"metrics.{m}").alias(m) for m in
          ("macro_f1", "balanced_accuracy", "accuracy", "weighted_f1")],
        F.size("warnings").cast("long").alias("warning_count"),
        F.array_join("warnings", " | ").alias("warning_messages"),
    )


def compare_with_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Task rows of two systems: fold deltas, mean delta, fold wins, new winner."""
    a = current.select(
        "task", F.col("fold_macro_f1").alias("current_folds"),
        F.col("mean_macro_f1").alias("current_mean"),
    )
    b = baseline.select(
        "task", F.col("fold_macro_f1").alias("baseline_folds"),
        F.col("mean_macro_f1").alias("baseline_mean"),
    )
    mine, theirs = parse_fold_string(F.col("current_folds")), parse_fold_string(F.col("baseline_folds"))
    delta = F.col("current_mean") - F.col("baseline_mean")
    return a.join(b, "task").select(
        "task", "current_folds", "baseline_folds",
        join_fold_deltas(mine, theirs).alias("fold_deltas"),
        "current_mean", "baseline_mean",
        delta.alias("absolute_delta"),
        relative_percent(F.col("current_mean"), F.col("baseline_mean")).alias("relative_delta_percent"),
        fold_wins(mine, theirs).alias("fold_wins"),
        F.when(delta > 0, "YES").otherwise("NO").alias("new_winner"),
    )


def compare_with_systems(current: DataFrame, systems: DataFrame) -> DataFrame:
    """Current task means against (system, task, mean_macro_f1) of many systems."""
    a = current.select("task", F.col("mean_macro_f1").alias("current_mean"))
    b = systems.select("system", "task", F.col("mean_macro_f1").alias("system_mean"))
    return b.join(a, "task").select(
        "task", "system", "system_mean", "current_mean",
        (F.col("current_mean") - F.col("system_mean")).alias("absolute_delta"),
        relative_percent(F.col("current_mean"), F.col("system_mean")).alias("relative_delta_percent"),
    )


def family_summary(fits: DataFrame) -> DataFrame:
    """Metric means and fold lists for several result families."""
    return fits.groupBy("family", "task").agg(
        *[F.avg(m).alias(f"{m}_mean") for m in
          ("macro_f1", "balanced_accuracy", "accuracy", "weighted_f1")],
        fold_string(F.col("fold"), F.col("macro_f1")).alias("macro_f1_folds"),
    )


def matrix_gaps(results: DataFrame, tasks: Sequence[str], folds: int = REQUIRED_FOLDS) -> DataFrame:
    """Missing, unexpected or repeated (task, fold) cells of a result table."""
    spark = results.sparkSession
    expected = spark.createDataFrame([(t,) for t in tasks], "task string").withColumn(
        "fold", F.explode(F.sequence(F.lit(1), F.lit(folds)).cast("array<bigint>"))
    ).withColumn("expected", F.lit(1))
    seen = results.groupBy("task", F.col("fold").cast("long").alias("fold")).agg(
        F.count(F.lit(1)).alias("seen")
    )
    both = expected.join(seen, ["task", "fold"], "full_outer").na.fill(0, ["expected", "seen"])
    return both.filter(F.col("expected") != F.col("seen")).select("task", "fold", "expected", "seen")
