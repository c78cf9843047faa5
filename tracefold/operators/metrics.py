"""Fixed-class metrics from (true, predicted) pairs.

Predictions are counted into confusion cells once, with map-side aggregation; every
other number is arithmetic over those few cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracefold.functions.scores import safe_ratio
from tracefold.operators.ordering import with_running_sums

SCALARS = ("macro_f1", "balanced_accuracy", "accuracy", "weighted_f1")


def confusion_counts(
    pairs: DataFrame, keys: Sequence[str], true: str = "y_true", predicted: str = "y_pred"
) -> DataFrame:
    return pairs.groupBy(*keys, F.col(true).alias("y_true"), F.col(predicted).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _classes(orders: Mapping[str, Sequence[str]], task: Column) -> Column:
    """Fixed class list of the row's task."""
    listed = F.lit(None).cast("array<string>")
    for name, labels in orders.items():
        listed = F.when(task == name, F.array(*[F.lit(x) for x in labels])).otherwise(listed)
    return listed


def confusion_matrix(
    cells: DataFrame, keys: Sequence[str], orders: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Every (true, predicted) cell of the fixed class list, empty cells as zero.

    ``keys`` must contain ``task``.
    """
    spine = (
        cells.select(*keys)
        .distinct()
        .withColumn("y_true", F.explode(_classes(orders, F.col("task"))))
        .withColumn("y_pred", F.explode(_classes(orders, F.col("task"))))
    )
    return spine.join(cells, [*keys, "y_true", "y_pred"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def matrix_rows(matrix: DataFrame, keys: Sequence[str], orders: Mapping) -> DataFrame:
    """The matrix as an array of rows in class order."""
    rank = {c: F.array_position(_classes(orders, F.col("task")), F.col(c)) for c in ("y_true", "y_pred")}
    lines = (
        matrix.withColumn("_t", rank["y_true"])
        .withColumn("_p", rank["y_pred"])
        .groupBy(*keys, "_t")
        .agg(F.array_sort(F.collect_list(F.struct("_p", "n"))).alias("cells"))
        .withColumn("line", F.transform("cells", lambda s: s["n"]))
    )
    return lines.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_t", "line"))), lambda s: s["line"]
        ).alias("confusion_matrix")
    )


def per_class(cells: DataFrame, keys: Sequence[str], orders: Mapping) -> DataFrame:
    """Precision, recall, F1 and support of every class of the fixed list."""
    truth = cells.groupBy(*keys, F.col("y_true").alias("class")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hits"),
    )
    guessed = cells.groupBy(*keys, F.col("y_pred").alias("class")).agg(F.sum("n").alias("guessed"))
    spine = cells.select(*keys).distinct().withColumn(
        "class", F.explode(_classes(orders, F.col("task")))
    )
    on = [*keys, "class"]
    joined = spine.join(truth, on, "left").join(guessed, on, "left").na.fill(
        0, ["support", "hits", "guessed"]
    )
    return joined.select(
        *on,
        safe_ratio(F.col("hits"), F.col("guessed")).alias("precision"),
        safe_ratio(F.col("hits"), F.col("support")).alias("recall"),
        safe_ratio(2 * F.col("hits"), F.col("guessed") + F.col("support")).alias("f1"),
        "support",
        "hits",
    )


def scalar_metrics(classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Macro-F1 over all classes; balanced accuracy over classes present in the truth."""
    support = F.col("support")
    return classes.groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"),
        F.avg(F.when(support > 0, F.col("recall"))).alias("balanced_accuracy"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("f1") * support) / F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("rows"),
    )


def foreign_predictions(pairs: DataFrame, orders: Mapping) -> DataFrame:
    """Predictions outside the fixed class list of their task."""
    inside = F.array_contains(_classes(orders, F.col("task")), F.col("y_pred"))
    return pairs.filter(~F.coalesce(inside, F.lit(False)))


def unpivot_tasks(wide: DataFrame, keys: Sequence[str], tasks: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One prediction table with a pair of columns per task -> (keys, task, y_true, y_pred)."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(task).alias("task"), F.col(t).alias("y_true"), F.col(p).alias("y_pred")
                )
                for task, (t, p) in tasks.items()
            ]
        )
    )
    return wide.select(*keys, pairs.alias("_p")).select(*keys, "_p.*")


def ranking_areas(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """PR-AUC (trapezoid, anchored at recall 0 / precision 1) and ROC-AUC per key.

    Rows carry ``score`` and ``positive`` (boolean).  Equal scores form one step.  Scores
    can be as many as rows, so the running counts come from range-partitioned sums.
    """
    steps = scored.groupBy(*keys, "score").agg(
        F.count_if(F.col("positive")).alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )
    run = with_running_sums(steps, list(keys), [-F.col("score")], ["pos", "neg"])
    before_pos = F.col("pos_through") - F.col("pos")
    before_neg = F.col("neg_through") - F.col("neg")
    precision = F.col("pos_through") / (F.col("pos_through") + F.col("neg_through"))
    seen = before_pos + before_neg
    previous = F.when(seen > 0, before_pos / seen).otherwise(1.0)
    total_pos, total_neg = F.col("pos_total"), F.col("neg_total")
    areas = run.select(
        *keys,
        (F.col("pos") / total_pos * (precision + previous) / 2).alias("pr"),
        # Each negative of the step ranks below every earlier positive and ties with its own.
        (F.col("neg") * (before_pos + F.col("pos") / 2) / (total_pos * total_neg)).alias("roc"),
    )
    sums = [F.sum("pr").alias("pr_auc"), F.sum("roc").alias("roc_auc")]
    return areas.groupBy(*keys).agg(*sums) if keys else areas.agg(*sums)
