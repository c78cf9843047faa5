"""Small numeric expressions: shares, fold strings, deltas, guards, argmax, norms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracefold.protocol import PRECISION_FLOOR


def percentage(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(100 * part / F.nullif(whole, F.lit(0)), 8), F.lit(0.0))


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(0.0))


def fold_string(fold: Column, value: Column) -> Column:
    """Aggregate: one score per fold as fixed ten-decimal text, joined in fold order."""
    ordered = F.array_sort(F.collect_list(F.struct(fold.alias("f"), value.alias("v"))))
    return F.array_join(F.transform(ordered, lambda s: F.format_string("%.10f", s["v"])), "|")


def parse_fold_string(text: Column) -> Column:
    return F.transform(F.split(text, r"\|"), lambda x: x.cast("double"))


def join_fold_deltas(current: Column, previous: Column) -> Column:
    deltas = F.zip_with(current, previous, lambda a, b: F.format_string("%.10f", a - b))
    return F.array_join(deltas, "|")


def fold_wins(current: Column, previous: Column) -> Column:
    wins = F.zip_with(current, previous, lambda a, b: a > b)
    return F.size(F.filter(wins, lambda w: w)).cast("long")


def relative_percent(current: Column, previous: Column) -> Column:
    return (current - previous) / previous * 100


def precision_guard(precision: Column, floor: float = PRECISION_FLOOR) -> Column:
    return F.when(precision >= floor, "PASS").otherwise("FAIL")


def argmax_label(scores: Column, order: tuple[str, ...]) -> Column:
    labels = F.array(*[F.lit(x) for x in order])
    return F.get(labels, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def class_index(label: Column, order: tuple[str, ...]) -> Column:
    labels = F.array(*[F.lit(x) for x in order])
    return (F.array_position(labels, label) - 1).cast("long")


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero or non-finite norm is an error."""
    length = norm(vector)
    usable = (length > 0) & ~F.isnan(length) & (length < float("inf"))
    scaled = F.transform(vector, lambda x: (x.cast("double") / length).cast("float"))
    return F.when(usable, scaled).otherwise(F.raise_error(F.lit("zero or non-finite vector norm")))
