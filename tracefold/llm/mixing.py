"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and share all words of
the corpus; a target stops at three times its source's words and the excess goes to the
others by weight (the water level is found from sorted cap/weight ratios).

Curriculum: over training time t in 0..1 a source's rate is its target times
(1 + tilt * (2t - 1)), so its share moves linearly and its integral over 0..1 is the target.
Cumulative demand is target * (t + tilt * (t**2 - t)).  The k-th word that a source delivers
stands at the t where cumulative demand reaches k.  A source delivers its documents in a
seeded order, epoch after epoch; the document at which the target is reached is cut there,
so each source takes its target to the word.  Entries are range-sorted by t.

Running word sums come from range-partitioned ranks, so a source with a third of all rows is
many ranges.  Only tables with one row per source or per range are sorted in one task.

Defined cases: null or blank text has size 0, is taken 0 times and keeps its row in
``mix`` (it has no entry in ``curriculum``).  A source of empty documents has target 0.
Repeated rows and repeated ids are separate documents; an arbitrary but repeatable order
breaks ties between identical rows, and taken words of identical rows are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracefold.operators.ordering import with_running_sums
from tracefold.session import materialize

CAP = 3
TILTS = (-0.6, 0.0, 0.6)  # early, even and late sources, repeating like the weights
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size (words of each text) and the columns to carry."""
    return docs.select(
        *carry,
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, weight, tilt, target; one row per source."""
    totals = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    everyone = Window.partitionBy()
    ranked = totals.withColumn(
        "_nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn("weight", (F.col("_nth") % 3 + 1).cast("double"))
    ranked = ranked.withColumn("cap", (CAP * F.col("source_size")).cast("double"))
    rising = Window.orderBy((F.col("cap") / F.col("weight")), "_nth")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everyone)
    level = ranked.withColumn(
        "_level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    )
    # The first source, by cap/weight, whose cap is not below the level fixes the level for all.
    fixed = F.min(
        F.when(F.col("cap") >= F.col("_level") * F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "_nth", "_level"))
    ).over(everyone)
    return level.withColumn("_fixed", fixed["_level"]).select(
        "source", "source_size", "weight",
        F.element_at(F.array(*[F.lit(t) for t in TILTS]), (F.col("_nth") % len(TILTS) + 1).cast("int")).alias("tilt"),
        F.least("cap", F.col("weight") * F.col("_fixed")).alias("target"),
    )


def position_of(words: Column, target: Column, tilt: Column) -> Column:
    """Training time at which ``words`` words have been demanded: the inverse of the integral."""
    share = F.least(F.lit(1.0), words / F.greatest(target, F.lit(1e-9)))
    slope = F.lit(1.0) - tilt
    root = F.sqrt(slope * slope + 4 * tilt * share)
    return F.when(F.abs(tilt) < 1e-12, share).otherwise((2 * share) / (slope + root))


def mix(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, offset, tilt; one row per document."""
    sized = materialize(sizes(docs, carry).withColumn("_order", F.md5(F.col("doc_id").cast("string"))), "mix-sizes")
    goal = materialize(targets(sized), "mix-targets")
    # Equal sources must meet, null ones too, so the group is a non-null key.
    named = sized.withColumn("_group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    goal = goal.withColumn("_group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    summed = with_running_sums(
        named, ["_group"], [F.col("_order"), F.col("doc_id"), F.col("size")], ["size"]
    )
    placed = summed.join(goal, "_group").withColumn("offset", F.col("size_through") - F.col("size"))
    wanted = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = wanted - full * F.col("source_size")
    partial = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("offset")))
    return placed.select(
        *carry, "doc_id", "source", "size", "source_size", "target",
        (full * F.col("size") + partial).alias("taken"), "offset", "tilt",
    )


def entries(mixed: DataFrame) -> DataFrame:
    """One row per delivery of a document: epoch, words and position in training time."""
    epochs = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    return (
        mixed.withColumn("_epochs", epochs).filter("_epochs > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1)))
        .withColumn("words", F.least("size", F.col("taken") - F.col("epoch") * F.col("size")))
        .withColumn("position", position_of(
            (F.col("epoch") * F.col("source_size") + F.col("offset")).cast("double"), F.col("target"), F.col("tilt")
        ))
        .drop("_epochs")
    )


def curriculum(docs: DataFrame) -> DataFrame:
    """Training order: columns of ``docs`` with epoch, words and position, range-sorted.

    Rows are numbered in a written copy, so that repeated ids and rows stay apart.
    """
    fresh = [c for c in docs.columns if c.lower() not in ("epoch", "words", "position", "_row")]
    numbered = materialize(docs.select(*fresh).withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    order = entries(mix(numbered, ("_row",))).select("_row", "epoch", "words", "position")
    return numbered.join(order, "_row").orderBy("position", "doc_id", "_row", "epoch").drop("_row")
