"""Chronological hold-out split, expanding folds and the duplicate purge.

All fold and hold-out decisions follow from two numbers per row: its position inside
its project and the earliest block its component (or its text) reaches.  Folds expand,
so a row of block ``b`` is a validation row of fold ``b - 1`` only, and it must go if
its component was seen in any block before ``b``.  Nothing is exploded per fold until
memberships are written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracefold.functions.ids import issue_sort_columns
from tracefold.operators.ordering import with_position
from tracefold.protocol import LabelScheme
from tracefold.session import materialize

DEVELOPMENT, CANDIDATE = "DEVELOPMENT", "LOCKED_CANDIDATE"
FOLDS = 3
BLOCKS = FOLDS + 1
EXACT, LINKED = "exact_text", "explicit_dupe_link"


def chronological_split(
    rows: DataFrame, *, numerator: int = 4, denominator: int = 5, blocks: int = BLOCKS
) -> DataFrame:
    """Add ``position, project_rows, boundary, partition, block``.

    The first floor(n * numerator / denominator) rows of a project are development;
    ties in time go by numeric issue id, then text.  Development is cut into equal
    position blocks 1..blocks; candidates have no block.
    """
    order = [F.col("creation_time"), *issue_sort_columns(F.col("issue_id"))]
    ranked = with_position(rows, ["source_project"], order)
    ranked = ranked.withColumnRenamed("group_rows", "project_rows").withColumn(
        "boundary", F.expr(f"project_rows * {numerator} div {denominator}")
    )
    passed = sum(
        (F.col("position") >= F.expr(f"boundary * {i} div {blocks}")).cast("int")
        for i in range(1, blocks)
    )
    development = F.col("position") < F.col("boundary")
    return ranked.withColumn(
        "partition", F.when(development, DEVELOPMENT).otherwise(CANDIDATE)
    ).withColumn("block", F.when(development, passed + 1).cast("int"))


def _reason(component_block: Column, hash_block: Column, limit: Column) -> Column:
    """Why a row must go when only blocks below ``limit`` count as earlier."""
    return F.when(
        component_block < limit, F.when(hash_block < limit, EXACT).otherwise(LINKED)
    )


def purge_reasons(rows: DataFrame) -> DataFrame:
    """Add ``locked_reason, pooled_reason, within_reason`` (NULL = the row stays).

    Rows are first reduced to one cell per (text hash, project); a text held by a
    third of all rows is a handful of cells, and the lookups run on the cells.
    """
    cells = materialize(
        rows.groupBy("exact_text_hash", "component", "source_project").agg(
            F.min("block").alias("within_hash_block"),
            F.max("block").alias("_last_block"),
            F.count_if(F.col("block").isNull()).alias("_candidates"),
        ),
        "purge-cells",
    )
    seen = cells.filter("within_hash_block is not null")

    def earliest(keys: list[str], name: str) -> DataFrame:
        return seen.groupBy(*keys).agg(F.min("within_hash_block").alias(name))

    looked_up = (
        cells.join(earliest(["exact_text_hash"], "hash_block"), "exact_text_hash", "left")
        .join(earliest(["component"], "component_block"), "component", "left")
        .join(
            earliest(["component", "source_project"], "within_component_block"),
            ["component", "source_project"],
            "left",
        )
        .drop("component")
    )
    # Only cells with a candidate or with a block after their component's first one can
    # lose a row; the others, nearly all, do not meet the rows again.
    touching = looked_up.filter(
        "component_block is not null and (_candidates > 0 or component_block < _last_block)"
    ).drop("_last_block", "_candidates")
    joined = rows.join(touching, ["exact_text_hash", "source_project"], "left")
    block = F.col("block")
    beyond = F.lit(BLOCKS + 1)
    candidate = F.col("partition") == CANDIDATE
    return (
        joined.withColumn(
            "locked_reason",
            F.when(candidate, _reason(F.col("component_block"), F.col("hash_block"), beyond)),
        )
        .withColumn(
            "pooled_reason",
            F.when(~candidate, _reason(F.col("component_block"), F.col("hash_block"), block)),
        )
        .withColumn(
            "within_reason",
            F.when(
                ~candidate,
                _reason(F.col("within_component_block"), F.col("within_hash_block"), block),
            ),
        )
        .drop("within_hash_block", "hash_block", "component_block", "within_component_block")
    )


def final_partition(rows: DataFrame) -> DataFrame:
    """Add ``membership``: DEVELOPMENT, LOCKED_TEST or REMOVED."""
    return rows.withColumn(
        "membership",
        F.when(F.col("partition") == DEVELOPMENT, DEVELOPMENT)
        .when(F.col("locked_reason").isNull(), "LOCKED_TEST")
        .otherwise("REMOVED"),
    )


def _families() -> Column:
    return F.explode(
        F.array(
            F.struct(
                F.lit("within_project").alias("family"), F.col("within_reason").alias("reason")
            ),
            F.struct(F.lit("pooled").alias("family"), F.col("pooled_reason").alias("reason")),
        )
    )


def fold_memberships(rows: DataFrame) -> DataFrame:
    """Long membership table: one row per (family, fold, role) a development row is in."""
    placed = (
        rows.filter("block is not null")
        .withColumn("_family", _families())
        .withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(1, FOLDS + 1)])))
    )
    role = F.when(F.col("block") <= F.col("fold"), "TRAIN").when(
        (F.col("block") == F.col("fold") + 1) & F.col("_family.reason").isNull(), "VALIDATION"
    )
    return (
        placed.select(
            F.col("_family.family").alias("family"),
            F.col("fold").cast("long").alias("fold"),
            role.alias("role"),
            "source_project",
            "issue_id",
            "stable_id",
            "creation_time",
        )
        .filter("role is not null")
    )


def split_counts(rows: DataFrame) -> DataFrame:
    """Per project: eligible, development, candidates, removed by reason, final."""
    def count_if(condition: str) -> Column:
        return F.count_if(F.expr(condition))

    return rows.groupBy(F.col("source_project").alias("project")).agg(
        F.count(F.lit(1)).alias("eligible_rows"),
        count_if("block is not null").alias("final_development_rows"),
        count_if("block is null").alias("locked_test_candidate_rows"),
        count_if(f"locked_reason = '{EXACT}'").alias("locked_removed_exact_text"),
        count_if(f"locked_reason = '{LINKED}'").alias("locked_removed_explicit_dupe_link"),
        count_if("block is null and locked_reason is null").alias("final_locked_test_rows"),
        F.max("boundary").alias("chronology_boundary_index"),
    )


def _long_targets(scheme: LabelScheme) -> Column:
    return F.explode(
        F.array(
            *[
                F.struct(F.lit(t).alias("task"), F.col(f"target_{t.lower()}").alias("class"))
                for t in scheme.tasks
            ]
        )
    )


def class_list(scheme: LabelScheme) -> Column:
    """Every (task, class) of the scheme as a literal array of structs."""
    return F.array(
        *[
            F.struct(F.lit(task).alias("task"), F.lit(label).alias("class"))
            for task in scheme.tasks
            for label in scheme.orders[task]
        ]
    )


def _zero_filled(counts: DataFrame, keys: DataFrame, scheme: LabelScheme) -> DataFrame:
    """Every key with every class of the fixed lists, absent counts as zero."""
    names = keys.columns
    spine = keys.withColumn("_c", F.explode(class_list(scheme))).select(*names, "_c.*")
    return spine.join(counts, spine.columns, "left").withColumn(
        "count", F.coalesce("count", F.lit(0))
    )


def class_distribution(rows: DataFrame, scheme: LabelScheme) -> DataFrame:
    """Partition x task x class counts, zero-filled over the fixed class lists.

    Counts run over the raw labels first; all targets follow from them, so the wide
    rows are never multiplied by the number of tasks.
    """
    targets = [f"target_{t.lower()}" for t in scheme.tasks]
    grouped = (
        rows.filter("membership <> 'REMOVED'")
        .groupBy("membership", *targets)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = (
        grouped.select(F.col("membership").alias("partition"), "n", _long_targets(scheme).alias("t"))
        .groupBy("partition", F.col("t.task").alias("task"), F.col("t.class").alias("class"))
        .agg(F.sum("n").alias("count"))
    )
    keys = rows.sparkSession.createDataFrame(
        [(DEVELOPMENT,), ("LOCKED_TEST",)], "partition string"
    )
    return _zero_filled(counts, keys, scheme)


def _fold_cells(rows: DataFrame, *extra: str) -> DataFrame:
    """Development counts per project x block (x extra) with both purges."""
    def kept(column: str) -> Column:
        return F.count_if(F.col(column).isNull())

    def removed(column: str, reason: str) -> Column:
        return F.count_if(F.col(column) == reason)

    families = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(family).alias("family"),
                    F.col(f"{short}_kept").alias("kept"),
                    F.col(f"{short}_exact").alias("exact"),
                    F.col(f"{short}_linked").alias("linked"),
                )
                for family, short in (("within_project", "within"), ("pooled", "pooled"))
            ]
        )
    )
    return (
        rows.filter("block is not null")
        .groupBy("source_project", "block", *extra)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[kept(f"{s}_reason").alias(f"{s}_kept") for s in ("within", "pooled")],
            *[removed(f"{s}_reason", EXACT).alias(f"{s}_exact") for s in ("within", "pooled")],
            *[removed(f"{s}_reason", LINKED).alias(f"{s}_linked") for s in ("within", "pooled")],
        )
        .withColumn("f", families)
        .withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(1, FOLDS + 1)])))
        .select(
            F.col("f.family").alias("family"),
            F.col("fold").cast("long").alias("fold"),
            F.col("source_project").alias("project"),
            *extra,
            F.when(F.expr("block <= fold"), F.col("n")).otherwise(0).alias("train"),
            *[
                F.when(F.expr("block = fold + 1"), value).otherwise(0).alias(name)
                for name, value in (
                    ("candidates", F.col("n")),
                    ("exact", F.col("f.exact")),
                    ("linked", F.col("f.linked")),
                    ("kept", F.col("f.kept")),
                )
            ],
        )
    )


def fold_sizes(rows: DataFrame) -> DataFrame:
    return (
        _fold_cells(rows)
        .groupBy("family", "fold", "project")
        .agg(
            F.sum("train").alias("training_rows"),
            F.sum("candidates").alias("validation_candidate_rows"),
            F.sum("exact").alias("validation_removed_exact_text"),
            F.sum("linked").alias("validation_removed_explicit_dupe_link"),
            F.sum("kept").alias("validation_final_rows"),
        )
    )


def fold_class_counts(rows: DataFrame, scheme: LabelScheme) -> DataFrame:
    """Family x fold x project x partition x task x class, zero-filled."""
    targets = [f"target_{t.lower()}" for t in scheme.tasks]
    cells = materialize(_fold_cells(rows, *targets), "fold-cells")
    roles = F.explode(
        F.array(
            F.struct(F.lit("TRAINING").alias("partition"), F.col("train").alias("n")),
            F.struct(F.lit("VALIDATION").alias("partition"), F.col("kept").alias("n")),
        )
    )
    counts = (
        cells.withColumn("r", roles)
        .withColumn("t", _long_targets(scheme))
        .groupBy(
            "family", "fold", "project",
            F.col("r.partition").alias("partition"),
            F.col("t.task").alias("task"),
            F.col("t.class").alias("class"),
        )
        .agg(F.sum("r.n").alias("count"))
    )
    keys = (
        cells.select("family", "fold", "project")
        .distinct()
        .withColumn("partition", F.explode(F.array(F.lit("TRAINING"), F.lit("VALIDATION"))))
    )
    return _zero_filled(counts, keys, scheme)


def temporal_ranges(rows: DataFrame) -> DataFrame:
    """Project x partition: rows, earliest and latest time; empty partitions give zero."""
    return (
        rows.filter("membership <> 'REMOVED'")
        .groupBy(F.col("source_project").alias("project"), F.col("membership").alias("partition"))
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min("creation_time").alias("earliest"),
            F.max("creation_time").alias("latest"),
        )
    )


def holdout_chronology(rows: DataFrame) -> DataFrame:
    def when(condition: str) -> Column:
        return F.when(F.expr(condition), F.col("creation_time"))

    found = rows.groupBy(F.col("source_project").alias("project")).agg(
        F.max(when("block is not null")).alias("max_development"),
        F.min(when("block is null")).alias("min_candidate"),
        F.min(when("block is null and locked_reason is null")).alias("min_final"),
    )
    return found.withColumn(
        "candidate_chronology_valid", F.expr("max_development <= min_candidate")
    ).withColumn(
        "final_chronology_valid", F.expr("min_final is null or max_development <= min_final")
    )


def fold_chronology(rows: DataFrame) -> DataFrame:
    """Latest training time against earliest validation time, per fold and project."""
    blocks = (
        rows.filter("block is not null")
        .groupBy("source_project", "block")
        .agg(F.min("creation_time").alias("first"), F.max("creation_time").alias("last"))
    )
    found = (
        blocks.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(1, FOLDS + 1)])))
        .groupBy(F.col("fold").cast("long").alias("fold"), F.col("source_project").alias("project"))
        .agg(
            F.max(F.when(F.expr("block <= fold"), F.col("last"))).alias("max_training"),
            F.min(F.when(F.expr("block = fold + 1"), F.col("first"))).alias("min_validation"),
        )
    )
    return found.withColumn(
        "chronology_valid",
        F.expr("max_training is null or min_validation is null or max_training <= min_validation"),
    )


def overlap_proof(rows: DataFrame, links: DataFrame) -> DataFrame:
    """One row: hold-out candidates removed by reason and resolved links."""
    removed = rows.agg(
        F.count_if(F.col("locked_reason") == EXACT).alias("candidate_overlap_exact_text"),
        F.count_if(F.col("locked_reason") == LINKED).alias("candidate_overlap_explicit_dupe_link"),
        F.count("locked_reason").alias("duplicate_component_overlap_before_purge"),
    )
    resolved = links.agg(
        F.count_if(F.col("outcome") == "resolved").alias("resolved_explicit_dupe_edges")
    )
    both = removed.unionByName(resolved, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
