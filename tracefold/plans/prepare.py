"""From raw rows to a frozen split: eligibility, duplicates, split, folds, fingerprints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tracefold.operators import (
    duplicates as D,
    eligibility as E,
    fingerprints as P,
    memberships as H,
    split as S,
)
from tracefold.protocol import IntegrityError, LabelScheme
from tracefold.session import materialize
from tracefold.sources import stores


@dataclass(frozen=True)
class PreparedSplit:
    """``rows``: text-free rows with components, blocks, purge reasons and membership."""

    rows: DataFrame
    links: DataFrame
    folds: DataFrame
    population: DataFrame


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text-free eligible rows -> (rows with purge reasons and membership, links).

    The duplicate graph spans all rows, held-out ones included.
    """
    links = materialize(D.resolve_links(rows), "links")
    placed = S.chronological_split(D.with_components(rows, links))
    return materialize(S.final_partition(S.purge_reasons(placed)), "split"), links


def prepare(
    raw: DataFrame,
    scheme: LabelScheme,
    *,
    processed: str | None = None,
    development: str | None = None,
    locked: str | None = None,
    manifests: str | None = None,
    expected: dict[str, int] | None = None,
) -> PreparedSplit:
    """Run the whole preparation and, where paths are given, publish its tables.

    ``expected`` may freeze ``raw_rows`` and ``eligible_rows``.  Any violation stops the
    job before something is published.
    """
    problems = scheme.problems()
    if problems:
        raise IntegrityError(f"label scheme: {problems}")
    statused = E.row_status(raw, scheme)
    E.require_empty(E.row_violations(statused), "rows that cannot be prepared")
    E.require_empty(E.repeated_ids(raw), "repeated issue ids")
    population = materialize(E.population(statused), "population")
    if expected:
        totals = population.agg(F.sum("raw_rows"), F.sum("eligible_rows")).first()
        found = {"raw_rows": totals[0], "eligible_rows": totals[1]}
        drift = {k: (v, found[k]) for k, v in expected.items() if found[k] != v}
        if drift:
            raise IntegrityError(f"population drift (expected, found): {drift}")

    eligible = E.eligible_rows(statused, scheme).withColumn(
        "source_record_number", F.col("record_number")
    )
    if "source_relative_path" not in eligible.columns:
        eligible = eligible.withColumn("source_relative_path", F.lit(""))
    if processed or development:
        eligible = materialize(eligible, "eligible")
    narrow = materialize(
        eligible.select("stable_id", *stores.SPLIT_COLUMNS), "eligible-narrow"
    )
    rows, links = split_rows(narrow)
    require_clean_split(rows)
    folds = S.fold_memberships(rows)
    if processed:
        stores.write_processed(eligible, processed)
    if manifests:
        stores.write_memberships(folds, manifests)
    if development and locked:
        stores.write_split(eligible, rows, development, locked)
    return PreparedSplit(rows, links, folds, population)


def require_clean_split(rows: DataFrame) -> None:
    """No component on both sides, and time never runs backwards across a boundary."""
    development = rows.filter("membership = 'DEVELOPMENT'")
    final = rows.filter("membership = 'LOCKED_TEST'")
    E.require_empty(H.component_overlap(development, final), "held-out duplicates of development rows")
    E.require_empty(
        S.holdout_chronology(rows).filter("not candidate_chronology_valid or not final_chronology_valid"),
        "held-out rows older than development",
    )
    E.require_empty(S.fold_chronology(rows).filter("not chronology_valid"), "fold chronology")


def fingerprints(split: PreparedSplit) -> DataFrame:
    """(artifact, row_count, fingerprint) of every membership the split produced."""
    sides = P.membership_digest(split.rows, F.col("stable_id"), ["membership"]).select(
        F.lower("membership").alias("artifact"), "row_count", "fingerprint"
    )
    candidates = P.membership_digest(
        split.rows.filter("block is null"), F.col("stable_id")
    ).select(F.lit("locked_candidates").alias("artifact"), "row_count", "fingerprint")
    folds = P.membership_digest(split.folds, F.col("stable_id"), ["family", "fold", "role"]).select(
        F.concat_ws("_", "family", F.lit("fold"), "fold", F.lower("role")).alias("artifact"),
        "row_count", "fingerprint",
    )
    return sides.unionByName(candidates).unionByName(folds)


def regenerate_folds(
    stored_rows: DataFrame, frozen: DataFrame, frozen_sizes: DataFrame, manifests: str
) -> DataFrame:
    """Rebuild all folds from stored rows, compare with frozen values, persist, re-read.

    ``frozen``: (artifact, fingerprint) of memberships; ``frozen_sizes``: the fold-size
    table.  Returns the fingerprint comparison, all MATCH.
    """
    narrow = materialize(stored_rows.select("stable_id", *stores.SPLIT_COLUMNS), "stored-narrow")
    rows, links = split_rows(narrow)
    split = PreparedSplit(rows, links, S.fold_memberships(rows), rows.limit(0))
    compared = materialize(
        P.compare_fingerprints(frozen, fingerprints(split), ["artifact"]), "comparison"
    )
    E.require_empty(compared.filter("status <> 'MATCH'"), "membership drift")
    measures = [c for c in frozen_sizes.columns if c not in ("family", "fold", "project")]
    sizes = P.compare_measures(frozen_sizes, S.fold_sizes(rows), ["family", "fold", "project"], measures)
    E.require_empty(sizes.filter("status <> 'MATCH'"), "fold size drift")
    rules = H.fold_violations(split.folds, rows)
    counted = [c for c in rules.columns if c not in ("family", "fold")]
    E.require_empty(rules.filter(" or ".join(f"{c} > 0" for c in counted)), "fold rules")
    stores.write_memberships(split.folds, manifests)
    written = P.membership_digest(
        rows.sparkSession.read.parquet(manifests), F.col("stable_id"), ["family", "fold", "role"]
    ).select(
        F.concat_ws("_", "family", F.lit("fold"), "fold", F.lower("role")).alias("artifact"),
        "row_count", "fingerprint",
    )
    wanted = frozen.join(written.select("artifact"), "artifact", "left_semi")
    E.require_empty(
        P.compare_fingerprints(wanted, written, ["artifact"]).filter("status <> 'MATCH'"),
        "persisted fold drift",
    )
    return compared
