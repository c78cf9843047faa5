"""Orders as issues: label maps, chronological split, folds, class counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracefold.functions.ids import stable_id
from tracefold.functions.scores import class_index, percentage
from tracefold.operators import eligibility as E, fingerprints as P, split as S
from tracefold.protocol import PRIORITY
from tracefold.queries.registry import query, rounded, ts
from tracefold.queries.sql import SPLIT, STRUCTURED, TS, digest, ordered_digest, with_
from tracefold.sources import bindings as B

_SPLIT = with_(STRUCTURED, SPLIT)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.chronological_split(B.eligible_structured(spark, sf_dir))
    # Orders have no text, so nothing is purged.
    return S.final_partition(rows.withColumn("locked_reason", F.lit(None).cast("string")))


@query(
    "split_class_distribution",
    _SPLIT + """
, classes(task, class) as (values ('S4','1-URGENT'),('S4','2-HIGH'),('S4','3-MEDIUM'),('S4','5-LOW'),
   ('S3','HIGH'),('S3','MEDIUM'),('S3','LOW'),('S2','HIGH_IMPACT'),('S2','LOWER_IMPACT')),
long as (select partition, 'S4' as task, target_s4 as class from split union all
         select partition, 'S3', target_s3 from split union all
         select partition, 'S2', target_s2 from split)
select p.partition, c.task, c.class, count(l.class) as count
from (values ('DEVELOPMENT'), ('LOCKED_TEST')) p(partition) cross join classes c
left join long l on l.task = c.task and l.class = c.class
  and (case l.partition when 'DEVELOPMENT' then 'DEVELOPMENT' else 'LOCKED_TEST' end) = p.partition
group by 1, 2, 3
""",
)
def split_class_distribution(spark, sf_dir):
    return S.class_distribution(_split(spark, sf_dir), PRIORITY)


@query(
    "chronological_positions",
    _SPLIT + "select stable_id, position, project_rows, partition, cast(block as bigint) as block from split",
)
def chronological_positions(spark, sf_dir):
    rows = S.chronological_split(B.eligible_structured(spark, sf_dir))
    return rows.select(
        "stable_id", "position", "project_rows", "partition", F.col("block").cast("long").alias("block")
    )


@query(
    "position_blocks",
    _SPLIT + f"""
select source_project, cast(block as bigint) as block, count(*) as row_count,
  strftime(min(creation_time), {TS}) as earliest, strftime(max(creation_time), {TS}) as latest
from split group by 1, 2
""",
)
def position_blocks(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("source_project", F.col("block").cast("long").alias("block")).agg(
        F.count(F.lit(1)).alias("row_count"),
        ts(F.min("creation_time")).alias("earliest"),
        ts(F.max("creation_time")).alias("latest"),
    )


@query(
    "structured_population",
    with_(STRUCTURED) + """
select source_project as project, count(*) as raw_rows,
  sum((severity_raw <> '4-NOT SPECIFIED')::int)::bigint as eligible_rows,
  sum((severity_raw = '4-NOT SPECIFIED')::int)::bigint as excluded_label_rows,
  round(100.0 * sum((severity_raw = '4-NOT SPECIFIED')::int) / count(*), 8) as excluded_percentage
from issues group by 1
""",
)
def structured_population(spark, sf_dir):
    rows = B.structured_issues(spark, sf_dir)
    excluded = F.count_if(F.col("severity_raw").isin(*PRIORITY.excluded))
    total = F.count(F.lit(1))
    return rows.groupBy(F.col("source_project").alias("project")).agg(
        total.alias("raw_rows"),
        (total - excluded).alias("eligible_rows"),
        excluded.alias("excluded_label_rows"),
        percentage(excluded, total).alias("excluded_percentage"),
    )


@query(
    "label_targets",
    with_(STRUCTURED) + """
select stable_id, target_s3, target_s2,
  case target_s3 when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end::bigint as s3_index,
  case target_s2 when 'HIGH_IMPACT' then 0 else 1 end::bigint as s2_index
from eligible
""",
)
def label_targets(spark, sf_dir):
    rows = B.eligible_structured(spark, sf_dir)
    return rows.select(
        "stable_id", "target_s3", "target_s2",
        class_index(F.col("target_s3"), PRIORITY.orders["S3"]).alias("s3_index"),
        class_index(F.col("target_s2"), PRIORITY.orders["S2"]).alias("s2_index"),
    )


@query(
    "target_mapping_drift",
    with_(STRUCTURED) + """
select source_project, severity_raw, count(*) as drifted_rows from eligible
where target_s3 <> (case when num % 97 = 0 then 'LOW' else target_s3 end) group by 1, 2
""",
)
def target_mapping_drift(spark, sf_dir):
    """Stored coarse labels of every 97th order are overwritten; the rule must find them."""
    rows = B.eligible_structured(spark, sf_dir).withColumn(
        "target_s3",
        F.when(F.col("issue_id").cast("long") % 97 == 0, "LOW").otherwise(F.col("target_s3")),
    )
    return E.mapping_drift(rows, PRIORITY).groupBy("source_project", "severity_raw").agg(
        F.count(F.lit(1)).alias("drifted_rows")
    )


@query(
    "split_temporal_ranges",
    _SPLIT + f"""
select source_project as project,
  case partition when 'DEVELOPMENT' then 'DEVELOPMENT' else 'LOCKED_TEST' end as partition,
  count(*) as row_count, strftime(min(creation_time), {TS}) as earliest,
  strftime(max(creation_time), {TS}) as latest
from split group by 1, 2
""",
)
def split_temporal_ranges(spark, sf_dir):
    found = S.temporal_ranges(_split(spark, sf_dir))
    return found.withColumns({"earliest": ts("earliest"), "latest": ts("latest")})


@query(
    "holdout_chronology",
    _SPLIT + f"""
select source_project as project,
  strftime(max(creation_time) filter (block is not null), {TS}) as max_development,
  strftime(min(creation_time) filter (block is null), {TS}) as min_candidate,
  strftime(min(creation_time) filter (block is null), {TS}) as min_final,
  max(creation_time) filter (block is not null) <= min(creation_time) filter (block is null) as candidate_chronology_valid,
  max(creation_time) filter (block is not null) <= min(creation_time) filter (block is null) as final_chronology_valid
from split group by 1
""",
)
def holdout_chronology(spark, sf_dir):
    found = S.holdout_chronology(_split(spark, sf_dir))
    return found.withColumns({c: ts(c) for c in ("max_development", "min_candidate", "min_final")})


@query(
    "fold_chronology",
    _SPLIT + f"""
, f(fold) as (values (1), (2), (3)),
x as (select fold, source_project, max(creation_time) filter (block <= fold) as a,
        min(creation_time) filter (block = fold + 1) as b
      from split, f where block is not null group by 1, 2)
select cast(fold as bigint) as fold, source_project as project, strftime(a, {TS}) as max_training,
  strftime(b, {TS}) as min_validation, (a is null or b is null or a <= b) as chronology_valid
from x
""",
)
def fold_chronology(spark, sf_dir):
    found = S.fold_chronology(_split(spark, sf_dir))
    return found.withColumns({c: ts(c) for c in ("max_training", "min_validation")})


@query(
    "split_membership_digests",
    _SPLIT + digest("stable_id", "split", "partition"),
)
def split_membership_digests(spark, sf_dir):
    rows = S.chronological_split(B.eligible_structured(spark, sf_dir))
    return P.membership_digest(rows, F.col("stable_id"), ["partition"])


@query(
    "ordered_membership_digests",
    _SPLIT + ordered_digest("stable_id", "stable_id", "split", "partition"),
)
def ordered_membership_digests(spark, sf_dir):
    rows = S.chronological_split(B.eligible_structured(spark, sf_dir))
    return P.ordered_memberships(rows, ["partition"])


@query(
    "event_timeline_split",
    """
with r as (select event_type as source_project, event_id, ts, value,
   row_number() over (partition by event_type order by ts, event_id) - 1 as position,
   count(*) over (partition by event_type) as n from events)
select source_project, case when position < n * 4 // 5 then 'DEVELOPMENT' else 'LOCKED_CANDIDATE' end as partition,
  count(*) as row_count, round(sum(value), 4) as total_value,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') as earliest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as latest
from r group by 1, 2
""",
)
def event_timeline_split(spark, sf_dir):
    rows = S.chronological_split(B.event_rows(spark, sf_dir))
    found = rows.groupBy("source_project", "partition").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("value").alias("total_value"),
        ts(F.min("creation_time")).alias("earliest"),
        ts(F.max("creation_time")).alias("latest"),
    )
    return rounded(found, 4)


@query(
    "stable_ids",
    with_(STRUCTURED) + "select source_project, count(distinct stable_id) as ids, min(stable_id) as first_id from issues group by 1",
)
def stable_ids(spark, sf_dir):
    rows = B.structured_issues(spark, sf_dir).withColumn(
        "stable_id", stable_id(F.col("source_project"), F.col("issue_id"))
    )
    per_id = rows.groupBy("source_project", "stable_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy("source_project").agg(
        F.count(F.lit(1)).alias("ids"), F.min("stable_id").alias("first_id")
    )
