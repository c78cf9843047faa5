"""Samples, budgets, batches, token windows and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracefold.functions.windows import blank_split_tokens, chunk_count, chunk_windows
from tracefold.operators import sampling as S
from tracefold.protocol import PRIORITY, STUDY_SEED
from tracefold.queries.registry import query, rounded
from tracefold.queries.sql import STRUCTURED, TEXT, with_
from tracefold.sources import bindings as B

_TOKENS = """
tokens as (
  select source_project, stable_id, len(list_filter(regexp_split_to_array(text_combined, '\\s+'), lambda t: t <> '')) as n
  from eligible)
"""
_TEXT_TOKENS = with_(TEXT, _TOKENS)
_CHUNKS = "case when n <= 382 then 1 else 1 + ceil((n - 382) / 318) end::bigint"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stable_id, source_project and the combined text of every eligible document."""
    return B.eligible_text(spark, sf_dir).select(
        "stable_id", "source_project", F.col("text_combined").alias("text")
    )


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(blank_split_tokens(F.col("text"))).cast("long")
    return documents(spark, sf_dir).select("stable_id", "source_project", n.alias("n_tokens"))


@query(
    "hash_ranked_sample",
    with_(STRUCTURED) + """
select stable_id, substr(sha256('20260809|' || stable_id), 1, 16) as hash_rank from issues order by hash_rank, stable_id limit 500
""",
)
def hash_ranked_sample(spark, sf_dir):
    everything = B.structured_issues(spark, sf_dir).select(
        F.concat_ws(":", "source_project", "issue_id").alias("stable_id")
    )
    return S.smallest_ranks(everything, 500)


@query(
    "stratum_allocation",
    with_(STRUCTURED) + """
, c as (select target_s4 as label, count(*) as stratum_rows from eligible group by 1),
a as (select *, (777 * stratum_rows) // sum(stratum_rows) over () as f, (777 * stratum_rows) % sum(stratum_rows) over () as r from c)
select label, stratum_rows, (f + case when row_number() over (order by r desc, label) <= 777 - sum(f) over () then 1 else 0 end)::bigint as allocation from a
""",
)
def stratum_allocation(spark, sf_dir):
    return S.stratum_allocation(B.eligible_structured(spark, sf_dir), 777, "target_s4")


@query(
    "stratified_sample",
    with_(STRUCTURED) + """
, c as (select target_s4 as label, count(*) as n from eligible group by 1),
a as (select *, (777 * n) // sum(n) over () as f, (777 * n) % sum(n) over () as r from c),
q as (select label, f + case when row_number() over (order by r desc, label) <= 777 - sum(f) over () then 1 else 0 end as allocation from a),
k as (select stable_id, target_s4, row_number() over (partition by target_s4 order by substr(sha256('salt|' || stable_id), 1, 16), stable_id) as rn from eligible)
select stable_id, target_s4 from k join q on target_s4 = label where rn <= allocation
""",
)
def stratified_sample(spark, sf_dir):
    rows = B.eligible_structured(spark, sf_dir).select("stable_id", "target_s4")
    return S.stratified_sample(rows, 777, "target_s4", "salt")


@query(
    "chunk_budget_prefix",
    _TEXT_TOKENS + f"""
, c as (select stable_id, {_CHUNKS} as chunks, substr(sha256('20260809|' || stable_id), 1, 16) as hr from tokens),
r as (select *, sum(chunks) over (order by hr, stable_id rows between unbounded preceding and current row) as upto from c)
select stable_id, chunks, upto::bigint as chunks_through from r where upto - chunks < 400
""",
)
def chunk_budget_prefix(spark, sf_dir):
    from tracefold.functions.ids import hash_rank

    rows = _lengths(spark, sf_dir).select(
        "stable_id", chunk_count(F.col("n_tokens")).alias("chunks"),
        hash_rank(str(STUDY_SEED), F.col("stable_id")).alias("_rank"),
    )
    return S.prefix_until(rows, [F.col("_rank"), F.col("stable_id")], "chunks", 400).drop("_rank")


@query(
    "length_batches",
    _TEXT_TOKENS + """
, r as (select stable_id, row_number() over (order by n, substr(sha256('20260809|1|' || stable_id), 1, 16), stable_id) - 1 as position from tokens)
select stable_id, position, position // 32 as batch, substr(sha256('20260809|1|batch|' || (position // 32)), 1, 16) as batch_rank from r
""",
)
def length_batches(spark, sf_dir):
    rows = _lengths(spark, sf_dir).select("stable_id", "n_tokens")
    return S.length_batches(rows, "n_tokens", 32, epoch=1).drop("n_tokens")


@query(
    "bounded_slice",
    with_(STRUCTURED) + "select stable_id from eligible order by stable_id limit 200",
)
def bounded_slice(spark, sf_dir):
    return S.bounded_slice(B.eligible_structured(spark, sf_dir).select("stable_id"), 200)


@query(
    "covering_slice",
    with_(STRUCTURED) + """
, f as (select target_s4, min(stable_id) as first_id from eligible group by 1)
select stable_id, target_s4 from eligible join f using (target_s4)
order by case when stable_id = first_id then list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'], target_s4) else 99 end, stable_id limit 50
""",
)
def covering_slice(spark, sf_dir):
    rows = B.eligible_structured(spark, sf_dir).select("stable_id", "target_s4")
    return S.covering_slice(rows, 50, "target_s4", PRIORITY.orders["S4"])


@query(
    "token_windows",
    with_(TEXT) + f"""
, t as (select stable_id, list_filter(regexp_split_to_array(text_combined, '\\s+'), lambda t: t <> '') as tok from eligible),
c as (select *, case when len(tok) <= 382 then 1 else 1 + ceil((len(tok) - 382) / 318) end::bigint as k from t),
w as (select stable_id, i as chunk, tok[i * 318 + 1 : i * 318 + 382] as win from c, unnest(range(0, k)) u(i))
select stable_id, chunk, len(win) as tokens, win[1] as first_token, win[-1] as last_token from w
""",
)
def token_windows(spark, sf_dir):
    tokens = documents(spark, sf_dir).select("stable_id", blank_split_tokens(F.col("text")).alias("t"))
    windows = tokens.select("stable_id", F.posexplode(chunk_windows(F.col("t"))).alias("chunk", "w"))
    return windows.select(
        "stable_id", F.col("chunk").cast("long").alias("chunk"),
        F.size("w").cast("long").alias("tokens"),
        F.get("w", F.lit(0)).alias("first_token"),
        F.get("w", F.size("w") - 1).alias("last_token"),
    )


@query(
    "chunk_audit",
    _TEXT_TOKENS + f"""
, c as (select source_project, {_CHUNKS} as k from tokens),
x as (select source_project as project, k from c union all select 'ALL', k from c)
select project, count(*) as total_records, (count(*) filter (k = 1)) as one_chunk, (count(*) filter (k = 2)) as two_chunks,
  (count(*) filter (k = 3)) as three_chunks, (count(*) filter (k = 4)) as four_chunks, (count(*) filter (k = 5)) as five_chunks,
  (count(*) filter (k > 5)) as over_five_chunks, sum(k)::bigint as total_chunks, round(avg(k), 8) as mean_chunks,
  round(median(k), 8) as median_chunks, max(k) as maximum_chunks, (sum(k) - count(*))::bigint as additional_chunks
from x group by 1
""",
)
def chunk_audit(spark, sf_dir):
    counted = S.length_counts(_lengths(spark, sf_dir), F.col("n_tokens"))
    return rounded(S.chunk_audit(counted))


@query(
    "token_length_audit",
    _TEXT_TOKENS + """
, x as (select source_project as project, n from tokens union all select 'ALL', n from tokens)
select project, count(*) as development_records, (count(*) filter (n <= 384)) as fits_without_truncation,
  (count(*) filter (n > 384)) as requires_truncation, round((count(*) filter (n > 384)) / count(*) * 100, 8) as truncation_percentage,
  min(n) as minimum_tokens, round(avg(n), 8) as mean_tokens, round(median(n), 8) as median_tokens, max(n) as maximum_tokens
from x group by 1
""",
)
def token_length_audit(spark, sf_dir):
    counted = S.length_counts(_lengths(spark, sf_dir), F.col("n_tokens"))
    return rounded(S.token_length_audit(counted, 384))


@query(
    "token_length_percentiles",
    _TEXT_TOKENS + """
select round(quantile_cont(n, 0.9), 6) as p90_tokens, round(quantile_cont(n, 0.95), 6) as p95_tokens, round(quantile_cont(n, 0.99), 6) as p99_tokens from tokens
""",
)
def token_length_percentiles(spark, sf_dir):
    counted = S.length_counts(_lengths(spark, sf_dir), F.col("n_tokens"))
    return rounded(S.length_percentiles(counted), 6)


@query(
    "class_weights",
    with_(STRUCTURED) + """
, c as (select target_s3 as class, count(*) as n from eligible group by 1),
w as (select class, n, sum(n) over () / (3 * n) as weight from c)
select class, n, round(weight, 8) as weight, round(weight / avg(weight) over (), 8) as weight_mean_one from w
""",
)
def class_weights(spark, sf_dir):
    rows = B.eligible_structured(spark, sf_dir)
    return rounded(S.balanced_weights(rows, "target_s3", PRIORITY.orders["S3"]))
