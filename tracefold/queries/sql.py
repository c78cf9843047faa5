"""SQL fragments shared by the oracles: the corpora and the split, step by step."""

TS = "'%Y-%m-%d %H:%M:%S'"

STRUCTURED = """
issues as (
  select c_mktsegment as source_project, cast(o_orderkey as varchar) as issue_id,
         o_orderkey as num, c_mktsegment || ':' || o_orderkey as stable_id,
         o_orderdate as creation_time, o_orderpriority as severity_raw
  from orders join customer on o_custkey = c_custkey),
eligible as (
  select *, severity_raw as target_s4,
    case when severity_raw in ('1-URGENT', '2-HIGH') then 'HIGH'
         when severity_raw = '3-MEDIUM' then 'MEDIUM' else 'LOW' end as target_s3,
    case when severity_raw in ('1-URGENT', '2-HIGH') then 'HIGH_IMPACT'
         else 'LOWER_IMPACT' end as target_s2
  from issues where severity_raw <> '4-NOT SPECIFIED')
"""

TEXT = """
raw as (
  select source as source_project, doc_id + 1 as record_number,
    cast(doc_id as varchar) as issue_id, doc_id as num,
    case when doc_id % 23 = 0 then 'enhancement'
         when lang = 'en' then (['normal', 'minor', 'trivial'])[(doc_id % 3) + 1]
         else (['blocker', 'critical', 'major'])[(doc_id % 3) + 1] end as severity,
    timestamp '2020-01-01' + to_hours(cast((doc_id * 7919) % 100003 as integer)) as instant,
    split_part(text, chr(10), 1) as summary,
    substring(text, length(split_part(text, chr(10), 1)) + 2) as description,
    case when doc_id % 65 = 0 then cast(doc_id + 1000000000 as varchar)
         when doc_id % 39 = 0 then 'x?id=' || (doc_id - 17) || ' y?id=' || (doc_id - 18)
         when doc_id % 26 = 0 then 'https://tracker.example/show_bug.cgi?id=' || (doc_id - 17)
         when doc_id % 13 = 0 then ' ' || (doc_id - 17) || ' ' else '' end as dupe_of
  from documents),
eligible as (
  select source_project || ':' || issue_id as stable_id, source_project, issue_id, num,
    record_number, instant as creation_time, severity as severity_raw, summary, description,
    summary || chr(10) || chr(10) || description as text_combined, trim(dupe_of) as dupe_of,
    sha256(encode(nfc_normalize(summary)) || '\\x00'::blob || encode(nfc_normalize(description)))
      as exact_text_hash,
    severity as target_s6,
    case when severity in ('blocker', 'critical', 'major') then 'HIGH'
         when severity = 'normal' then 'MEDIUM' else 'LOW' end as target_s3,
    case when severity in ('blocker', 'critical', 'major') then 'HIGH_IMPACT'
         else 'LOWER_IMPACT' end as target_s2
  from raw where severity <> 'enhancement'
    and not (regexp_full_match(summary, '\\s*') and regexp_full_match(description, '\\s*')))
"""

LINKS = """
refs as (
  select *, case
      when dupe_of = '' then null
      when regexp_full_match(dupe_of, '\\s*\\d+\\s*') then trim(dupe_of)
      when len(list_distinct(regexp_extract_all(dupe_of, '(?i)(?:[?&](?:id|bug_id)=|show_bug\\.cgi\\?id=)(\\d+)', 1))) = 1
        then regexp_extract(dupe_of, '(?i)(?:[?&](?:id|bug_id)=|show_bug\\.cgi\\?id=)(\\d+)', 1)
      else '' end as reference
  from eligible),
targets as (
  select issue_id as reference, count(*) as matches, min(stable_id) as target_id,
         min(exact_text_hash) as target_hash
  from eligible group by 1),
links as (
  select r.stable_id, r.source_project, r.exact_text_hash, r.reference,
    case when r.reference = '' then 'malformed_or_ambiguous_reference'
         when t.matches is null then 'target_not_eligible_or_external'
         when t.matches > 1 then 'ambiguous_target'
         when t.target_id = r.stable_id then 'self_reference' else 'resolved' end as outcome,
    t.target_id, t.target_hash
  from refs r left join targets t on r.reference = t.reference
  where r.reference is not null)
"""

COMPONENTS = """
owners as (select exact_text_hash, min(stable_id) as owner, count(*) as n from eligible group by 1),
edges as (
  select a.owner as u, b.owner as v from links l
  join owners a on l.exact_text_hash = a.exact_text_hash
  join owners b on l.target_hash = b.exact_text_hash
  where l.outcome = 'resolved' and a.owner <> b.owner),
both_ways as (select u, v from edges union select v, u from edges),
reach(u, v) as (select u, v from both_ways union
  select r.u, b.v from reach r join both_ways b on r.v = b.u),
component_of as (
  select o.exact_text_hash, least(o.owner, coalesce(min(r.v), o.owner)) as component
  from owners o left join reach r on o.owner = r.u group by o.exact_text_hash, o.owner)
"""

SPLIT = """
ranked as (
  select *, row_number() over (partition by source_project order by creation_time, num) - 1 as position,
    count(*) over (partition by source_project) as project_rows
  from eligible),
split as (
  select *, project_rows * 4 // 5 as boundary,
    case when position < project_rows * 4 // 5 then 'DEVELOPMENT' else 'LOCKED_CANDIDATE' end as partition,
    case when position < project_rows * 4 // 5 then
      1 + (position >= (project_rows * 4 // 5) * 1 // 4)::int
        + (position >= (project_rows * 4 // 5) * 2 // 4)::int
        + (position >= (project_rows * 4 // 5) * 3 // 4)::int end as block
  from ranked)
"""

PURGE = """
parted as (select s.*, c.component from split s join component_of c using (exact_text_hash)),
seen as (
  select *,
    min(block) over (partition by component) as cb,
    min(block) over (partition by exact_text_hash) as hb,
    min(block) over (partition by source_project, component) as wcb,
    min(block) over (partition by source_project, exact_text_hash) as whb
  from parted),
purged as (
  select *,
    case when block is null and cb is not null then
      case when hb is not null then 'exact_text' else 'explicit_dupe_link' end end as locked_reason,
    case when block is not null and cb < block then
      case when hb < block then 'exact_text' else 'explicit_dupe_link' end end as pooled_reason,
    case when block is not null and wcb < block then
      case when whb < block then 'exact_text' else 'explicit_dupe_link' end end as within_reason
  from seen),
rows_final as (
  select *, case when block is not null then 'DEVELOPMENT'
                 when locked_reason is null then 'LOCKED_TEST' else 'REMOVED' end as membership
  from purged)
"""

MEMBERSHIPS = """
placed as (
  select p.*, f.fold, g.family, case when g.family = 'pooled' then pooled_reason else within_reason end as reason
  from purged p, (values (1), (2), (3)) f(fold), (values ('pooled'), ('within_project')) g(family)
  where block is not null),
memberships as (
  select family, cast(fold as bigint) as fold, case when block <= fold then 'TRAIN' else 'VALIDATION' end as role,
    source_project, issue_id, stable_id, creation_time, component
  from placed where block <= fold or (block = fold + 1 and reason is null))
"""

CLASSES = """
classes(task, class) as (values ('S6','blocker'),('S6','critical'),('S6','major'),('S6','normal'),
  ('S6','minor'),('S6','trivial'),('S3','HIGH'),('S3','MEDIUM'),('S3','LOW'),
  ('S2','HIGH_IMPACT'),('S2','LOWER_IMPACT'))
"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",".join(p.strip() for p in parts) + "\n"


TEXT_ROWS = with_(TEXT, LINKS, COMPONENTS, SPLIT, PURGE, recursive=True)


def digest(key: str, source: str, group: str = "") -> str:
    """Additive SHA-256 digest of ``key`` over ``source``."""
    limbs = ((1, 15), (16, 15), (31, 15), (46, 15), (61, 4))
    sums = " || '|' || ".join(
        f"cast(coalesce(sum(cast(('0x' || substr(h, {a}, {w})) as bigint)::hugeint), 0) as varchar)"
        for a, w in limbs
    )
    keys = f"{group}, " if group else ""
    by = f" group by {group}" if group else ""
    return (
        f"select {keys}count(*) as row_count, sha256(cast(count(*) as varchar) || '|' || {sums}) as fingerprint "
        f"from (select {keys}sha256({key}) as h from {source}){by}"
    )


def ordered_digest(line: str, order: str, source: str, group: str) -> str:
    """Digest of the lines in order: four levels of blocks of 65,536 lines or digests."""
    level = (
        f"select {group}, row_number() over (partition by {group} order by {order}) - 1 as n, "
        f"1 as row_count, {line} as line from {source}"
    )
    for _ in range(4):
        level = (
            f"select {group}, n // 65536 as n, sum(row_count)::bigint as row_count, "
            f"sha256(string_agg(line || chr(10), '' order by n)) as line from ({level}) group by {group}, n // 65536"
        )
    return f"select {group}, row_count, line as fingerprint from ({level})"
