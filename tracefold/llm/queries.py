"""Queries of the operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracefold.llm.registry import query, table


def remainder(divisor: int):
    return F.crc32(F.col("doc_id").cast("string")) % divisor


@query("op1_personal_data")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.pii import KINDS, find, spelled

    def count(number: int):
        return F.size(F.filter("base", lambda x: x["kind"] == number)).cast("long")

    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.array_union("base", "more")).alias("spans"),
    )


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    network = fit(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    return score(docs, network).select(
        "doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted"
    )


@query("op3_benchmark_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least=1).select(
        "doc_id", "lines_removed", F.length("text").cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


@query("op6_media_columns")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


@query("op7_minhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_suffix_array_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted"
    )


OP10_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(doc_id::varchar) as o
  from documents),
summed as (
  select *, sum(size) over (partition by source)::bigint as source_size,
         (sum(size) over (partition by source order by o, doc_id, size rows unbounded preceding) - size)::bigint as pos
  from sized),
sources as (
  select source, source_size, 3.0::double * source_size as cap,
         ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w,
         row_number() over (order by source nulls last) - 1 as nth
  from (select distinct source, source_size from summed)),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, nth rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, nth rows between current row and unbounded following) as level
  from sources),
fixed as (select level from levels where cap >= level * w order by cap / w, nth limit 1),
goals as (
  select source, least(cap, w * (select level from fixed))::double as target, source_size, ([-0.6, 0.0, 0.6])[nth % 3 + 1]::double as tilt
  from levels),
wanted as (
  select s.doc_id, s.size, s.source_size, g.target, s.pos, round(g.target)::bigint as total, g.tilt
  from summed s join goals g on s.source is not distinct from g.source),
taken as (
  select *, (case when source_size > 0 then (total // source_size) * size
    + greatest(0, least(size, total - (total // source_size) * source_size - pos)) else 0 end)::bigint as taken,
    least(1.0::double, pos::double / greatest(target, 1e-9)) as share
  from wanted)
select doc_id, size, source_size, target, taken, case when taken > 0 then round(
    case when tilt = 0 then share else 2 * share / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share)) end, 9) end as position
from taken
"""


@query("op10_source_mixing", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.mixing import mix, position_of

    first = F.when(F.col("taken") > 0, position_of(F.col("offset").cast("double"), F.col("target"), F.col("tilt")))
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", F.round(first, 9).alias("position")
    ).orderBy("position", "doc_id")


OP11_SQL = r"""
with split as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
starts as (
  select doc_id, words, unnest(range(1, len(words) - 18)) as i from split where len(words) >= 20),
windows as (
  select doc_id, i, first_value(doc_id) over w as first_doc, first_value(i) over w as first_i
  from (select doc_id, i, array_to_string(words[i:i + 19], ' ') as window_words from starts)
  window w as (partition by window_words order by doc_id, i)),
late as (select doc_id, i from windows where first_doc < doc_id or (first_doc = doc_id and first_i < i)),
gone as (
  select distinct doc_id, unnest(range(i, i + 20)) as i from late),
each_word as (
  select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from split),
marked as (
  select w.doc_id, w.i, w.word, g.i is not null as removed
  from each_word w left join gone g on g.doc_id = w.doc_id and g.i = w.i)
select s.doc_id, len(s.words)::bigint as n_words, coalesce(m.n_removed, 0)::bigint as n_removed,
       sha256(coalesce(m.kept, '')) as kept_sha256
from split s left join (
  select doc_id, count(*) filter (where removed) as n_removed, string_agg(word, ' ' order by i) filter (where not removed) as kept
  from marked group by doc_id) m on m.doc_id = s.doc_id
"""


@query("op11_substring_dedup", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.passages import remove_passages

    return remove_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


OP12_SQL = """
with rows_ as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, x -> floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, x -> x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, r.vec_id, r.label = a.label as same, list_inner_product(a.v, r.v)::bigint as score
  from rows_ a join rows_ r on r.vec_id <> a.vec_id where a.vec_id % 50 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id,
       (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id))::int as rank,
       s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
  and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) <= 3
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.negatives import hard_negatives, quantized

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), quantized(F.col("embedding"), 256).alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.periodic import periodic_runs

    def steeper_first(a, b):
        more, less = a["length"] * b["period"], b["length"] * a["period"]
        return (
            F.when(more != less, F.when(more > less, -1).otherwise(1))
            .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
            .otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))
        )

    best = F.get(F.array_sort("runs", steeper_first), 0)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
