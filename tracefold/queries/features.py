"""TF-IDF features, fusion with dense vectors, vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracefold.operators import features as X, fingerprints as P, memberships as H, vectors as V
from tracefold.queries.registry import query, rounded
from tracefold.queries.samples import documents
from tracefold.queries.sql import TEXT, digest, with_
from tracefold.session import materialize
from tracefold.sources import bindings as B
from tracefold.sources.stores import shard_manifest

(WORDS,), (CHARS,), (UNION_WORDS, UNION_CHARS) = X.WORD, X.CHAR, X.WORD_CHAR


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(training, validation): sources ending in an even or odd digit."""
    docs = documents(spark, sf_dir)
    even = F.substring("source_project", -1, 1).isin("0", "2", "4", "6", "8")
    return docs.filter(even), docs.filter(~even)


_WORDS = """
docs as (select stable_id, source_project, text_combined as text, source_project[-1] in ('0', '2', '4', '6', '8') as train from eligible),
tok as (select stable_id, train, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') as t from docs),
word_grams as (select stable_id, train, unnest(t) as term from tok union all
  select stable_id, train, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) from tok),
word_tf as (select stable_id, train, term, count(*) as tf from word_grams group by all)
"""

_CHARS = """
words as (select stable_id, train, word, count(*) as n from (
    select stable_id, train, unnest(regexp_split_to_array(lower(text), '\\s+')) as word from docs) where word <> '' group by all),
padded as (select stable_id, train, n, ' ' || word || ' ' as p from words),
char_grams as (select stable_id, train, n, p[i : i + g - 1] as term
  from padded, (values (3), (4), (5)) k(g), unnest(range(1, length(p) - g + 2)) u(i) where length(p) >= g),
char_tf as (select stable_id, train, term, sum(n)::bigint as tf from char_grams group by 1, 2, 3)
"""


def _vocabulary(tf: str, cap: int, name: str) -> str:
    return f"""
{name} as (select term, count(*) as df, sum(tf)::bigint as total,
    ln((1.0 + (select count(*) from docs where train)) / (1.0 + count(*))) + 1 as idf
  from {tf} where train group by term having count(*) >= 2 order by total desc, term limit {cap})
"""


def _weights(tf: str, vocabulary: str, name: str) -> str:
    return f"""
{name} as (select stable_id, train, term, w / sqrt(sum(w * w) over (partition by stable_id)) as weight from (
    select stable_id, train, term, (1 + ln(tf)) * idf as w from {tf} join {vocabulary} using (term)))
"""


_SUMMARY = """
select stable_id, count(*) as terms, round(sum(weight), 6) as weight_sum, round(sum(weight * weight), 6) as squared_norm,
  round(max(weight), 6) as weight_max, sum(length(term))::bigint as term_characters from {w} {where} group by 1
"""


def _summarize(weights: DataFrame) -> DataFrame:
    return rounded(
        weights.groupBy("stable_id").agg(
            F.count(F.lit(1)).alias("terms"),
            F.sum("weight").alias("weight_sum"),
            F.sum(F.col("weight") * F.col("weight")).alias("squared_norm"),
            F.max("weight").alias("weight_max"),
            F.sum(F.length("term").cast("long")).alias("term_characters"),
        ),
        6,
    )


@query(
    "word_vocabulary",
    with_(TEXT, _WORDS, _vocabulary("word_tf", 150_000, "vocab")) + "select term, df, total, round(idf, 6) as idf from vocab",
)
def word_vocabulary(spark, sf_dir):
    train, _ = _parts(spark, sf_dir)
    return rounded(X.fit_vocabulary(train, WORDS).drop("term_index"), 6)


@query(
    "char_vocabulary",
    with_(TEXT, _WORDS, _CHARS, _vocabulary("char_tf", 150_000, "vocab")) + "select term, df, total, round(idf, 6) as idf from vocab",
)
def char_vocabulary(spark, sf_dir):
    train, _ = _parts(spark, sf_dir)
    return rounded(X.fit_vocabulary(train, CHARS).drop("term_index"), 6)


@query(
    "word_tfidf_training",
    with_(TEXT, _WORDS, _vocabulary("word_tf", 150_000, "vocab"), _weights("word_tf", "vocab", "w")) + _SUMMARY.format(w="w", where="where train"),
)
def word_tfidf_training(spark, sf_dir):
    train, _ = _parts(spark, sf_dir)
    return _summarize(X.fit_features(train, (WORDS,)).transform(train))


@query(
    "word_tfidf_validation",
    with_(TEXT, _WORDS, _vocabulary("word_tf", 150_000, "vocab"), _weights("word_tf", "vocab", "w")) + _SUMMARY.format(w="w", where="where not train"),
)
def word_tfidf_validation(spark, sf_dir):
    train, validation = _parts(spark, sf_dir)
    return _summarize(X.fit_features(train, (WORDS,)).transform(validation))


@query(
    "char_tfidf_validation",
    with_(TEXT, _WORDS, _CHARS, _vocabulary("char_tf", 150_000, "vocab"), _weights("char_tf", "vocab", "w")) + _SUMMARY.format(w="w", where="where not train"),
)
def char_tfidf_validation(spark, sf_dir):
    train, validation = _parts(spark, sf_dir)
    return _summarize(X.fit_features(train, (CHARS,)).transform(validation))


@query(
    "union_tfidf_validation",
    with_(TEXT, _WORDS, _CHARS, _vocabulary("word_tf", 75_000, "wv"), _vocabulary("char_tf", 75_000, "cv"),
          _weights("word_tf", "wv", "ww"), _weights("char_tf", "cv", "cw"),
          "both_blocks as (select * from ww union all select * from cw)") + _SUMMARY.format(w="both_blocks", where="where not train"),
)
def union_tfidf_validation(spark, sf_dir):
    train, validation = _parts(spark, sf_dir)
    return _summarize(X.fit_features(train, (UNION_WORDS, UNION_CHARS)).transform(validation))


@query(
    "lexical_dense_fusion",
    with_(TEXT, _WORDS, _vocabulary("word_tf", 75_000, "vocab"), _weights("word_tf", "vocab", "w"),
          "long as (select stable_id, weight from w union all select 'src' || (vec_id % 20) || ':' || vec_id, unnest(embedding)::double from embeddings)") + """
select stable_id, count(*) as features, round(sum(weight * weight), 4) as squared_norm from long
where stable_id in (select stable_id from eligible) group by 1
""",
)
def lexical_dense_fusion(spark, sf_dir):
    """Word block plus the vector of the document with the same number."""
    docs = documents(spark, sf_dir)
    train, _ = _parts(spark, sf_dir)
    fitted = X.fit_features(train, (UNION_WORDS,))
    dense = B.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("src"), (F.col("vec_id") % 20).cast("string"), F.lit(":"), F.col("vec_id").cast("string")).alias("stable_id"),
        "embedding",
    ).join(docs.select("stable_id"), "stable_id", "left_semi")
    fused = X.fuse_long(fitted.transform(docs), dense, fitted.width)
    return rounded(
        fused.groupBy("stable_id").agg(
            F.count(F.lit(1)).alias("features"),
            F.sum(F.col("weight") * F.col("weight")).alias("squared_norm"),
        ),
        4,
    )


_BROKEN = """
broken as (select vec_id, 'L' || label as source_project, 'L' || label || ':' || vec_id as stable_id,
  case when vec_id % 11 = 0 then list_transform(embedding, lambda x: x * 2)
       when vec_id % 7 = 0 then embedding[1:63]
       when vec_id % 5 = 0 then list_transform(embedding, lambda x: 'nan'::float) else embedding end as embedding from embeddings)
"""


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return B.vectors(spark, sf_dir).withColumn(
        "embedding",
        F.when(F.col("vec_id") % 11 == 0, F.transform(e, lambda x: (x * 2).cast("float")))
        .when(F.col("vec_id") % 7 == 0, F.slice(e, 1, 63))
        .when(F.col("vec_id") % 5 == 0, F.transform(e, lambda x: F.lit(float("nan")).cast("float")))
        .otherwise(e),
    )


@query(
    "vector_rule_violations",
    with_(_BROKEN) + """
select stable_id, case when vec_id % 11 = 0 then 'norm' when vec_id % 7 = 0 then 'dimension' else 'non_finite' end as rule
from broken where vec_id % 11 = 0 or vec_id % 7 = 0 or vec_id % 5 = 0
""",
)
def vector_rule_violations(spark, sf_dir):
    return V.vector_violations(_broken(spark, sf_dir), 64).select("stable_id", "rule")


@query(
    "vector_normalization",
    """
with x as (select label, vec_id, list_transform(embedding, lambda v: v::double * (vec_id + 1)) as e from embeddings)
, u as (select label, vec_id, list_transform(e, lambda v: v / sqrt(list_sum(list_transform(e, lambda w: w * w)))) as e from x),
c as (select label, unnest(e) as v, unnest(range(1, len(e) + 1)) as i from u)
select label, (count(*) filter (i = 1)) as vectors, round(sum(v), 4) as component_sum, round(sum(v * i), 2) as weighted_sum from c group by 1
""",
)
def vector_normalization(spark, sf_dir):
    scaled = B.vectors(spark, sf_dir).withColumn(
        "embedding",
        F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1)),
    )
    unit = V.normalize_vectors(scaled).select("label", F.posexplode("embedding").alias("i", "v"))
    value = F.col("v").cast("double")
    return unit.groupBy("label").agg(
        F.count_if(F.col("i") == 0).alias("vectors"),
        F.round(F.sum(value), 4).alias("component_sum"),
        F.round(F.sum(value * (F.col("i") + 1)), 2).alias("weighted_sum"),
    )


@query(
    "chunk_vector_pooling",
    """
with d as (select vec_id // 5 as doc, unnest(embedding)::double as v, unnest(range(0, 64)) as i from embeddings),
m as (select doc, i, avg(v) as v from d group by 1, 2),
n as (select doc, sqrt(sum(v * v)) as norm from m group by 1)
select doc, round(sum(v / norm), 4) as component_sum, round(sum(v / norm * (i + 1)), 2) as weighted_sum from m join n using (doc) group by 1
""",
)
def chunk_vector_pooling(spark, sf_dir):
    chunks = B.table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("doc"), "embedding")
    pooled = V.mean_pool(chunks, "doc")
    parts = pooled.select("doc", F.posexplode("embedding").alias("i", "v"))
    value = F.col("v").cast("double")
    return parts.groupBy("doc").agg(
        F.round(F.sum(value), 4).alias("component_sum"), F.round(F.sum(value * (F.col("i") + 1)), 2).alias("weighted_sum")
    )


@query(
    "embedding_lookup",
    """
with c as (select d.source as source_project, unnest(e.embedding)::double as v, unnest(range(1, 65)) as i
  from documents d join embeddings e on d.doc_id = e.vec_id)
select source_project, (count(*) filter (i = 1)) as rows, round(sum(v), 4) as component_sum, round(sum(v * i), 2) as weighted_sum from c group by 1
""",
)
def embedding_lookup(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("source_project"))
    found = docs.join(B.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    parts = found.select("source_project", F.posexplode("embedding").alias("i", "v"))
    value = F.col("v").cast("double")
    return parts.groupBy("source_project").agg(
        F.count_if(F.col("i") == 0).alias("rows"),
        F.round(F.sum(value), 4).alias("component_sum"),
        F.round(F.sum(value * (F.col("i") + 1)), 2).alias("weighted_sum"),
    )


@query(
    "vector_shard_manifest",
    "with v as (select 'L' || label as project, 'L' || label || ':' || vec_id as id from embeddings) "
    "select project, row_count, fingerprint as membership_sha256, 'hash' as encoder_id, 64::bigint as embedding_dimension from ("
    + digest("id", "v", "project") + ")",
)
def vector_shard_manifest(spark, sf_dir):
    made = shard_manifest(B.vectors(spark, sf_dir), {"encoder_id": "hash", "embedding_dimension": 64})
    return made.withColumn("embedding_dimension", F.col("embedding_dimension").cast("long"))


@query(
    "vector_shard_check_failures",
    """
select 'L' || label as project, 'row_count_matches' as "check" from embeddings where label = 3 group by label
union all select 'L' || label, 'vectors_valid' from embeddings where label in (3, 4) group by label
union all select 'L' || label, 'encoder_id_matches' from embeddings where label = 5 group by label
""",
)
def vector_shard_check_failures(spark, sf_dir):
    """Shard records off by one row for L3, of another encoder for L5; bad vectors in L3, L4."""
    shards = B.vectors(spark, sf_dir).withColumn(
        "embedding",
        F.when(F.col("label").isin(3, 4), F.slice("embedding", 1, 32)).otherwise(F.col("embedding")),
    )
    stored = shard_manifest(shards, {"encoder_id": "hash", "embedding_dimension": 64}).withColumns(
        {
            "row_count": F.col("row_count") + (F.col("project") == "L3").cast("long"),
            "encoder_id": F.when(F.col("project") == "L5", "other").otherwise(F.col("encoder_id")),
        }
    )
    stored = materialize(stored, "sidecars")
    checked = H.shard_checks(stored, shards, {"encoder_id": "hash", "embedding_dimension": 64})
    return H.failing_checks(checked, ["project"])


@query(
    "cache_membership_differences",
    """
select cast(doc_id as varchar) as stable_id, 'left_only' as side from documents where doc_id not in (select doc_id from labels)
""",
)
def cache_membership_differences(spark, sf_dir):
    """Documents against labelled documents."""
    left = B.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stable_id"))
    right = B.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("stable_id"))
    return H.set_differences(left, right)


@query(
    "repeated_cache_members",
    "select cast(conv_id as varchar) as stable_id, count(*) as copies from conversations group by 1 having count(*) > 1",
)
def repeated_cache_members(spark, sf_dir):
    turns = B.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("stable_id"))
    return H.repeated_members(turns)


@query(
    "dataset_and_cache_fingerprints",
    """
with a as (select source as artifact, sha256(cast(count(*) as varchar) || ':' || max(n_chars)) as sha from documents group by 1)
select 'dataset' as kind, count(*) as artifacts, sha256(string_agg(artifact || ':' || sha, chr(10) order by artifact || ':' || sha)) as fingerprint from a
union all
select 'cache', count(*), sha256('[' || string_agg('["' || artifact || '","' || sha || '"]', ',' order by artifact) || ']') from a
""",
)
def dataset_and_cache_fingerprints(spark, sf_dir):
    artifacts = materialize(
        B.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("artifact")).agg(
            F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.max("n_chars").cast("string")), 256).alias("sha256")
        ),
        "artifacts",
    )
    return P.dataset_fingerprint(artifacts).withColumn("kind", F.lit("dataset")).unionByName(
        P.cache_identity(artifacts).withColumn("kind", F.lit("cache"))
    )


@query(
    "fingerprint_comparison",
    "with v as (select source as artifact, cast(doc_id as varchar) as id from documents) "
    "select artifact, row_count, fingerprint as actual_fingerprint, case when artifact = 'src4' then 'drifted' else fingerprint end as expected_fingerprint, "
    "case when artifact = 'src4' then 'MISMATCH' else 'MATCH' end as status from (" + digest("id", "v", "artifact") + ")",
)
def fingerprint_comparison(spark, sf_dir):
    ids = B.table(spark, sf_dir, "documents").select(
        F.col("source").alias("artifact"), F.col("doc_id").cast("string").alias("stable_id")
    )
    actual = materialize(P.membership_digest(ids, F.col("stable_id"), ["artifact"]), "digests")
    stored = actual.select(
        "artifact",
        F.when(F.col("artifact") == "src4", "drifted").otherwise(F.col("fingerprint")).alias("fingerprint"),
    )
    return P.compare_fingerprints(stored, actual, ["artifact"])


@query("hashed_document_vectors")
def hashed_document_vectors(spark, sf_dir):
    """Every document encoded by the hashing encoder; pooled over its token windows."""
    docs = documents(spark, sf_dir).select("stable_id", "text")
    return V.encode_long_documents(docs, V.hashing_encoder(32))


@query(
    "pending_vectors",
    "select source || ':' || doc_id as stable_id from documents where doc_id % 3 <> 0",
)
def pending_vectors(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select(
        F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("stable_id"), "doc_id"
    )
    return V.pending_documents(docs, docs.filter(F.col("doc_id") % 3 == 0)).drop("doc_id")
