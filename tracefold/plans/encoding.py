"""Vector cache of a corpus: encode what is missing, store by project, verify."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracefold.functions.ids import provenance_key
from tracefold.operators.eligibility import require_empty
from tracefold.operators.memberships import failing_checks, require_exact_membership, shard_checks
from tracefold.operators.vectors import (
    Encoder,
    encode_documents,
    encode_long_documents,
    pending_documents,
    vector_violations,
)
from tracefold.session import materialize
from tracefold.sources import stores


def build_cache(
    docs: DataFrame,
    encoder: Encoder,
    dimension: int,
    path: str,
    provenance: dict,
    *,
    long_documents: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(vectors, manifest) for docs (stable_id, source_project, issue_id, text).

    Documents whose vector is stored are not encoded again.  The finished cache must
    hold exactly the documents' ids and only unit vectors.
    """
    spark: SparkSession = docs.sparkSession
    stored = _existing(spark, path)
    todo = docs if stored is None else pending_documents(docs, stored)
    if long_documents:
        pooled = encode_long_documents(todo.select("stable_id", "text"), encoder)
        fresh = todo.select("stable_id", "source_project", "issue_id").join(pooled, "stable_id")
    else:
        fresh = encode_documents(todo.select("stable_id", "source_project", "issue_id", "text"), encoder)
    fresh = materialize(fresh, "vectors")
    require_empty(vector_violations(fresh, dimension).select("stable_id", "rule"), "bad vectors")
    stores.write_shards(fresh, path)
    vectors = stores.read_shards(spark, path)
    require_exact_membership(vectors, docs)
    identity = {"encoder_sha256": provenance_key(provenance), "embedding_dimension": dimension}
    return vectors, stores.shard_manifest(vectors, identity)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return stores.read_shards(spark, path) if fs.exists(target) else None


def verify_cache(vectors: DataFrame, manifest: DataFrame, provenance: dict, dimension: int) -> None:
    """Every stored shard record must describe the shard that is there."""
    expected = {"encoder_sha256": provenance_key(provenance), "embedding_dimension": dimension}
    checked = shard_checks(manifest, vectors, expected)
    require_empty(failing_checks(checked, ["project"]), "vector shards")
