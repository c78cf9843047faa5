"""Dense vectors: encoding with a pluggable encoder, pooling, validation."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from tracefold.functions.scores import l2_normalize, norm
from tracefold.functions.windows import blank_split_tokens, chunk_windows
from tracefold.protocol import CHUNK_LENGTH, CHUNK_STEP, NORM_TOLERANCE

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dimension: int = 64) -> Encoder:
    """Deterministic stand-in for a language model: signed token hashing, unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), dtype=np.float32)
        for row, text in enumerate(texts):
            for token in text.split() or [""]:
                h = zlib.crc32(token.encode("utf-8"))
                out[row, h % dimension] += 1.0 if h & 0x80000000 else -1.0
            if not out[row].any():
                out[row, 0] = 1.0
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    return encode


def encode_documents(
    docs: DataFrame, encoder: Encoder, *, text: str = "text", batch_rows: int = 64
) -> DataFrame:
    """Replace ``text`` by ``embedding``; other columns pass through.

    Batches halve when the encoder runs out of memory, down to one row.
    """
    keep = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)

    def encode(texts: list[str], size: int) -> list[np.ndarray]:
        done, parts = 0, []
        while done < len(texts):
            try:
                parts.append(np.asarray(encoder(texts[done : done + size]), dtype=np.float32))
                done += size
            except MemoryError:
                if size == 1:
                    raise
                size = max(1, size // 2)
        return list(np.concatenate(parts)) if parts else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[names].copy()
            out["embedding"] = encode(batch[text].tolist(), batch_rows)
            yield out

    fields = f"{schema}, embedding array<float>" if schema else "embedding array<float>"
    return docs.mapInPandas(run, fields)


def pending_documents(docs: DataFrame, encoded: DataFrame) -> DataFrame:
    """Documents whose vector is not stored yet."""
    return docs.join(encoded.select("stable_id"), "stable_id", "left_anti")


def document_chunks(
    docs: DataFrame, length: int = CHUNK_LENGTH, step: int = CHUNK_STEP
) -> DataFrame:
    """One row per overlapping token window (stable_id, chunk, text)."""
    windows = chunk_windows(blank_split_tokens(F.col("text")), length, step)
    return docs.select("stable_id", F.posexplode(windows).alias("chunk", "_t")).select(
        "stable_id", "chunk", F.array_join("_t", " ").alias("text")
    )


def mean_pool(chunks: DataFrame, key: str = "stable_id") -> DataFrame:
    """Mean of a document's chunk vectors, then unit length.

    Means are partial sums of whole vectors, merged map-side.
    """
    pooled = chunks.groupBy(key).agg(
        Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>"))).alias("_m")
    )
    return pooled.select(key, l2_normalize(vector_to_array("_m")).alias("embedding"))


def encode_long_documents(
    docs: DataFrame, encoder: Encoder, length: int = CHUNK_LENGTH, step: int = CHUNK_STEP
) -> DataFrame:
    return mean_pool(encode_documents(document_chunks(docs, length, step), encoder))


def vector_violations(
    vectors: DataFrame, dimension: int, tolerance: float = NORM_TOLERANCE
) -> DataFrame:
    """Vectors of wrong size, with non-finite components or not of unit length."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    rule = (
        F.when(e.isNull() | (F.size(e) != dimension), "dimension")
        .when(~F.coalesce(finite, F.lit(False)), "non_finite")
        .when(F.abs(norm(e) - 1.0) > tolerance, "norm")
    )
    return vectors.withColumn("rule", rule).filter("rule is not null")


def normalize_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("embedding", l2_normalize(F.col("embedding")))
