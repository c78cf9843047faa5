"""TF-IDF in relational form: (stable_id, term, weight), fitted on training rows only.

Texts are shuffled once by document and cut into tokens by built-in expressions; Arrow stages count
a batch of documents at a time as integers (``terms``).  Only (term, document frequency) sums of
batches cross the network when a vocabulary is fitted, and a weighted document is one row of
arrays.  The vocabulary is bounded by ``max_features``, written out, and sent to every task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tracefold.functions.text import SPACE
from tracefold.functions.windows import word_tokens
from tracefold.operators import terms
from tracefold.operators.ordering import with_position, with_running_sums
from tracefold.session import materialize, scratch_path, shuffle_width


@dataclass(frozen=True)
class TermSpec:
    """One block of terms: word n-grams or character n-grams inside padded words."""

    analyzer: str
    ngram_min: int
    ngram_max: int
    min_df: int = 2
    max_features: int = 150_000
    block: str = ""


# The benchmark's representations.
WORD = (TermSpec("word", 1, 2, 2, 150_000, "word"),)
CHAR = (TermSpec("char_wb", 3, 5, 2, 150_000, "char"),)
WORD_CHAR = (
    TermSpec("word", 1, 2, 2, 75_000, "word"),
    TermSpec("char_wb", 3, 5, 2, 75_000, "char"),
)
REPRESENTATIONS = {"WORD": WORD, "CHAR": CHAR, "WORD_CHAR": WORD_CHAR}


def _word(high: int, min_df: int = 2, size: int = 150_000) -> TermSpec:
    return TermSpec("word", 1, high, min_df, size, "word")


def _char(low: int, high: int, min_df: int = 2, size: int = 150_000) -> TermSpec:
    return TermSpec("char_wb", low, high, min_df, size, "char")


# The variants of the staged search, by task and number.
VARIANTS = {
    "S6-R1": (_char(3, 5),),
    "S6-R2": (_char(3, 6),),
    "S6-R3": (_char(2, 5),),
    "S6-R4": (_char(3, 5, 5),),
    "S6-R5": (_char(3, 5, 2, 250_000),),
    "S6-R6": (_char(3, 6, 2, 250_000),),
    "S3-R1": (_word(2),),
    "S3-R2": (_word(1),),
    "S3-R3": (_word(3),),
    "S3-R4": (_word(2, 5),),
    "S3-R5": (_word(2, 2, 250_000),),
    "S3-R6": (_word(3, 2, 250_000),),
    "S2-R1": (_word(2), _char(3, 5)),
    "S2-R2": (_word(2, 2, 200_000), _char(3, 5, 2, 200_000)),
    "S2-R3": (_word(2, 2, 250_000), _char(3, 5, 2, 250_000)),
    "S2-R4": (_word(3), _char(3, 5)),
    "S2-R5": (_word(2), _char(3, 6)),
    "S2-R6": (_word(2), _char(3, 5, 2, 250_000)),
}
REPRESENTATIONS |= VARIANTS


def _tokens(spec: TermSpec) -> Column:
    """What the terms of ``text`` are made of: word characters, or runs without white space."""
    if spec.analyzer == "word":
        return word_tokens(F.col("text"))
    return F.filter(F.split(F.lower("text"), f"(?U){SPACE}+"), lambda w: w != "")


def _tokenized(docs: DataFrame, specs: Sequence[TermSpec]) -> DataFrame:
    """stable_id and the tokens of each spec, rows of one id next to each other."""
    narrow = docs.select("stable_id", "text")
    # Shuffled as text, which is smaller than its tokens.
    placed = narrow.repartition(shuffle_width(narrow, 32 << 20), "stable_id").sortWithinPartitions("stable_id")
    return placed.select("stable_id", *[_tokens(s).alias(f"t{i}") for i, s in enumerate(specs)])


def term_statistics(docs: DataFrame, spec: TermSpec) -> DataFrame:
    """(term, df, total) of ``docs`` (stable_id, text); batches send sums."""

    def run(batches):
        for _, document, (tokens,) in terms.documents(batches):
            names, df, total = terms.statistics(spec, document, tokens)
            yield pa.RecordBatch.from_arrays([names, pa.array(df, pa.int64()), pa.array(total, pa.int64())], names=["term", "df", "total"])

    sums = _tokenized(docs, (spec,)).mapInArrow(run, "term string, df long, total long")
    return sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def most_frequent(statistics: DataFrame, size: int) -> DataFrame:
    """The ``size`` terms with the largest totals, ties by term.

    Terms are counted per total, and a running sum from the top finds the total at which
    the size is reached.  Terms above it stay, and only those of that total are ranked, so
    no task sorts the vocabulary.  ``statistics`` is read several times.
    """
    totals = statistics.groupBy("total").agg(F.count(F.lit(1)).alias("n"))
    counted = with_running_sums(totals, [], [-F.col("total")], ["n"])
    cut = counted.filter(F.col("n_through") >= size).orderBy(F.desc("total")).first()
    if cut is None:
        return statistics
    ties = with_position(statistics.filter(F.col("total") == cut["total"]), [], [F.col("term")])
    wanted = size - (cut["n_through"] - cut["n"])
    return statistics.filter(F.col("total") > cut["total"]).unionByName(
        ties.filter(F.col("position") < wanted).select(*statistics.columns)
    )


def fit_vocabulary(train: DataFrame, spec: TermSpec) -> DataFrame:
    """(term, df, total, idf, term_index) of the most frequent terms of the training rows.

    Terms in fewer than ``min_df`` documents drop out first; ties at the cap go by term.
    """
    documents = train.count()
    statistics = term_statistics(train, spec).filter(F.col("df") >= spec.min_df)
    kept = most_frequent(materialize(statistics, "term-statistics"), spec.max_features)
    idf = F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1.0
    # At most max_features rows reach this window.
    index = F.row_number().over(Window.orderBy("term")) - 1
    return materialize(kept.withColumn("idf", idf).withColumn("term_index", index), "vocabulary")


def _known(vocabulary: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """Terms and idf by ``term_index``; ``max_features`` bounds them."""
    table = vocabulary.select("term", "idf", "term_index").toArrow().sort_by("term_index")
    return table["term"].combine_chunks(), table["idf"].to_numpy()


def tfidf_rows(docs: DataFrame, specs: Sequence[TermSpec], vocabularies: Sequence[DataFrame]) -> DataFrame:
    """(stable_id, indices, values): sublinear tf x smoothed idf, unit length per document and block.

    Unknown terms drop out, documents without a known term too; indices number terms across blocks.
    """
    shared = docs.sparkSession.sparkContext.broadcast([_known(v) for v in vocabularies])

    def run(batches):
        known = shared.value
        for ids, document, columns in terms.documents(batches):
            parts, offset = [], 0
            for spec, (names, idf), tokens in zip(specs, known, columns):
                doc, number, tf = terms.known_counts(spec, document, tokens, names)
                w = (1.0 + np.log(tf)) * idf[number]
                norm = np.sqrt(np.bincount(doc, w * w, len(ids)))
                parts.append((doc, number + offset, w / norm[doc]))
                offset += len(names)
            doc, index, value = (np.concatenate(p) for p in zip(*parts))
            if len(parts) > 1:
                order = np.argsort(doc, kind="stable")
                doc, index, value = doc[order], index[order], value[order]
            size = np.bincount(doc, minlength=len(ids))
            offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
            out = pa.RecordBatch.from_arrays([
                ids, pa.ListArray.from_arrays(offsets, pa.array(index.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(value)),
            ], names=["stable_id", "indices", "values"])
            for part in range(0, len(ids), 512):
                rows = out.slice(part, 512)
                yield rows.filter(pa.array(size[part : part + 512] > 0))

    return _tokenized(docs, specs).mapInArrow(run, "stable_id string, indices array<int>, values array<double>")


@dataclass(frozen=True)
class FittedFeatures:
    specs: tuple[TermSpec, ...]
    vocabularies: tuple[DataFrame, ...]
    sizes: tuple[int, ...]

    @property
    def width(self) -> int:
        return sum(self.sizes)

    def rows(self, docs: DataFrame) -> DataFrame:
        """(stable_id, indices, values) of all blocks, a row per document with a known term."""
        return tfidf_rows(docs, self.specs, self.vocabularies)

    def transform(self, docs: DataFrame) -> DataFrame:
        """Long weights of all blocks; ``feature`` numbers terms across blocks."""
        names, offset = None, 0
        for spec, vocabulary, size in zip(self.specs, self.vocabularies, self.sizes):
            block = vocabulary.select(
                (F.col("term_index") + F.lit(offset)).cast("int").alias("feature"),
                F.lit(spec.block).alias("block"), "term", "term_index",
            )
            names = block if names is None else names.unionByName(block)
            offset += size
        long = self.rows(docs).select("stable_id", F.inline(F.arrays_zip("indices", "values")).alias("feature", "weight"))
        return long.join(names, "feature").select("stable_id", "block", "term", "term_index", "weight", "feature")


def fit_features(train: DataFrame, specs: Sequence[TermSpec]) -> FittedFeatures:
    vocabularies = tuple(fit_vocabulary(train, s) for s in specs)
    return FittedFeatures(tuple(specs), vocabularies, tuple(v.count() for v in vocabularies))


def _fused(
    docs: DataFrame, weights: DataFrame | None, width: int, dense: DataFrame | None, dimension: int
) -> DataFrame:
    """The columns of ``docs`` but its text, with ``indices`` and ``values`` of every document.

    ``weights``: ``FittedFeatures.rows``, or the long form.  ``dense`` (stable_id, embedding) is appended after the sparse block with weight one.
    Documents without a known term keep an empty vector.
    """
    rows = docs
    empty_i, empty_v = F.array().cast("array<int>"), F.array().cast("array<double>")
    if weights is not None:
        if "feature" in weights.columns:
            weights = weights.groupBy("stable_id").agg(
                F.array_sort(F.collect_list(F.struct("feature", "weight"))).alias("_f")
            ).select("stable_id", F.col("_f.feature").alias("indices"), F.col("_f.weight").alias("values"))
        rows = rows.join(weights.select("stable_id", F.col("indices").alias("_i"), F.col("values").alias("_v")), "stable_id", "left")
        indices, values = F.coalesce("_i", empty_i), F.coalesce("_v", empty_v)
    else:
        indices, values = empty_i, empty_v
    if dense is not None:
        rows = rows.join(dense.select("stable_id", "embedding"), "stable_id")
        indices = F.concat(indices, F.sequence(F.lit(width), F.lit(width + dimension - 1)))
        values = F.concat(values, F.col("embedding").cast("array<double>"))
    return rows.select(*[c for c in docs.columns if c != "text"], indices.alias("indices"), values.alias("values"))


def sparse_rows(
    docs: DataFrame, weights: DataFrame | None, width: int, dense: DataFrame | None = None, dimension: int = 0
) -> DataFrame:
    """``indices`` and ``values`` per document, written once for all fits that share them."""
    return materialize(_fused(docs, weights, width, dense, dimension), "sparse-rows")


def as_vectors(
    docs: DataFrame,
    weights: DataFrame | None,
    width: int,
    dense: DataFrame | None = None,
    dimension: int = 0,
) -> DataFrame:
    """``sparse_rows`` as one ML vector per document.

    The vector column is written as its struct form and read back with the vector type, so no
    row passes Python.
    """
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(width + dimension).alias("size"),
        "indices",
        "values",
    )
    kept = [c for c in docs.columns if c != "text"]
    path = scratch_path(docs.sparkSession, "vectors")
    _fused(docs, weights, width, dense, dimension).select(*kept, vector.alias("features")).write.parquet(path)
    schema = T.StructType(
        [docs.schema[c] for c in kept] + [T.StructField("features", VectorUDT())]
    )
    return docs.sparkSession.read.schema(schema).parquet(path)


def fuse_long(weights: DataFrame, dense: DataFrame, width: int) -> DataFrame:
    """Relational form of the fusion: dense components become features after the terms."""
    components = dense.select("stable_id", F.posexplode("embedding").alias("i", "v")).select(
        "stable_id", (F.col("i") + width).cast("int").alias("feature"), F.col("v").cast("double").alias("weight")
    )
    return weights.select("stable_id", "feature", "weight").unionByName(components)
