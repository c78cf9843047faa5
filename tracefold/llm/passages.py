"""Repeated word passages within and across documents, by seed and extend.

A window is ``LENGTH`` consecutive words.  A word goes when a window that covers it also starts
earlier: in a document with a smaller id, or further left in the same document.

1. Seeds: the ``SEED``-word gram with the smallest hash of every window is an anchor (winnowing, all
   ties).  Equal windows have equal anchors at equal places.  Only anchor hashes are counted in
   the first shuffle, with map-side sums.
2. Join: occurrences of anchors that stand twice or more are joined on the anchor.  Their context
   (``REACH`` words before the anchor to ``REACH`` after it, what any window around it can hold)
   has a digest; anchor and context together are 128 bits of independent word digests.  Each
   occurrence meets the first occurrence of its context and extends over the whole of it.
3. Extend: the first occurrences of an anchor with several contexts are joined, as words, with the
   earliest of them.  The match is extended word by word to both sides and kept when it has
   ``LENGTH`` words.  Where it stops at a different word, the occurrence is tried again with the
   seed that reaches over that word; a window that the earliest one does not share holds
   such a word, so no repeat is lost.  A round lengthens the seeds by a word or more, so there
   are at most ``LENGTH - SEED`` further rounds; pairs grow with occurrences, not with
   their square.
4. Overlapping matches are joined to maximal runs per document and cut from its words.

Joins have one row per key on one side (built as hash tables of a partition's keys), so that a
hot anchor, passage or copied document can be split.  No group is gathered but the ranges of one document.

Defined cases: null text has no words.  Texts under ``LENGTH`` words lose nothing.  Rows that
share an id count as one document: the start decides, and equal starts are not earlier than
each other.  Rows with a null id lose nothing and are no earlier document.  Repeated rows are
kept as rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracefold.llm import bitmap
from tracefold.llm.named import lanes, named_words
from tracefold.llm.words import U, join_hashes, mix, pieces
from tracefold.session import materialize

LENGTH, SEED = 20, 14
REACH = LENGTH - SEED  # words before and after an anchor that a window can hold

_STEP = U(0x9FB21C651E98DF25)
_OCCURRENCE = "key long, context long, doc long, mark long, at int, before int, after int"


def _extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each run of ``width`` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and hashes of the anchors; ``first``: first word number of each text, and their number."""
    if len(h) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U)
    gram = join_hashes(h, SEED) | U(1)
    low = _extreme(gram, REACH + 1, np.minimum)
    # A window that crosses into the next text does not count.
    ends = np.repeat(first[1:], np.diff(first))[: len(low)]
    low[np.arange(len(low)) + LENGTH > ends] = 0
    wide = np.zeros(len(low) + 2 * REACH, U)
    wide[REACH : REACH + len(low)] = low
    # A gram is an anchor when it is the smallest of one of the windows that hold it.
    hit = np.zeros(len(gram), bool)
    for back in range(REACH + 1):
        hit |= wide[REACH - back : REACH - back + len(gram)] == gram
    at = np.flatnonzero(hit)
    return at, mix(gram[at])  # minima are small; mixed, they spread over all keys


def _contexts(h: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Digest of each anchor's context, and the words before and after the anchor in it."""
    before = np.minimum(REACH, at - begin)
    after = np.minimum(REACH, end - at - SEED)
    total = mix((before * 64 + after).astype(U) + U(1))
    for j in range(-REACH, SEED + REACH):
        inside = (j >= -before) & (j < SEED + after)
        total = np.where(inside, mix(total * _STEP + h[np.where(inside, at + j, 0)]), total)
    return total, before, after


def _word_lanes(column: pa.Array):
    """(first row, first word numbers, two lanes of word digests) of consecutive whole texts."""
    for a, _, data, offsets in pieces(column):
        codes, names, first = named_words(data, offsets)
        pair = lanes(names)
        yield a, first, pair[0][codes], pair[1][codes]


def _anchor_keys(batches):
    for batch in batches:
        for _, first, one, _ in _word_lanes(batch.column(1)):
            _, key = anchors(one, first)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])


def _occurrences(shared):
    """Occurrences of the anchors whose bit is set."""

    def run(batches):
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a, first, one, two in _word_lanes(batch.column(1)):
                at, key = anchors(one, first)
                keep = bitmap.hits(shared.value, (key >> U(64 - bitmap.LOG)).astype(np.int64))
                at, key = at[keep], key[keep]
                text = np.searchsorted(first, at, "right") - 1
                context, before, after = _contexts(two, at, first[text], first[text + 1])
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), pa.array(ids[a + text]),
                    pa.array(marks[a + text]), *[pa.array(x.astype(np.int32)) for x in (at - first[text], before, after)],
                ], names=["key", "context", "doc", "mark", "at", "before", "after"])

    return run


_TEXT = "doc_id long, text string, mark long"


def _thinned(texts: DataFrame, ids: DataFrame):
    """A function that gives the rows whose bit in a bitmap of ``ids.doc`` is set, or the others.

    It passes (doc_id, text, mark) through ``then`` in the same task.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bitmap.build(ids, bitmap.slot_of_id("doc")))

    def part(wanted: bool, then=None, schema: str = _TEXT) -> DataFrame:
        def chosen(batches):
            for batch in batches:
                known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                hit = known & bitmap.hits(shared.value, batch.column(2).to_numpy(zero_copy_only=False))
                yield batch.select([0, 1, 3]).filter(pa.array(hit == wanted))

        def run(batches):
            return chosen(batches) if then is None else then(chosen(batches))

        return texts.select("doc_id", "text", bitmap.slot_of_id("doc_id").alias("slot"), "mark").mapInArrow(run, schema)

    return part


def _sliced(batches, rows: int = 256):
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _words(column: pa.Array) -> list[list[bytes]]:
    """Words of each text; without arguments, split() parts bytes at exactly the six ASCII blanks."""
    return [x.split() for x in column.cast(pa.binary()).to_pylist()]


def _cut_contexts(batches):
    """(doc, mark, at, lead, words) of the asked contexts of each text."""
    for batch in _sliced(batches):
        doc, mark, at, lead, cut = [], [], [], [], []
        columns = batch.column(0).to_pylist(), _words(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for d, words, m, asked in zip(*columns, strict=True):
            for x in asked:
                doc.append(d)
                mark.append(m)
                at.append(x["at"])
                lead.append(x["before"])
                cut.append([w.decode() for w in words[x["at"] - x["before"] : x["at"] + SEED + x["after"]]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(at, pa.int32()), pa.array(lead, pa.int32()),
             pa.array(cut, pa.list_(pa.string()))],
            names=["doc", "mark", "at", "lead", "words"],
        )


def _common(a: Column, b: Column) -> Column:
    """Number of equal first elements of two arrays."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def _tail(words: Column, after: Column) -> Column:
    """The words beyond the first ``after`` ones."""
    return F.slice(words, after + 1, F.greatest(F.lit(0), F.size(words) - after))


def _head_reversed(words: Column, count: Column) -> Column:
    return F.reverse(F.slice(words, F.lit(1), F.greatest(F.lit(0), count)))


def extend(rows: DataFrame) -> DataFrame:
    """(doc, mark, start, stop) of matches of at least ``LENGTH`` words with an earlier row.

    ``rows``: doc, mark, at, lead and words of contexts; the anchor is the ``SEED`` words after ``lead``.
    """
    rows = rows.withColumns({"x": F.lit(0), "y": F.lit(0)})
    matches = []
    for round_ in range(REACH + 1):
        seeded = rows.withColumn(
            "seed", F.array_join(F.slice("words", F.col("lead") - F.col("x") + 1, F.lit(SEED) + F.col("x") + F.col("y")), " ")
        )
        centres = seeded.groupBy("seed", "x", "y").agg(
            F.min(F.struct("doc", "at", "lead", "words")).alias("c"), F.count(F.lit(1)).alias("n")
        ).filter("n > 1").drop("n")
        own = F.col("lead") + SEED
        pairs = seeded.join(centres, ["seed", "x", "y"]).filter(
            (F.col("doc") != F.col("c.doc")) | (F.col("at") != F.col("c.at"))
        ).withColumns({
            "l": F.col("x") + _common(
                _head_reversed(F.col("words"), F.col("lead") - F.col("x")),
                _head_reversed(F.col("c.words"), F.col("c.lead") - F.col("x")),
            ),
            "r": F.col("y") + _common(
                _tail(F.col("words"), own + F.col("y")), _tail(F.col("c.words"), F.col("c.lead") + SEED + F.col("y"))
            ),
        })
        # Seeds that reach over the differing word; beyond REACH words no window holds them.
        longer = F.filter(F.array(
            F.when((F.col("l") < F.col("lead")) & (F.col("l") + 1 + F.col("y") <= REACH), F.struct(
                (F.col("l") + 1).alias("x"), F.col("y").alias("y"))),
            F.when((F.col("r") < F.size("words") - own) & (F.col("x") + F.col("r") + 1 <= REACH), F.struct(
                F.col("x").alias("x"), (F.col("r") + 1).alias("y"))),
        ), lambda s: s.isNotNull())
        done = materialize(
            pairs.select(
                "doc", "mark", "at", "lead", "words", longer.alias("longer"),
                (F.col("at") - F.col("l")).alias("start"), (F.col("at") + SEED + F.col("r")).alias("stop"),
            ), f"passage-round-{round_}",
        )
        matches.append(done.filter(F.col("stop") - F.col("start") >= LENGTH).select("doc", "mark", "start", "stop"))
        rows = done.select("doc", "mark", "at", "lead", "words", F.explode("longer").alias("s")).select(
            "doc", "mark", "at", "lead", "words", "s.x", "s.y"
        ).dropDuplicates(["doc", "mark", "at", "x", "y"])
        if rows.isEmpty():
            break
    out = matches[0]
    for part in matches[1:]:
        out = out.unionByName(part)
    return out


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, mark, ranges): per text that loses words, start and stop of its matches, in words.

    ``docs``: doc_id, text and ``mark``, a hash that tells the texts of one id apart.
    """
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", "mark")
    seeds = materialize(
        texts.mapInArrow(_anchor_keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"),
        "passage-seeds",
    )
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.build(seeds, bitmap.slot_of_hash("key")))
    found = materialize(
        texts.mapInArrow(_occurrences(shared), _OCCURRENCE).join(seeds.hint("shuffle_hash"), "key"), "passage-occurrences"
    )
    contexts = materialize(
        found.groupBy("key", "context").agg(
            F.min(F.struct("doc", "at", "mark", "before", "after")).alias("first"), F.count(F.lit(1)).alias("n")
        ), "passage-contexts",
    )
    again = contexts.filter("n > 1").select("key", "context", "first").hint("shuffle_hash")
    copies = found.join(again, ["key", "context"]).filter(
        (F.col("doc") > F.col("first.doc")) | ((F.col("doc") == F.col("first.doc")) & (F.col("at") > F.col("first.at")))
    ).filter(F.col("before") + F.col("after") >= REACH).select(
        "doc", "mark", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + SEED + F.col("after")).alias("stop")
    )
    several = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1").select("key")
    asked = materialize(
        contexts.join(several, "key").groupBy(F.col("first.doc").alias("doc"), F.col("first.mark").alias("asked_mark")).agg(
            F.collect_list(F.struct("first.at", "first.before", "first.after")).alias("asked")
        ), "passage-asked",
    )
    rows = _thinned(texts, asked)(True).join(
        asked, (F.col("doc_id") == F.col("doc")) & (F.col("mark") == F.col("asked_mark"))
    ).select("doc_id", "text", "mark", "asked").mapInArrow(
        _cut_contexts, "doc long, mark long, at int, lead int, words array<string>"
    )
    matches = extend(materialize(rows, "passage-words"))
    return materialize(
        copies.unionByName(matches).groupBy("doc", F.col("mark").alias("own_mark")).agg(
            F.collect_set(F.struct("start", "stop")).alias("ranges")
        ),
        "passage-ranges",
    )


def _union(ranges, end: int) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ranges."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], min(x["stop"], end)) for x in ranges):
        if runs and a <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(b, runs[-1][1])
        elif a < b:
            runs.append((a, b))
    return runs


def _apply(batches):
    for batch in _sliced(batches):
        counts, kept, spans = [], [], []
        found = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
        for words, ranges in zip(_words(batch.column(1)), found, strict=True):
            runs = _union(ranges or (), len(words))
            spans.append([{"start": a, "stop": b} for a, b in runs])
            counts.append((len(words), sum(b - a for a, b in runs)))
            for a, b in reversed(runs):
                del words[a:b]
            kept.append(b" ".join(words).decode())
        columns = np.array(counts, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(columns[:, 0]), pa.array(columns[:, 1]),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.string()),
        ], names=["doc_id", "n_words", "n_removed", "spans", "kept"])


def remove_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, spans (maximal removed runs, in words), kept (text); one row per input row."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("mark", F.xxhash64("text"))
    ranges = repeats(texts)
    part = _thinned(texts, ranges)
    result = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept string"
    return (
        part(True).join(ranges, (F.col("doc_id") == F.col("doc")) & (F.col("mark") == F.col("own_mark")), "left")
        .select("doc_id", "text", "mark", "ranges")
        .mapInArrow(_apply, result).unionByName(part(False, _apply, result))
    )
