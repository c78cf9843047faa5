"""Repeated 50-byte strings across documents, by merged Burrows-Wheeler transforms.

1. Anchors: positions whose 24-byte hash is the smallest of some 50-byte window.  Every
   window holds an anchor fixed by its own bytes, so equal windows meet in equal anchors.
   One shuffle deals packed anchors (hash, hash of the 76-byte context, document, position)
   to buckets; a bucket task keeps the anchors of two or more documents that share the bytes on
   one side of the anchor as well (hashes of both sides travel along).
2. Where all occurrences of an anchor have one context, that context is a repeated string and
   its smallest document is known.  Other anchors send their distinct contexts' bytes (one
   representative each) to the merge.
3. A merge task cuts its contexts into shards, sorts each shard's suffixes, and merges the
   shards' transforms by iterative interleave refinement: each round is a stable bucket pass
   over the interleaved symbols and refines the blocks of equal prefixes by one symbol.  All
   50-byte strings of a context hold its anchor, so the anchor's 24 bytes are one symbol, and
   27 rounds give the intervals of equal 50-byte strings; suffixes are never sorted anew.
4. An anchor with more than ``HOT`` distinct contexts is split: each of its windows is counted
   on its own hash, with one row per window and pre-aggregation.
5. Covered ranges are gathered per document, whose size bounds them, and cut from the text.

Context bytes and removals fetch texts by an exact join behind a fixed-size bitmap.

Defined cases: null text is empty.  Documents that share an id are not earlier than each
other.  Rows are kept as they are, repeated ones too; rows with a null id lose nothing and are
no earlier document.  Texts of fewer than 50 bytes lose nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracefold.llm import bitmap
from tracefold.llm.words import U, mix, pieces, prefix_hashes, _power
from tracefold.session import materialize, shuffle_width

LENGTH, GRAM = 50, 24
WIDTH = LENGTH - GRAM + 1
BEFORE = LENGTH - GRAM  # context: 26 bytes before an anchor and 50 from it
HOT = 20_000  # contexts of 54 two-byte symbols that one merge takes at most
SHARD = 256
FLUSH = 8 << 20  # bytes of entries held by a task before they are emitted; sorting holds them three times

#: A 50-byte window around an anchor reaches HALF bytes to its left or to its right.
HALF = (LENGTH - GRAM) // 2

_ENTRY = np.dtype([("key", U), ("context", U), ("left", U), ("right", U), ("doc", np.int64), ("at", np.int32)])
_PACKED = (("key", 5), ("context", 5), ("left", 3), ("right", 3))  # leading bytes that travel


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over values[i : i + width] for each i, by doubling."""
    span, step = values, 1
    while step * 2 <= width:
        span = pick(span[:-step], span[step:])
        step *= 2
    rest = width - step
    return pick(span[: len(span) - rest], span[rest:]) if rest else span


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Positions, hashes, context hashes and hashes of the bytes left and right of all anchors."""
    n = len(data)
    if n < LENGTH:
        empty = np.zeros(0, np.int64)
        return empty, *[empty.view(U)] * 4
    c = prefix_hashes(data)
    down = _power("down", n + 1)
    gram = mix((c[GRAM:] - c[:-GRAM]) * down[: n + 1 - GRAM]) | U(1)
    low = _slide(gram, WIDTH, np.minimum)
    # A window that crosses into the next text does not count.
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(low)]
    low[np.arange(len(low)) + LENGTH > ends] = 0
    padded = np.zeros(len(gram) + WIDTH - 1, U)
    padded[WIDTH - 1 : WIDTH - 1 + len(low)] = low
    at = np.flatnonzero(_slide(padded, WIDTH, np.maximum)[: len(gram)] == gram)
    text = np.searchsorted(offsets, at, "right") - 1
    a, b = np.maximum(at - BEFORE, offsets[text]), np.minimum(at + LENGTH, offsets[text + 1])
    context = mix((c[b] - c[a]) * down[a] + mix(((at - a) * 128 + (b - at)).astype(U)))
    # Where a side is cut off by the text's end, the context stands for it.
    left = np.where(at - a >= HALF, mix((c[at] - c[np.maximum(at - HALF, 0)]) * down[np.maximum(at - HALF, 0)]), context)
    far = np.minimum(at + GRAM + HALF, n)
    right = np.where(b - at >= GRAM + HALF, mix((c[far] - c[at + GRAM]) * down[at + GRAM]), context)
    return at, gram[at], context, left, right


def _anchor_blocks(buckets: int):
    def flush(held: list[np.ndarray]):
        entries = np.concatenate(held)
        bucket = ((entries["key"] >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        entries, bucket = entries[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        # Hashes lose their low bytes; column by column, ids and positions pack well.
        blobs = []
        for b in full:
            part = entries[cuts[b] : cuts[b + 1]]
            tops = [np.ascontiguousarray(part[k]).view(np.uint8).reshape(-1, 8)[:, 8 - w :].tobytes() for k, w in _PACKED]
            blobs.append(b"".join([np.int64(len(part)).tobytes(), *tops, part["doc"].tobytes(), part["at"].tobytes()]))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, _, data, offsets in pieces(batch.column(1)):
                at, *hashes = anchors(data, offsets)
                text = np.searchsorted(offsets, at, "right") - 1
                entry = np.empty(len(at), _ENTRY)
                for (name, _), values in zip(_PACKED, hashes, strict=True):
                    entry[name] = values
                entry["doc"], entry["at"] = ids[a + text], at - offsets[text]
                held.append(entry)
                size += entry.nbytes
                if size > FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _unpack(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    entry = np.zeros(n, _ENTRY)
    at = 8
    for name, width in _PACKED:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, 8 - width :] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
        entry[name] = wide.view(U).reshape(-1)
        at += n * width
    entry["doc"] = np.frombuffer(blob, np.int64, n, at)
    entry["at"] = np.frombuffer(blob, np.int32, n, at + 8 * n)
    return entry


def _in_two(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a code stands in two or more documents."""
    if not len(code):
        return np.zeros(0, bool)
    order = np.argsort(code)
    sorted_code, sorted_doc = code[order], doc[order]
    head = np.flatnonzero(np.r_[True, sorted_code[1:] != sorted_code[:-1]])
    many = np.minimum.reduceat(sorted_doc, head) != np.maximum.reduceat(sorted_doc, head)
    out = np.empty(len(code), bool)
    out[order] = np.repeat(many, np.diff(np.r_[head, len(code)]))
    return out


def _shared(batches):
    """Occurrences (key, context, doc, at) of anchors in two or more documents.

    ``first`` is the smallest document of the context; ``one`` tells that the anchor has a
    single context; ``asked`` marks the occurrence whose bytes stand for the context.
    """
    blobs = [x.as_buffer().to_pybytes() for batch in batches for x in batch.column(1)]
    entries = np.empty(sum(int(np.frombuffer(x, np.int64, 1)[0]) for x in blobs), _ENTRY)
    end = len(entries)
    while blobs:
        part = _unpack(blobs.pop())
        entries[end - len(part) : end] = part
        end -= len(part)
    # An anchor's occurrences are judged together; anchors in parts, so that only a part is sorted at a time.
    number = (entries["key"] >> U(24)).astype(np.uint8) & 7
    for i in range(8):
        yield from _shared_part(entries[number == i])


def _shared_part(e: np.ndarray):
    e = e[_in_two(e["key"], e["doc"])]
    # A shared window needs the same bytes on one side of the anchor at least.
    e = e[_in_two(mix(e["key"] + e["left"]), e["doc"]) | _in_two(mix(e["key"] ^ mix(e["right"])), e["doc"])]
    if not len(e):
        return
    e = e[np.lexsort((e["at"], e["doc"], e["context"], e["key"]))]
    fresh = np.r_[True, e["key"][1:] != e["key"][:-1]]
    new = fresh | np.r_[True, e["context"][1:] != e["context"][:-1]]
    group = np.cumsum(fresh) - 1
    contexts = np.bincount(group, weights=new)[group].astype(np.int64)
    first = e["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
    useful = (contexts > 1) | (e["doc"] != first)
    for a in range(0, len(e), 1 << 16):
        part = slice(a, a + (1 << 16))
        keep = useful[part]
        yield pa.RecordBatch.from_arrays([
            pa.array(e["key"][part][keep].view(np.int64)), pa.array(e["context"][part][keep].view(np.int64)),
            pa.array(e["doc"][part][keep]), pa.array(e["at"][part][keep]), pa.array(first[part][keep]),
            pa.array(contexts[part][keep]), pa.array(new[part][keep]),
        ], names=["key", "context", "doc", "at", "first", "contexts", "asked"])


def _thinned(docs: DataFrame, ids: DataFrame, wanted: bool) -> DataFrame:
    """Rows of (doc_id, text) whose bit in the bitmap of ``ids.doc`` is (not) set."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.build(ids, bitmap.slot_of_id("doc")))

    def run(batches):
        for batch in _sliced(batches):
            hit = bitmap.hits(shared.value, batch.column(2).to_numpy(zero_copy_only=False))
            yield batch.select([0, 1]).filter(pa.array(hit == wanted))

    return docs.withColumn("_slot", bitmap.slot_of_id("doc_id")).mapInArrow(run, "doc_id long, text string")


def _sliced(batches, rows: int = 256):
    """Batches of few rows, so that only few lists are unfolded at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Bounds of each row's list and all list items; a null row has none."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.r_[0, np.cumsum(sizes)].astype(np.int64), column.flatten()


def _cut_contexts(batches):
    """(key, context, first, contexts, lead, bytes) for the asked positions of a text."""
    for batch in _sliced(batches):
        bounds, items = _lists(batch.column(1))
        at = items.field("at").to_numpy()
        start = np.maximum(0, at - BEFORE)
        cut = []
        for text, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            data = text.encode()
            cut += [data[i : j + LENGTH] for i, j in zip(start[a:b].tolist(), at[a:b].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*[items.field(k) for k in ("key", "context", "first", "contexts")],
             pa.array((at - start).astype(np.int32)), pa.array(cut, pa.binary())],
            names=["key", "context", "first", "contexts", "lead", "bytes"],
        )


def sorted_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Suffix order of one shard by prefix doubling (ties beyond 32 symbols by position)."""
    bits = 8 * symbols.itemsize
    n, step = len(symbols), 64 // bits
    padded = np.zeros(n + step - 1, U)
    padded[:n] = symbols
    rank = np.zeros(n, U)
    for i in range(step):
        rank = (rank << U(bits)) | padded[i : i + n]
    while True:
        order = np.argsort(rank, kind="stable")
        fresh = np.r_[0, np.cumsum(rank[order][1:] != rank[order][:-1])]
        dense = np.empty(n, np.int64)
        dense[order] = fresh
        if step >= 32 or fresh[-1] == n - 1:
            return order
        after = np.full(n, -1, np.int64)
        after[: n - step] = dense[step:]
        rank = dense * (n + 1) + after + 1
        step *= 2


def merged_blocks(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number of every suffix of all shards: equal blocks, equal first ``depth`` symbols.

    A shard is its symbols, 0 ending each string.  Returns (block per merged row, position in
    the concatenated shards per merged row).
    """
    orders = [sorted_suffixes(s) for s in shards]
    previous = []
    for s, order in zip(shards, orders, strict=True):
        # Symbol before each suffix; the one before a string's start is its own end mark.
        previous.append(np.where(order > 0, s[order - 1], 0).astype(s.dtype))
    bwt = np.concatenate(previous)
    sizes = np.array([len(s) for s in shards])
    source = np.repeat(np.arange(len(shards)), sizes).astype(np.uint8 if len(shards) <= 256 else np.uint16)
    block = np.zeros(len(bwt), np.int32)
    symbols = np.empty_like(bwt)
    for _ in range(depth):
        place = np.argsort(source, kind="stable")  # where each shard's rows stand, in order
        symbols[place] = bwt
        move = np.argsort(symbols, kind="stable")
        source = source[move]
        symbols, block = symbols[move], block[move]
        fresh = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
        block[0] = 0
        np.cumsum(fresh, out=block[1:])
    place = np.argsort(source, kind="stable")
    position = np.empty(len(bwt), np.int64)
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    position[place] = np.concatenate([o + b for o, b in zip(orders, base, strict=True)])
    return block, position


def window_firsts(contexts: list[bytes], lead: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context number, offset, smallest document) of every 50-byte window of the contexts.

    Symbols are 0 for an end, 1 to 256 for a byte and one number for each distinct anchor.
    """
    found: dict[bytes, int] = {}
    anchor = np.array([
        found.setdefault(x[a : a + GRAM], 257 + len(found)) for x, a in zip(contexts, lead.tolist(), strict=True)
    ])
    joined = b"".join(x[:a] + b"\0" + x[a + GRAM :] + b"\0" for x, a in zip(contexts, lead.tolist(), strict=True))
    sizes = np.array([len(x) for x in contexts]) - GRAM + 2
    ends = np.cumsum(sizes)
    symbols = np.frombuffer(joined, np.uint8).astype(np.uint16 if len(found) < 65_000 else np.uint32) + 1
    symbols[ends - 1] = 0
    symbols[ends - sizes + lead] = anchor
    cuts = ends[SHARD - 1 :: SHARD]
    shards = [s for s in np.split(symbols, cuts) if len(s)]
    block, position = merged_blocks(shards, WIDTH)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(symbols)) - (ends - sizes)[owner]
    whole = offset + WIDTH < sizes[owner]
    keep = whole[position]
    block, position = block[keep], position[keep]
    if not len(block):
        return position, position, position
    head = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    least = np.minimum.reduceat(first[owner[position]], head)
    return owner[position], offset[position], np.repeat(least, np.diff(np.r_[head, len(block)]))


def _emit_runs(key, context, lead, number, offset, least):
    """Rows (key, context, low, high, earliest): runs of windows with one smallest document."""
    order = np.lexsort((offset, number))
    number, offset, least = number[order], offset[order], least[order]
    cut = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (least[1:] != least[:-1]) | (offset[1:] != offset[:-1] + 1)])
    last = np.r_[cut[1:], len(number)] - 1
    who = number[cut]
    return pa.RecordBatch.from_arrays([
        pa.array(key[who]), pa.array(context[who]), pa.array((offset[cut] - lead[who]).astype(np.int32)),
        pa.array((offset[last] + LENGTH - lead[who]).astype(np.int32)), pa.array(least[cut]),
    ], names=["key", "context", "low", "high", "earliest"])


RUN = "key long, context long, low int, high int, earliest long"


def _merge(batches):
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    columns = [table[c].to_numpy() for c in ("key", "context", "lead", "first")]
    texts = table["bytes"].to_pylist()
    # Keys stay together, so small parts can be merged on their own, in cache.
    order = np.argsort(columns[0], kind="stable")
    start = 0
    while start < len(order):
        stop = min(len(order), start + 1000)
        while stop < len(order) and columns[0][order[stop]] == columns[0][order[stop - 1]]:
            stop += 1
        part = order[start:stop]
        key, context, lead, first = (c[part] for c in columns)
        number, offset, least = window_firsts([texts[i] for i in part], lead, first)
        if len(number):
            yield _emit_runs(key, context, lead, number, offset, least)
        start = stop


def _hot_windows(batches):
    """(key, context, low, window, first): every window of a crowded anchor's contexts."""
    for batch in _sliced(batches):
        rows = batch.to_pydict()
        out = [[], [], [], [], []]
        for key, context, first, lead, data in zip(rows["key"], rows["context"], rows["first"], rows["lead"], rows["bytes"], strict=True):
            for o in range(len(data) - LENGTH + 1):
                window = int.from_bytes(hashlib.blake2b(data[o : o + LENGTH], digest_size=8).digest(), "little", signed=True)
                for column, value in zip(out, (key, context, o - lead, window, first), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())],
            names=["key", "context", "low", "window", "first"],
        )


def _covered(docs: DataFrame) -> DataFrame:
    """doc, ranges (array of start, stop in bytes) for documents that lose bytes."""
    texts = docs.filter("doc_id is not null and octet_length(text) >= 50")
    buckets = shuffle_width(docs, 2 << 20)  # a task unpacks its buckets several times over
    occurrences = materialize(
        texts.select("doc_id", "text").mapInArrow(_anchor_blocks(buckets), "bucket int, entries binary")
        .repartition(buckets, "bucket")
        .mapInArrow(_shared, "key long, context long, doc long, at int, first long, contexts long, asked boolean"),
        "repeat-occurrences",
    )
    asked = materialize(
        occurrences.filter("asked and contexts > 1").groupBy("doc").agg(
            F.collect_list(F.struct("key", "context", "first", "contexts", "at")).alias("asked")
        ),
        "repeat-asked",
    )
    contexts = materialize(
        _thinned(texts.select("doc_id", "text"), asked, True).join(asked, F.col("doc_id") == F.col("doc"))
        .select("text", "asked").mapInArrow(
            _cut_contexts, "key long, context long, first long, contexts long, lead int, bytes binary"
        ).dropDuplicates(["key", "context"]),
        "repeat-contexts",
    )
    plain = contexts.filter(F.col("contexts") <= HOT).select("key", "context", "first", "lead", "bytes")
    merged = plain.repartition(buckets, "key").mapInArrow(_merge, RUN)
    windows = contexts.filter(F.col("contexts") > HOT).mapInArrow(
        _hot_windows, "key long, context long, low int, window long, first long"
    )
    least = windows.groupBy("window").agg(F.min("first").alias("earliest"))
    crowded = windows.join(least, "window").select("key", "context", "low", (F.col("low") + LENGTH).alias("high"), "earliest")
    runs = materialize(merged.unionByName(crowded), "repeat-runs")
    inner = occurrences.filter("contexts = 1").select(
        "doc", F.greatest(F.lit(0), F.col("at") - BEFORE).alias("start"), (F.col("at") + LENGTH).alias("stop")
    )
    edges = occurrences.filter("contexts > 1").select("key", "context", "doc", "at").join(runs, ["key", "context"]).filter(
        "earliest < doc"
    ).select("doc", (F.col("at") + F.col("low")).alias("start"), (F.col("at") + F.col("high")).alias("stop"))
    return materialize(
        inner.unionByName(edges).groupBy("doc").agg(F.collect_set(F.struct("start", "stop")).alias("ranges")), "repeat-ranges"
    )


def _apply(batches):
    for batch in _sliced(batches):
        bounds, items = _lists(batch.column(2))
        start, stop = (items.field(k).to_numpy() for k in ("start", "stop"))
        counts, kept = [], []
        for text, a, b in zip(batch.column(1).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            depth = np.zeros(len(data) + 1, np.int32)
            np.add.at(depth, start[a:b], 1)
            np.add.at(depth, np.minimum(stop[a:b], len(data)), -1)
            gone = np.cumsum(depth[:-1]) > 0
            spans = int((gone[1:] & ~gone[:-1]).sum()) + bool(len(gone) and gone[0])
            counts.append((len(data), int(gone.sum()), spans))
            kept.append(data[~gone].tobytes())
        columns = np.array(counts, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(columns[:, i]) for i in range(3)], pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes); one row per input row."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    ranges = _covered(texts)
    touched = _thinned(texts, ranges, True).join(ranges, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "ranges")
    cut = touched.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")
    untouched = _thinned(texts, ranges, False).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.col("text").cast("binary").alias("kept"),
    )
    return cut.unionByName(untouched)
