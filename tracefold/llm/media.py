"""Media columns: content-addressed payloads in tar shards.

A payload is the text's UTF-8 bytes followed by bytes 255 up to a positive multiple of 576,
stored losslessly as an 8-bit greyscale PNG of 576 samples a row.  Payloads live once per
content digest (SHA-256) in tar shards below a shared folder; the index row of a payload
carries digest, shard, offset and length.  Metadata columns come from reading the first 33
bytes of each payload; features come from reading it back whole.

One pass takes digests; the smallest doc_id of a digest writes the payload.  A fixed-size
bitmap of the other ids lets most texts be written where they are scanned; only texts whose
bit is set are shuffled, to be told from the bitmap's false hits by an exact anti-join.  A
task writes shards of its own under fresh names; the index keeps only rows of tasks that
committed, so a repeated task leaves an unused file and no wrong row.

Defined cases: null text is the empty text (one row of 576 bytes 255).  Equal texts share one
payload.  Repeated rows and repeated ids keep their rows; null ids are kept.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from tracefold.llm import bitmap
from tracefold.llm.words import as_bytes
from tracefold.session import materialize, scratch_path

ROW = 576
SHARD_BYTES = 64 << 20
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_NO_ID = -(1 << 63)


def payload_of(text: bytes) -> bytes:
    size = max(ROW, -(-len(text) // ROW) * ROW)
    return text.ljust(size, b"\xff")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # filter 0 in front of each row
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first bytes of a stored payload."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode(media: bytes) -> bytes:
    width, height, _ = read_header(media)
    at, data = 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected row filter")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean sample and the means of 24 column bands, as text."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, 24, ROW // 24)
    bands = samples.sum(axis=(0, 2), dtype=np.int64) // (samples.shape[0] * samples.shape[2])
    return f"{len(samples)}:{int(samples.sum(dtype=np.int64)) * 1000 // samples.size}:{bytes(bands.astype(np.uint8)).hex()}"


class _Shards:
    """Tar files of one task."""

    def __init__(self, root: str):
        self.files, self.root = pafs.FileSystem.from_uri(root)
        self.files.create_dir(self.root, recursive=True)
        self.stream = None

    def add(self, name: str, media: bytes) -> tuple[str, int]:
        if self.stream is None:
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.stream = self.files.open_output_stream(f"{self.root}/{self.name}")
        member = tarfile.TarInfo(name)
        member.size = len(media)
        head = member.tobuf(tarfile.USTAR_FORMAT)
        self.stream.write(head + media + b"\0" * (-len(media) % 512))
        place = (self.name, self.at + len(head))
        self.at += len(head) + len(media) + (-len(media) % 512)
        if self.at >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.stream is not None:
            self.stream.write(b"\0" * 1024)
            self.stream.close()
            self.stream = None


def _write(root: str):
    def run(batches):
        shards, seen = _Shards(root), set()
        for batch in batches:
            data, offsets = as_bytes(batch.column(0))
            rows = []
            for d in range(batch.num_rows):
                payload = payload_of(data[offsets[d] : offsets[d + 1]].tobytes())
                digest = hashlib.sha256(payload).digest()
                if digest in seen:
                    continue
                seen.add(digest)
                media = encode(payload)
                rows.append((digest, *shards.add(f"{digest.hex()}.png", media), len(media)))
            if rows:
                digest, shard, offset, length = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(digest, pa.binary()), pa.array(shard), pa.array(offset, pa.int64()), pa.array(length, pa.int64())
                ], names=["digest", "shard", "offset", "length"])
        shards.close()

    return run


def _describe(root: str):
    """Columns of each index row: metadata from a header-only range read, then the payload's."""

    def rows(batches):
        files, base = pafs.FileSystem.from_uri(root)
        shard, opened = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if opened is not None:
                        opened.close()
                    shard = row["shard"]
                    opened = files.open_input_file(f"{base}/{shard}")
                width, height, depth = read_header(opened.read_at(min(HEADER_BYTES, row["length"]), row["offset"]))
                media = opened.read_at(row["length"], row["offset"])
                payload = decode(media)
                yield (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media),
                       hashlib.sha256(media).hexdigest(), feature(payload), row["digest"], row["shard"], row["offset"],
                       row["length"], width, height, depth)
        if opened is not None:
            opened.close()

    def run(batches):
        found = rows(batches)
        while held := list(itertools.islice(found, 1024)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=COLUMNS)

    return run


COLUMNS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard",
           "shard_offset", "shard_length", "width", "height", "bit_depth"]


def store(docs: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Write the payloads; (doc_id, n_bytes, digest) rows, the index and the shards' folder."""
    spark = docs.sparkSession
    root = root or scratch_path(spark, "media-shards")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text")
    padding = F.when(size == 0, F.lit(ROW)).otherwise(F.pmod(-size, F.lit(ROW)))
    payload = F.concat(F.col("text").cast("binary"), F.unhex(F.repeat(F.lit("FF"), padding)))
    rows = materialize(
        texts.select("doc_id", size.cast("long").alias("n_bytes"), F.unhex(F.sha2(payload, 256)).alias("digest")), "media-digests"
    )
    key = F.coalesce("doc_id", F.lit(_NO_ID))
    writers = rows.groupBy("digest").agg(F.min(key).alias("writer"))
    others = materialize(
        rows.join(writers, "digest").filter(key != F.col("writer")).select(key.alias("key"), "digest").distinct(), "media-others"
    )
    shared = spark.sparkContext.broadcast(bitmap.build(others, bitmap.slot_of_id("key")))
    slotted = texts.withColumn("key", key).withColumn("_slot", bitmap.slot_of_id("key"))

    def split(wanted: bool):
        def run(batches):
            for batch in batches:
                hit = bitmap.hits(shared.value, batch.column(3).to_numpy(zero_copy_only=False))
                yield batch.select([1, 2]).filter(pa.array(hit == wanted))

        return slotted.mapInArrow(run, "text string, key long")

    unsure = split(True).withColumn(
        "digest", F.unhex(F.sha2(payload, 256))
    ).join(others, ["key", "digest"], "left_anti").select("text")
    index = materialize(
        split(False).select("text").unionByName(unsure)
        .mapInArrow(_write(root), "digest binary, shard string, offset long, length long"),
        "media-index",
    )
    return rows, index, root


def described(index: DataFrame, root: str) -> DataFrame:
    """One row per digest: columns computed from the payload as read back, its place and its metadata.

    Of equal payloads that two tasks stored, one place is kept.
    """
    return index.mapInArrow(
        _describe(root),
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        "digest binary, shard string, shard_offset long, shard_length long, width long, height long, bit_depth long",
    ).dropDuplicates(["digest"])


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, then the columns of ``described`` (digest in hex)."""
    rows, index, root = store(docs)
    columns = [F.lower(F.hex(c)).alias(c) if c == "digest" else F.col(c) for c in COLUMNS]
    return rows.join(described(index, root), "digest").select("doc_id", "n_bytes", *columns)
