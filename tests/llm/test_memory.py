"""Peak memory of tasks, as numpy reports it: the driver's limits leave a Python worker a few hundred MB."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from tracefold.llm import lines, minhash, quality, substrings, words
from tracefold.session import materialize


def _peak(run) -> float:
    """MB that ``run`` holds at most, without the powers that are kept."""
    for kind in ("up", "down"):
        words._power(kind, words.PIECE)
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def _texts(size: int, count: int) -> pa.RecordBatch:
    letters = np.random.default_rng(7).integers(97, 123, (count, size), dtype=np.uint8)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(count), pa.int64()), pa.array([row.tobytes().decode() for row in letters])], names=["doc_id", "text"]
    )


def _lines(size: int, count: int) -> pa.RecordBatch:
    letters = np.random.default_rng(7).integers(97, 123, (count, size), dtype=np.uint8)
    letters[:, 5::6] = 32
    letters[:, 47::48] = 10
    return pa.RecordBatch.from_arrays(
        [pa.array(range(count), pa.int64()), pa.array([row.tobytes().decode() for row in letters])], names=["doc_id", "text"]
    )


def test_op8_anchor_blocks_memory():
    batch = _texts(2000, 7000)
    found = [0]

    def run():
        for out in substrings._anchor_blocks(240)(iter([batch])):
            found[0] += sum(len(substrings._unpack(x.as_py())) for x in out.column(1))

    assert _peak(run) < 64
    whole = sum(len(substrings.anchors(d, o)[0]) for _, _, d, o in words.pieces(batch.column(1)))
    assert found[0] == whole > 0


def test_pipeline_stage_memory():
    """Scoring, line keys and signatures of the pipeline's stages, on one Arrow batch each."""
    batch = _lines(2000, 7000)
    texts = batch.select(["text"])
    assert _peak(lambda: [None for _ in lines._blocks(240, lines.edit_ranges(1, lines.TAU))(iter([texts]))]) < 64
    assert _peak(lambda: [None for _ in minhash._describe(5, False)(iter([batch]))]) < 12
    for _, _, data, offsets in words.pieces(batch.column(1)):
        assert _peak(lambda data=data, offsets=offsets: quality.features(data, offsets)) < 24
        break


def test_written_tables_pass_python_in_small_batches(spark):
    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    texts = spark.range(4000, numPartitions=1).selectExpr("repeat('abcdefgh', 800) as text")
    sizes = [r.n for r in materialize(texts.mapInArrow(rows, "n long"), "batches").collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != "4m"
