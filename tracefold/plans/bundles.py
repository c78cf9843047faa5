"""Stored final models and one-shot access to held-out data.

A bundle is published in two phases: its tables are written below a folder of their own, their
hashes go into a manifest, and a pointer that names the manifest and its hash comes last.  A
reader follows the pointer, so it sees a whole bundle or none, and a changed byte is refused.

A receipt is a file created with "must not exist": of two runs, one fails.  The store is any
file system that Spark writes to.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracefold.operators import features as X, linear
from tracefold.plans.modelling import FinalModel, FinalPart
from tracefold.protocol import IntegrityError
from tracefold.sources.stores import artifact_drift, artifact_manifest

POINTER = "CURRENT"
#: Features per stored slice of a coefficient row.
SLICE = 1 << 16


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text``; False if it exists already."""
    from py4j.protocol import Py4JJavaError

    target, fs = _path(spark, path)
    try:
        stream = fs.create(target, False)
    except Py4JJavaError:
        if fs.exists(target):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def read_file(spark: SparkSession, path: str) -> str | None:
    """Text of a small file, None if there is none."""
    target, fs = _path(spark, path)
    if not fs.exists(target):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0]["value"] if rows else ""


def _replace_file(spark: SparkSession, path: str, text: str) -> None:
    target, fs = _path(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _coefficient_rows(final: FinalModel) -> list[tuple]:
    return [
        (m.spec.task, i, a, line[a : a + SLICE].tolist())
        for part in final.parts for m in part.models for i, line in enumerate(m.coefficients)
        for a in range(0, len(line), SLICE)
    ]


def publish(spark: SparkSession, final: FinalModel, root: str, identity: dict[str, str]) -> str:
    """Write a bundle and make it the current one; returns its folder name.

    ``identity``: what the model was made from (protocol, membership and the like).
    """
    name = f"bundle-{uuid.uuid4().hex}"
    home = f"{root}/{name}"
    for p, part in enumerate(final.parts):
        for i, vocabulary in enumerate(part.features.vocabularies):
            vocabulary.write.parquet(f"{home}/vocabulary-{p}-{i}")
    schema = "task string, line int, first int, values array<double>"
    spark.createDataFrame(_coefficient_rows(final), schema).write.parquet(f"{home}/coefficients")
    files = [r.asDict() for r in artifact_manifest(spark, home).orderBy("artifact").collect()]
    manifest = json.dumps({
        "identity": identity,
        "parts": [{
            "specs": [asdict(s) for s in part.features.specs], "sizes": list(part.features.sizes),
            "dense_dimension": part.dense_dimension,
            "models": [{"spec": asdict(m.spec), "classes": list(m.classes), "shape": list(m.coefficients.shape)} for m in part.models],
        } for part in final.parts],
        "files": files,
    }, sort_keys=True)
    create_file(spark, f"{home}/MANIFEST.json", manifest)
    _replace_file(spark, f"{root}/{POINTER}", json.dumps({"bundle": name, "sha256": hashlib.sha256(manifest.encode()).hexdigest()}))
    return name


def load(spark: SparkSession, root: str, identity: dict[str, str] | None = None) -> FinalModel:
    """The current bundle, after every hash, width and class list checked out."""
    pointer = read_file(spark, f"{root}/{POINTER}")
    if pointer is None:
        raise IntegrityError(f"{root}: no published model")
    pointer = json.loads(pointer)
    home = f"{root}/{pointer['bundle']}"
    text = read_file(spark, f"{home}/MANIFEST.json") or ""
    if hashlib.sha256(text.encode()).hexdigest() != pointer["sha256"]:
        raise IntegrityError(f"{home}: the manifest differs from its pointer")
    manifest = json.loads(text)
    if identity is not None and manifest["identity"] != identity:
        raise IntegrityError(f"{home}: published for another identity")
    expected = spark.createDataFrame(
        [(f["artifact"], f["sha256"]) for f in manifest["files"]], "artifact string, sha256 string"
    )
    drift = artifact_drift(expected, artifact_manifest(spark, home)).limit(5).collect()
    if drift:
        raise IntegrityError(f"{home}: files differ {[r['artifact'] for r in drift]}")
    lines: dict[tuple[str, int], list] = {}
    for r in spark.read.parquet(f"{home}/coefficients").orderBy("task", "line", "first").collect():
        lines.setdefault((r["task"], r["line"]), []).append(np.array(r["values"], np.float64))
    parts = []
    for p, stored in enumerate(manifest["parts"]):
        features = X.FittedFeatures(
            tuple(X.TermSpec(**s) for s in stored["specs"]),
            tuple(spark.read.parquet(f"{home}/vocabulary-{p}-{i}") for i in range(len(stored["specs"]))),
            tuple(stored["sizes"]),
        )
        width = features.width + stored["dense_dimension"] + 1
        models = []
        for m in stored["models"]:
            task, (count, columns) = m["spec"]["task"], m["shape"]
            block = [np.concatenate(lines[task, i]) for i in range(count)]
            if columns != width or any(len(x) != width for x in block):
                raise IntegrityError(f"{task}: feature width differs from the fitted width")
            models.append(linear.Fitted(linear.Spec(**m["spec"]), tuple(m["classes"]), np.array(block).reshape(count, width)))
        parts.append(FinalPart(features, tuple(models), stored["dense_dimension"]))
    return FinalModel(tuple(parts))


class HeldOutAccess:
    """Receipts of the one scoring run that held-out data allows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def start(self, identity: dict[str, str]) -> None:
        """Claim the run; a second claim is refused, finished or not."""
        receipt = json.dumps({"identity": identity, "started_at": time.time()}, sort_keys=True)
        if not create_file(self.spark, f"{self.root}/started.json", receipt):
            raise IntegrityError(f"held-out data was accessed before: {read_file(self.spark, f'{self.root}/started.json')}")

    def complete(self, results: dict[str, str]) -> None:
        """Record the digests of the finished run."""
        if read_file(self.spark, f"{self.root}/started.json") is None:
            raise IntegrityError("the run was never started")
        receipt = json.dumps({"results": results, "completed_at": time.time()}, sort_keys=True)
        if not create_file(self.spark, f"{self.root}/completed.json", receipt):
            raise IntegrityError("the run was completed before")

    def state(self) -> str:
        for name in ("completed", "started"):
            if read_file(self.spark, f"{self.root}/{name}.json") is not None:
                return name.upper()
        return "UNUSED"


def score_once(
    spark: SparkSession, bundle: str, receipts: str, identity: dict[str, str], texts: DataFrame, labels: DataFrame,
    scheme, positive: dict[str, str], dense: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Load the published model, claim the held-out data, predict every task, then join the labels."""
    from tracefold.plans.modelling import predict_final, score_final
    from tracefold.session import materialize

    final = load(spark, bundle, identity)
    access = HeldOutAccess(spark, receipts)
    access.start(identity)
    predictions = materialize(predict_final(final, texts, dense, positive), "held-out-predictions")
    scored = score_final(predictions, labels, scheme, positive)
    digests = {r["task"]: r["fingerprint"] for r in scored["fingerprints"].select("task", F.col("fingerprint")).collect()}
    access.complete(digests)
    return scored
