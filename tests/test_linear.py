"""The joint solver against plain optimisation of the stated objectives."""

from __future__ import annotations

import numpy as np
import pytest

from tracefold.operators import linear as L

ORDERS = {"M": ("a", "b", "c", "d"), "B": ("neg", "pos")}


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(4)
    x = r.normal(size=(150, 9)) * (r.random((150, 9)) < 0.6)
    y = (x @ r.normal(size=(9, 4)) + r.normal(size=(150, 4))).argmax(1)
    return x, y


def objective(spec, x, codes, classes, w):
    """The value that ``spec`` minimises, written out per class."""
    z = np.c_[x, np.ones(len(x))] @ w.T
    n = np.bincount(codes, minlength=classes)
    weight = len(codes) / (classes * n) if spec.class_weight == "BALANCED" else np.ones(classes)
    if spec.classifier == "LOGREG" and classes > 2:
        loss = np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(z)), codes]
        return spec.c * (weight[codes] * loss).sum() + (w[:, :-1] ** 2).sum() / 2
    total = (w**2).sum() / 2
    for k in range(len(w)):
        positive = k if len(w) > 1 else 1
        own = codes == positive
        margin = np.where(own, 1, -1) * z[:, k]
        cost = weight[codes] if classes == 2 else np.where(own, weight[positive], 1.0)
        loss = np.logaddexp(0, -margin) if spec.classifier == "LOGREG" else np.maximum(0, 1 - margin) ** 2
        total += spec.c * (cost * loss).sum()
    return total


def slope(spec, x, codes, classes, w):
    """Numerical gradient of the objective."""
    gradient = np.zeros_like(w)
    for at in np.ndindex(w.shape):
        step = np.zeros_like(w)
        step[at] = 1e-5
        up, down = (objective(spec, x, codes, classes, w + s * step) for s in (1, -1))
        gradient[at] = (up - down) / 2e-5
    return gradient


def test_every_fit_reaches_its_optimum(spark, data):
    x, y = data
    names = [(ORDERS["M"][k], ORDERS["B"][int(k > 0)]) for k in y]
    rows = spark.createDataFrame(
        [(str(i), np.flatnonzero(v).tolist(), v[np.flatnonzero(v)].tolist(), m, b) for i, (v, (m, b)) in enumerate(zip(x, names))],
        "stable_id string, indices array<int>, values array<double>, m string, b string",
    ).repartition(3)
    targets = {"M": "m", "B": "b"}
    specs = [L.Spec(f"{t}{c}{w}{cost}", t, c, w, cost) for t in targets for c in ("LOGREG", "LINEARSVC")
             for w in ("NONE", "BALANCED") for cost in (0.5, 4.0)]
    fitted = L.train(rows, 9, targets, ORDERS, specs)
    r = np.random.default_rng(1)
    for f in fitted:
        codes, classes = (y, 4) if f.spec.task == "M" else ((y > 0).astype(int), 2)
        best = objective(f.spec, x, codes, classes, f.coefficients)
        gradient = slope(f.spec, x, codes, classes, f.coefficients)
        start = slope(f.spec, x, codes, classes, np.zeros_like(gradient))
        assert np.linalg.norm(gradient) <= 1.1 * L.TOLERANCE * np.linalg.norm(start), f.spec
        for size in (1e-2, 0.1, 1.0):
            assert objective(f.spec, x, codes, classes, f.coefficients + size * r.normal(size=gradient.shape)) > best
    guessed = {(p["fit"], p["stable_id"]): p for p in L.predict(rows, fitted, targets, {"B": "pos"}).collect()}
    for f in fitted:
        z = np.c_[x, np.ones(len(x))] @ f.coefficients.T
        codes = z.argmax(1) if f.spec.task == "M" else (z[:, 0] > 0).astype(int)
        for i in range(len(x)):
            p = guessed[f.spec.key, str(i)]
            assert p["y_pred"] == f.classes[codes[i]] and p["y_true"] == names[i][f.spec.task == "B"]
            scored = f.spec.task == "B" and f.spec.classifier == "LOGREG"
            assert (p["score"] == pytest.approx(1 / (1 + np.exp(-z[i, 0])))) if scored else p["score"] is None


def test_absent_classes_empty_rows_and_limits(spark):
    rows = spark.createDataFrame(
        [("1", [0], [1.0], "a"), ("2", [], [], "a"), ("3", [1], [2.0], "c")],
        "stable_id string, indices array<int>, values array<double>, m string",
    )
    two = L.train(rows, 2, {"M": "m"}, ORDERS, [L.Spec("k", "M", "LINEARSVC", "BALANCED")])[0]
    assert two.classes == ("a", "c") and two.coefficients.shape == (1, 3)
    one = L.train(rows.filter("m = 'a'"), 2, {"M": "m"}, ORDERS, [L.Spec("k", "M", "LOGREG")])[0]
    assert {r["y_pred"] for r in L.predict(rows, [one]).collect()} == {"a"}
    short = L.train(rows, 2, {"M": "m"}, ORDERS, [L.Spec("k", "M", "LOGREG", max_iter=0)])[0]
    assert not short.coefficients.any()
    with pytest.raises(ValueError, match="unknown classifier"):
        L.train(rows, 2, {"M": "m"}, ORDERS, [L.Spec("k", "M", "OTHER")])


def test_a_dense_block_is_multiplied_whole():
    rng = np.random.default_rng(2)
    n, k, width = 7, 4, 9
    feature = np.tile(np.array([8, 1, 3, 5], np.int32), n)
    row, value, w = np.repeat(np.arange(n), k), rng.normal(size=n * k), rng.normal(size=(3, width + 1))
    dense = L._dense(n, feature)
    assert dense.tolist() == [8, 1, 3, 5]
    assert np.allclose(L._products(n, row, feature, value, w, dense), L._products(n, row, feature, value, w))
    assert L._dense(n, np.r_[feature[:-1], 2]) is None
    assert L._dense(n, np.zeros(n * k, np.int32)) is None


def test_entries_by_feature_give_the_products_of_rows(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 16)
    r = np.random.default_rng(3)
    n, width = 40, 30
    x = r.normal(size=(n, width)) * (r.random((n, width)) < 0.2)
    x[5] = 0
    x[:, 7] = 1
    block = L._block([(np.flatnonzero(v), v[np.flatnonzero(v)], [0]) for v in x]).to_pylist()[0]
    many, row, feature, value, _ = L._arrays(tuple(block.values()))
    assert many == n and len(value) == np.count_nonzero(x)
    pieces = L._pieces(row, feature, value)
    assert max(len(p[-1]) for p in pieces) == 16
    # A piece ends at most at the feature where the next one begins.
    assert all(a[0] + a[1] - 1 <= b[0] for a, b in zip(pieces[:-1], pieces[1:]))
    columns, sums, out = r.normal(size=(3, width + 1)), r.normal(size=(3, n)), np.zeros((3, width + 1))
    assert np.allclose(L._forward(n, pieces, columns), x @ columns[:, :-1].T + columns[:, -1])
    L._backward(pieces, sums, out)
    assert np.allclose(out[:, :-1], sums @ x) and not out[:, -1].any()


def test_passes_read_blocks_that_were_packed_once(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(str(i), [i % 5, 5 + i % 2], [1.0, 0.5], "abcd"[i % 4]) for i in range(200)],
        "stable_id string, indices array<int>, values array<double>, m string",
    ).repartition(9)
    parts, plain = [], L._pass
    monkeypatch.setattr(L, "_pass", lambda blocks, *rest: (parts.append((blocks.getNumPartitions(), blocks.getStorageLevel())), plain(blocks, *rest))[1])
    L.train(rows, 7, {"M": "m"}, ORDERS, [L.Spec("k", "M", "LOGREG")])
    assert len(parts) > 1 and all(n == 1 and level.useDisk and not level.useMemory for n, level in parts)
