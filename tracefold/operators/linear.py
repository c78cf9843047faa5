"""Linear classifiers trained together: every pass over the rows serves all fits.

The fits of one feature table differ in task, loss, class weight and cost.  Their coefficients form
one block (a column per class, a row per feature and one for the bias).  Each pass sends the block
to the tasks, which return sums of losses and gradients, or of Hessian-vector products, added up
in slices of the block; rows are never gathered.

Objectives, with the cost C and the weight of a row's class:

* LOGREG, two classes: C * sum(weight * log loss) + (|w|^2 + bias^2) / 2;
* LOGREG, more classes: softmax, and the bias is not penalised;
* LINEARSVC: squared hinge, one class against the others, bias penalised; with more than two classes the
  weight counts for rows of the column's own class only.

Each column (softmax: each fit) is one smooth convex problem for a trust-region Newton method with
conjugate gradients.  Problems advance in step and leave when their gradient is small
relative to the first one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from tracefold.functions.scores import class_index

# Iteration limits of the benchmark.
MAX_ITER = {"LOGREG": 1000, "LINEARSVC": 5000}
TOLERANCE = 1e-4
#: Entries of a block of rows; entries that are multiplied at a time, so that they stay in a core's cache;
#: entries of a task, at most and at least.
BLOCK_ENTRIES, PIECE, TASK_MOST, TASK_LEAST = 1 << 20, 1 << 14, 1 << 25, 1 << 20
#: Parts of the coefficients that are added up apart.
SLICES = 64

_PACKED = "n int, row binary, feature binary, value binary, codes binary"


@dataclass(frozen=True)
class Spec:
    """One fit: its key, task, loss and costs."""

    key: str
    task: str
    classifier: str
    class_weight: str = "NONE"
    c: float = 1.0
    max_iter: int | None = None

    def limit(self) -> int:
        if self.classifier not in MAX_ITER:
            raise ValueError(f"unknown classifier: {self.classifier}")
        return self.max_iter if self.max_iter is not None else MAX_ITER[self.classifier]


@dataclass(frozen=True)
class Problem:
    """Columns ``first`` to ``first + count`` of the block and their loss."""

    kind: str  # SOFTMAX, LOGISTIC or HINGE
    task: int
    positive: int  # class code of the positive side of a one-column problem
    costs: tuple[float, ...]  # per class code
    count: int
    bias: bool  # whether the bias is penalised
    limit: int


@dataclass(frozen=True)
class Fitted:
    """Coefficients of one fit: a row per column, features and then the bias."""

    spec: Spec
    classes: tuple[str, ...]
    coefficients: np.ndarray


def problems_of(spec: Spec, task: int, counts: Sequence[int]) -> list[Problem]:
    """``counts``: training rows per class code."""
    total, many = sum(counts), len(counts)
    weight = [total / (many * n) for n in counts] if spec.class_weight != "NONE" else [1.0] * many
    own = tuple(spec.c * w for w in weight)
    limit = spec.limit()
    if many == 1:
        return []
    if spec.classifier == "LOGREG":
        if many == 2:
            return [Problem("LOGISTIC", task, 1, own, 1, True, limit)]
        return [Problem("SOFTMAX", task, -1, own, many, False, limit)]
    if many == 2:
        return [Problem("HINGE", task, 1, own, 1, True, limit)]
    return [
        Problem("HINGE", task, k, tuple(own[k] if j == k else spec.c for j in range(many)), 1, True, limit)
        for k in range(many)
    ]


# -- blocks of rows ---------------------------------------------------------------------------


def _strides(size: int) -> np.ndarray:
    return np.argsort(np.arange(size) % max(1, int(size**0.5)), kind="stable")


def _block(rows: list[tuple]) -> pa.RecordBatch:
    """Rows as arrays.  The entries are ordered by feature, unless all rows have the same features.

    Inside a piece they are dealt in strides, so that neighbours rarely add to the same feature or row:
    a sum that waits for the one before it takes twice as long.
    """
    n = len(rows)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(r[0]) for r in rows])
    feature = np.concatenate([r[0] for r in rows]).astype(np.int32)
    value = np.concatenate([r[1] for r in rows]).astype(np.float64)
    if _dense_rows(n, row, feature) is None:
        order = np.argsort(feature, kind="stable")
        order = np.concatenate([order[a : a + PIECE][_strides(min(PIECE, len(order) - a))] for a in range(0, len(order), PIECE)])
        row, feature, value = row[order], feature[order], value[order]
    return pa.RecordBatch.from_arrays(
        [pa.array([n], pa.int32())]
        + [pa.array([x.tobytes()], pa.binary()) for x in (row, feature, value, np.array([r[2] for r in rows], np.int32))],
        names=["n", "row", "feature", "value", "codes"],
    )


def _pack(tasks: int):
    def run(batches):
        held, entries = [], 0
        for batch in batches:
            index, value = batch.column(0), batch.column(1)
            codes = [batch.column(2 + t).to_pylist() for t in range(tasks)]
            for i in range(batch.num_rows):
                held.append((
                    index[i].values.to_numpy(zero_copy_only=False), value[i].values.to_numpy(zero_copy_only=False),
                    [c[i] for c in codes],
                ))
                entries += len(held[-1][0]) + 1
                if entries > BLOCK_ENTRIES:
                    yield _block(held)
                    held, entries = [], 0
        if held:
            yield _block(held)

    return run


def _arrays(block: tuple) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, row, feature, value, codes = block
    return (n, np.frombuffer(row, np.int32), np.frombuffer(feature, np.int32),
            np.frombuffer(value, np.float64), np.frombuffer(codes, np.int32).reshape(n, -1))


def _dense(n: int, feature: np.ndarray) -> np.ndarray | None:
    """The features of a block whose rows all have the same ones, each once; else None."""
    k = len(feature) // n if n else 0
    if not k or len(feature) != n * k:
        return None
    table = feature.reshape(n, k)
    one = table[0]
    return one if (table == one).all() and len(np.unique(one)) == k else None


def _dense_rows(n: int, row: np.ndarray, feature: np.ndarray) -> np.ndarray | None:
    dense = _dense(n, feature)
    # Equal row sizes alone would not do: the features of a product are those of every row.
    if dense is not None and not (np.bincount(row, minlength=n) == len(dense)).all():
        return None
    return dense


def _products(n, row, feature, value, columns: np.ndarray, dense: np.ndarray | None = None) -> np.ndarray:
    """Rows times coefficients (a row of ``columns`` per column, bias last)."""
    if dense is not None:
        return value.reshape(n, -1) @ columns[:, dense].T + columns[:, -1]
    out = np.empty((n, len(columns)))
    for m, c in enumerate(columns):
        out[:, m] = np.bincount(row, value * c[feature], n) + c[-1]
    return out


def _pieces(row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> list[tuple]:
    """(first feature, features, feature from the first on, row, value) of entries as ``_block`` orders them."""
    out = []
    for a in range(0, len(value), PIECE):
        number = feature[a : a + PIECE].astype(np.intp)
        first = int(number.min())
        number -= first
        out.append((first, int(number.max()) + 1, number, row[a : a + PIECE].astype(np.intp), value[a : a + PIECE]))
    return out


def _forward(n: int, pieces: list[tuple], columns: np.ndarray) -> np.ndarray:
    """``_products`` of pieces: few features and the rows of a block, so that no access is far."""
    out, buffer = np.zeros((len(columns), n)), np.empty(PIECE)
    for first, many, number, row, value in pieces:
        part = buffer[: len(value)]
        for z, c in zip(out, columns):
            np.take(c[first : first + many], number, out=part, mode="clip")
            part *= value
            z += np.bincount(row, part, n)
    return (out + columns[:, -1:]).T


def _backward(pieces: list[tuple], sums: np.ndarray, out: np.ndarray) -> None:
    """Add the factors of rows (a row of ``sums`` per column) times their entries to ``out``."""
    buffer = np.empty(PIECE)
    for first, many, number, row, value in pieces:
        part = buffer[: len(value)]
        for total, s in zip(out, sums):
            np.take(s, row, out=part, mode="clip")
            part *= value
            total[first : first + many] += np.bincount(number, part, many)


def _sums(problem: Problem, codes: np.ndarray, z: np.ndarray, u: np.ndarray | None) -> tuple[float, np.ndarray]:
    """Loss, and per row and column the factor of the gradient (or, with ``u``, of the Hessian product)."""
    y = codes[:, problem.task]
    cost = np.array(problem.costs)[y]
    if problem.kind == "SOFTMAX":
        top = z.max(1, keepdims=True)
        p = np.exp(z - top)
        total = p.sum(1, keepdims=True)
        p /= total
        if u is not None:
            return 0.0, cost[:, None] * p * (u - (p * u).sum(1, keepdims=True))
        own = z[np.arange(len(y)), y]
        p[np.arange(len(y)), y] -= 1
        return float((cost * (top[:, 0] + np.log(total[:, 0]) - own)).sum()), cost[:, None] * p
    side = np.where(y == problem.positive, 1.0, -1.0)
    margin = side * z[:, 0]
    if problem.kind == "LOGISTIC":
        loss = np.logaddexp(0, -margin)
        miss = np.exp(-np.logaddexp(0, margin))  # probability of the other side
        if u is not None:
            return 0.0, (cost * miss * (1 - miss) * u[:, 0])[:, None]
        return float((cost * loss).sum()), (-cost * side * miss)[:, None]
    gap = np.maximum(0, 1 - margin)
    if u is not None:
        return 0.0, (2 * cost * (gap > 0) * u[:, 0])[:, None]
    return float((cost * gap * gap).sum()), (-2 * cost * side * gap)[:, None]


def _add(pairs):
    """Sum of the parts of one slice, in the order of their tasks."""
    loss = out = None
    for _, (_, f, part) in sorted(pairs, key=lambda p: p[1][0]):
        loss, out = (f, part) if loss is None else (loss + f, out + part)
    if loss is not None:
        yield loss, out


def _pass(blocks, context, work: list[tuple[Problem, np.ndarray, np.ndarray | None]], width: int):
    """Losses, and gradients or Hessian products, of all ``work`` over all rows."""
    shared = context.broadcast(work)
    slices = min(blocks.getNumPartitions(), SLICES)
    edges = np.linspace(0, width + 1, slices + 1).astype(int)

    def run(index, rows):
        jobs = shared.value
        loss = np.zeros(len(jobs))
        out = np.zeros((sum(p.count for p, _, _ in jobs), width + 1))
        columns = np.concatenate([x for _, x, _ in jobs] + [x for _, _, x in jobs if x is not None])
        for block in rows:
            n, row, feature, value, codes = _arrays(block)
            dense = _dense_rows(n, row, feature)
            if dense is not None:
                both = _products(n, row, feature, value, columns, dense)
            else:
                pieces = _pieces(row, feature, value)
                both = _forward(n, pieces, columns)
            z, u = both[:, : len(out)], both[:, len(out) :]
            sums = np.empty((len(out), n))
            at = at_v = 0
            for i, (problem, _, direction) in enumerate(jobs):
                cut, own = slice(at, at + problem.count), None
                if direction is not None:
                    own = u[:, at_v : at_v + problem.count]
                    at_v += problem.count
                f, r = _sums(problem, codes, z[:, cut], own)
                loss[i] += f
                sums[cut] = r.T
                at = cut.stop
            out[:, -1] += sums.sum(1)
            if dense is not None:
                out[:, dense] += sums @ value.reshape(n, -1)
            else:
                _backward(pieces, sums, out)
        for k in range(slices):
            yield k, (index, loss, out[:, edges[k] : edges[k + 1]])

    parts = blocks.mapPartitionsWithIndex(run)
    if slices > 1:
        # Each slice of the coefficients is added up by a task of its own.
        parts = parts.partitionBy(slices, lambda k: k)
    added = parts.mapPartitions(_add).collect()
    shared.destroy()
    loss, out = added[0][0], np.concatenate([part for _, part in added], axis=1)
    at, parts = 0, []
    for problem, _, _ in work:
        parts.append(out[at : at + problem.count])
        at += problem.count
    return loss, parts


# -- trust-region Newton ----------------------------------------------------------------------


class _Newton:
    """State of one problem; ``ask`` says what it needs from the next pass, ``take`` uses it."""

    ACCEPT, GOOD, BEST = 1e-4, 0.25, 0.75

    def __init__(self, problem: Problem, width: int):
        self.problem, self.done, self.steps = problem, False, 0
        self.w = np.zeros((problem.count, width + 1))
        self.f = self.g = self.s = None

    def _penalty(self, x: np.ndarray) -> np.ndarray:
        if self.problem.bias:
            return x
        kept = x.copy()
        kept[:, -1] = 0
        return kept

    def ask(self) -> tuple[np.ndarray, np.ndarray | None]:
        if self.g is None:
            return self.w, None
        return (self.w + self.s, None) if self.d is None else (self.w, self.d)

    def take(self, loss: float, sums: np.ndarray) -> None:
        if self.g is not None and self.d is not None:
            self._conjugate(sums + self._penalty(self.d))
            return
        at = self.w if self.g is None else self.w + self.s
        f = loss + 0.5 * float((self._penalty(at) * at).sum())
        g = sums + self._penalty(at)
        if self.g is None:
            self.f, self.g = f, g
            self.first = self.radius = float(np.linalg.norm(g))
        else:
            self._judge(at, f, g)
        if self.steps >= self.problem.limit or np.linalg.norm(self.g) <= TOLERANCE * self.first:
            self.done = True
        else:
            self.s, self.r, self.d = np.zeros_like(self.g), -self.g, -self.g

    def _conjugate(self, product: np.ndarray) -> None:
        rr = float((self.r * self.r).sum())
        curve = float((self.d * product).sum())
        step = rr / curve if curve > 0 else np.inf
        s = self.s + step * self.d if np.isfinite(step) else None
        if s is None or np.linalg.norm(s) > self.radius:
            # To the border of the region.
            dd, sd, ss = (float((a * b).sum()) for a, b in ((self.d, self.d), (self.s, self.d), (self.s, self.s)))
            rest = max(self.radius**2 - ss, 0.0)
            step = rest / (sd + np.sqrt(max(sd * sd + dd * rest, 0.0))) if rest else 0.0
            self.s, self.r, self.d = self.s + step * self.d, self.r - step * product, None
            return
        self.s, self.r = s, self.r - step * product
        after = float((self.r * self.r).sum())
        if np.sqrt(after) <= 0.1 * np.linalg.norm(self.g):
            self.d = None
        else:
            self.d = self.r + after / rr * self.d

    def _judge(self, at: np.ndarray, f: float, g: np.ndarray) -> None:
        self.steps += 1
        size = float(np.linalg.norm(self.s))
        slope = float((self.g * self.s).sum())
        predicted = -0.5 * (slope - float((self.s * self.r).sum()))
        actual = self.f - f
        if self.steps == 1:
            self.radius = min(self.radius, size)
        bend = f - self.f - slope
        scale = 4.0 if bend <= 0 else max(0.25, -0.5 * slope / bend)
        if actual < self.ACCEPT * predicted:
            self.radius = min(max(scale, 0.25) * size, 0.5 * self.radius)
        elif actual < self.GOOD * predicted:
            self.radius = max(0.25 * self.radius, min(scale * size, 0.5 * self.radius))
        elif actual < self.BEST * predicted:
            self.radius = max(0.25 * self.radius, min(scale * size, 4 * self.radius))
        else:
            self.radius = max(self.radius, min(scale * size, 4 * self.radius))
        # A step that is lost in rounding ends the problem.
        if abs(actual) <= 1e-13 * abs(self.f) and abs(predicted) <= 1e-13 * abs(self.f):
            self.steps = self.problem.limit
        if actual > self.ACCEPT * predicted:
            self.w, self.f, self.g = at, f, g


def class_counts(train: DataFrame, targets: dict[str, str]) -> dict[str, dict[str, int]]:
    """Rows per class of every task; ``targets``: column per task.  The class lists bound the result."""
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(c).alias("y")) for t, c in targets.items()]))
    counts: dict[str, dict[str, int]] = {t: {} for t in targets}
    for r in train.select(pairs.alias("p")).groupBy("p.task", "p.y").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["task"]][r["y"]] = r["n"]
    return counts


def train(
    rows: DataFrame, width: int, targets: dict[str, str], orders: dict[str, Sequence[str]], specs: Sequence[Spec]
) -> list[Fitted]:
    """Fit all ``specs`` on ``rows`` (indices, values and a column per task of ``targets``)."""
    counts = class_counts(rows, targets)
    present = {t: tuple(c for c in orders[t] if counts[t].get(c)) for t in targets}
    tasks = list(targets)
    context = rows.sparkSession.sparkContext
    entries = rows.agg(F.sum(F.size("indices") + 1).alias("n")).first()["n"] or 0
    # A task per core, unless it had so few entries that its start would cost more, or very many.
    most = max(context.defaultParallelism, -(-entries // TASK_MOST))
    codes = [class_index(F.col(targets[t]), present[t]).cast("int").alias(f"_code_{t}") for t in tasks]
    # Dealt out evenly: every pass waits for its largest task.
    packed = rows.select("indices", "values", *codes).repartition(min(most, max(1, -(-entries // TASK_LEAST))))
    # Kept on disk as Python wrote them: a pass neither decodes files nor converts rows.
    blocks = packed.mapInArrow(_pack(len(tasks)), _PACKED).rdd.map(tuple).persist(StorageLevel.DISK_ONLY)
    states = {
        i: [_Newton(p, width) for p in problems_of(s, tasks.index(s.task), [counts[s.task][c] for c in present[s.task]])]
        for i, s in enumerate(specs)
    }
    active = [n for ns in states.values() for n in ns]
    try:
        while active:
            work = [(n.problem, *n.ask()) for n in active]
            loss, parts = _pass(blocks, context, work, width)
            for n, f, part in zip(active, loss.tolist(), parts, strict=True):
                n.take(f, part)
            active = [n for n in active if not n.done]
    finally:
        blocks.unpersist()
    return [
        Fitted(s, present[s.task], np.concatenate([n.w for n in states[i]]) if states[i] else np.zeros((0, width + 1)))
        for i, s in enumerate(specs)
    ]


PREDICTED = "stable_id string, fit string, task string, y_true string, y_pred string, score double"


def decide(fitted: Fitted, z: np.ndarray, positive: str | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Class numbers, and for a probabilistic fit the probability of ``positive``."""
    classes = fitted.classes
    if z.shape[1] == 0:  # one class in training
        return np.zeros(len(z), np.int64), None
    if len(classes) == 2:
        chosen = (z[:, 0] > 0).astype(np.int64)
        p = np.column_stack([np.exp(-np.logaddexp(0, z[:, 0])), np.exp(-np.logaddexp(0, -z[:, 0]))])
    else:
        chosen = z.argmax(1)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
    if fitted.spec.classifier != "LOGREG" or positive not in classes:
        return chosen, None
    return chosen, p[:, classes.index(positive)]


def predict(
    rows: DataFrame, models: Sequence[Fitted], targets: dict[str, str] | None = None,
    positive: dict[str, str] | None = None,
) -> DataFrame:
    """stable_id, fit, task, y_true, y_pred, score of every row under every fit.

    ``rows``: stable_id, indices, values and the columns of ``targets`` (y_true is null without them);
    ``positive``: class whose probability is the score, per task; the score is null elsewhere.
    """
    shared = rows.sparkSession.sparkContext.broadcast(list(models))
    known, wanted = dict(targets or {}), dict(positive or {})
    place = {task: 3 + i for i, task in enumerate(known)}

    def run(batches):
        models = shared.value
        columns = np.concatenate([m.coefficients for m in models])
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            feature = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            value = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            z = _products(batch.num_rows, row, feature, value, columns)
            at, n = 0, batch.num_rows
            for m in models:
                own = z[:, at : at + len(m.coefficients)]
                at += len(m.coefficients)
                chosen, score = decide(m, own, wanted.get(m.spec.task))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array([m.spec.key] * n, pa.string()), pa.array([m.spec.task] * n, pa.string()),
                    batch.column(place[m.spec.task]) if m.spec.task in place else pa.nulls(n, pa.string()),
                    pa.array(np.array(m.classes, object)[chosen], pa.string()),
                    pa.nulls(n, pa.float64()) if score is None else pa.array(score),
                ], names=["stable_id", "fit", "task", "y_true", "y_pred", "score"])

    return rows.select("stable_id", "indices", "values", *[F.col(c) for c in known.values()]).mapInArrow(run, PREDICTED)
