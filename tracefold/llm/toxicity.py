"""Toxicity: bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are words (runs of letters, lower-cased in A-Z; a longer run is cut every 24 bytes).
A word's vector joins a hashed word embedding with an attention-pooled bidirectional GRU over
its bytes.  A second bidirectional GRU with attention pooling reads windows of 16 words that
overlap by half and cover every word; a document scores as its most toxic window.

Training is multiple-instance: a toxic document teaches by its most suspicious window, a
clean one by its most suspicious and by random windows.  The first choice of windows comes
from smoothed word log-odds, later ones from the network itself.  At most ``MAX_PER_CLASS``
toxic and twice as many clean labelled documents are read (those with the smallest hash of
their id).  The
model is a few hundred kilobytes whatever the corpus.

Defined cases: null and empty texts have one empty window and score the bias.  Null labels
are ignored; a repeated label of one id counts once, the smallest value.  Without both
classes every score is 0.  Rows are scored one by one, so repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracefold.llm.words import LOWER, U, mix, pieces, prefix_hashes, run_hashes, runs

WINDOW, STRIDE, PIECE_BYTES = 16, 8, 24
MAX_PER_CLASS = 900
EPOCHS, MIN_STEPS = 8, 250
CACHE_WORDS = 200_000
_LOG, _DIM, _HIDDEN = 13, 8, 8

_LETTER = np.zeros(256, np.uint8)
for _a, _b in ((65, 91), (97, 123), (128, 256)):
    _LETTER[_a:_b] = 1


def _sigmoid(x):
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def find_words(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, starts, ends, hashes and first word number per text."""
    low = LOWER[data]
    starts, ends = runs(low, offsets, _LETTER[low])
    parts = -(-(ends - starts) // PIECE_BYTES)
    if len(parts) and parts.max() > 1:
        begin = np.repeat(starts, parts)
        nth = np.arange(len(begin)) - np.repeat(np.cumsum(parts) - parts, parts)
        stop = np.repeat(ends, parts)
        starts = begin + nth * PIECE_BYTES
        ends = np.minimum(starts + PIECE_BYTES, stop)
    return low, starts, ends, run_hashes(prefix_hashes(low), starts, ends), np.searchsorted(starts, offsets)


def window_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and word count of every window, and the first window per text."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    head = np.r_[0, np.cumsum(count)]
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(head[-1]) - head[text]
    offset = np.minimum(nth * STRIDE, np.maximum(0, n[text] - WINDOW))
    return first[text] + offset, np.minimum(WINDOW, n[text]), head


class Layer:
    """One direction pair of GRUs with attention pooling over time; forward and backward."""

    def __init__(self, p: dict, name: str):
        self.p, self.name = p, name

    def _run(self, proj, mask, u):
        """States of one direction; proj (T, B, 3H) holds the input parts of the gates."""
        steps, batch, _ = proj.shape
        h = np.zeros((batch, _HIDDEN), np.float32)
        out = np.empty((steps, batch, _HIDDEN), np.float32)
        saved = []
        for t in range(steps):
            rec = h @ u
            gates = _sigmoid(proj[t, :, : 2 * _HIDDEN] + rec[:, : 2 * _HIDDEN])
            r, z = gates[:, :_HIDDEN], gates[:, _HIDDEN:]
            new = np.tanh(proj[t, :, 2 * _HIDDEN :] + r * rec[:, 2 * _HIDDEN :])
            step = new + z * (h - new)
            m = mask[t][:, None]
            saved.append((h, r, z, new, rec[:, 2 * _HIDDEN :], m))
            h = np.where(m, step, h)
            out[t] = h
        return out, saved

    def forward(self, proj, mask, keep=False):
        """Pooled vectors (B, 2H) from gate inputs (T, B, 6H) and a mask (T, B)."""
        side = 3 * _HIDDEN
        ahead, saved_a = self._run(proj[:, :, :side], mask, self.p[self.name + "u0"])
        back, saved_b = self._run(proj[::-1, :, side:], mask[::-1], self.p[self.name + "u1"])
        states = np.concatenate([ahead, back[::-1]], 2)
        score = np.where(mask, states @ self.p[self.name + "v"], np.float32(-30))
        weight = np.exp(score - score.max(0))
        weight *= mask
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return pooled, (states, weight, saved_a, saved_b) if keep else None

    def _back(self, d_out, saved, u, grad, key):
        d_proj = np.empty((len(saved), d_out.shape[1], 3 * _HIDDEN), np.float32)
        d_h = np.zeros_like(d_out[0])
        for t in range(len(saved) - 1, -1, -1):
            h, r, z, new, rec_n, m = saved[t]
            d = d_h + d_out[t]
            d_step = np.where(m, d, 0)
            d_new = d_step * (1 - z) * (1 - new * new)
            d_z = d_step * (h - new) * z * (1 - z)
            d_r = d_new * rec_n * r * (1 - r)
            d_proj[t] = np.concatenate([d_r, d_z, d_new], 1)
            d_rec = np.concatenate([d_r, d_z, d_new * r], 1)
            grad[key] += h.T @ d_rec
            d_h = np.where(m, 0, d) + d_step * z + d_rec @ u.T
        return d_proj

    def backward(self, d_pooled, kept, grad):
        """Gradient of the gate inputs; adds the parameters' gradients to ``grad``."""
        states, weight, saved_a, saved_b = kept
        v = self.p[self.name + "v"]
        along = np.einsum("bh,tbh->tb", d_pooled, states)
        d_score = weight * (along - (weight * along).sum(0))
        grad[self.name + "v"] += np.einsum("tb,tbh->h", d_score, states)
        d_states = weight[:, :, None] * d_pooled[None] + d_score[:, :, None] * v
        ahead = self._back(d_states[:, :, :_HIDDEN], saved_a, self.p[self.name + "u0"], grad, self.name + "u0")
        back = self._back(d_states[::-1, :, _HIDDEN:], saved_b, self.p[self.name + "u1"], grad, self.name + "u1")
        return np.concatenate([ahead, back[::-1]], 2)


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h = _HIDDEN

        def normal(*shape, scale):
            return r.normal(0, scale, shape).astype(np.float32)

        self.p = {
            "chars": normal(256, 6 * h, scale=0.5), "words": normal(1 << _LOG, _DIM, scale=0.1),
            "w": normal(_DIM + 2 * h, 6 * h, scale=0.25), "b": np.zeros(6 * h, np.float32),
            "out": normal(2 * h, scale=0.3), "bias": np.zeros(1, np.float32),
        }
        for name in ("c", "s"):
            self.p |= {name + "u0": normal(h, 3 * h, scale=0.3), name + "u1": normal(h, 3 * h, scale=0.3), name + "v": normal(2 * h, scale=0.3)}
        self.char, self.seq = Layer(self.p, "c"), Layer(self.p, "s")

    def _chars(self, low, starts, ends):
        size = ends - starts
        at = starts[None, :] + np.arange(size.max(initial=1))[:, None]
        mask = at < ends[None, :]
        return low[np.minimum(at, len(low) - 1)], mask

    def gates(self, low, starts, ends, hashes):
        """Gate inputs (words, 6H) of words, computed in groups of like length."""
        out = np.empty((len(starts), 6 * _HIDDEN), np.float32)
        order = np.argsort(ends - starts, kind="stable")
        for a in range(0, len(order), 2048):
            part = order[a : a + 2048]
            codes, mask = self._chars(low, starts[part], ends[part])
            pooled, _ = self.char.forward(self.p["chars"][codes], mask)
            x = np.concatenate([self.p["words"][(hashes[part] >> U(64 - _LOG)).astype(np.int64)], pooled], 1)
            out[part] = x @ self.p["w"] + self.p["b"]
        return out

    def logits(self, table, index, starts, count):
        """Window logits from gate inputs of distinct words and each word's row in them."""
        out = np.empty(len(starts), np.float32)
        for a in range(0, len(starts), 4096):
            at = starts[None, a : a + 4096] + np.arange(WINDOW)[:, None]
            mask = np.arange(WINDOW)[:, None] < count[None, a : a + 4096]
            if len(index):
                proj = table[index[np.minimum(at, len(index) - 1)]]
            else:
                proj = np.zeros((*at.shape, 6 * _HIDDEN), np.float32)
            pooled, _ = self.seq.forward(proj, mask)
            out[a : a + 4096] = pooled @ self.p["out"] + self.p["bias"]
        return out

    def step(self, low, starts, ends, hashes, index, mask, label, adam, keep):
        """One gradient step on windows; ``index`` (T, B) points at the given distinct words.

        ``keep`` drops word embeddings at random, so that the bytes of a word must tell too.
        """
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        codes, chars = self._chars(low, starts, ends)
        pooled, kept_c = self.char.forward(self.p["chars"][codes], chars, True)
        slot = (hashes >> U(64 - _LOG)).astype(np.int64)
        x = np.concatenate([self.p["words"][slot] * keep, pooled], 1)
        table = x @ self.p["w"] + self.p["b"]
        vector, kept_s = self.seq.forward(table[index], mask, True)
        p = _sigmoid(vector @ self.p["out"] + self.p["bias"])
        d = ((p - label) / len(label)).astype(np.float32)
        grad["out"] += d @ vector
        grad["bias"] += d.sum()
        d_proj = self.seq.backward(d[:, None] * self.p["out"], kept_s, grad)
        d_table = np.zeros_like(table)
        np.add.at(d_table, index[mask], d_proj[mask])
        grad["w"] += x.T @ d_table
        grad["b"] += d_table.sum(0)
        d_x = d_table @ self.p["w"].T
        np.add.at(grad["words"], slot, d_x[:, :_DIM] * keep)
        d_chars = self.char.backward(d_x[:, _DIM:], kept_c, grad)
        np.add.at(grad["chars"], codes[chars], d_chars[chars])
        adam.apply(self.p, grad)


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def apply(self, p: dict, grad: dict) -> None:
        self.t += 1
        for k, g in grad.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g * g
            p[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-7)).astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network | None:
    """Network from labelled texts; none without both classes."""
    label = np.array(labels)
    if not (label == 0).any() or not (label == 1).any():
        return None
    r = np.random.default_rng(seed)
    column = pa.array(texts, pa.string())
    _, _, data, offsets = next(pieces(column, 1 << 62))
    low, starts, ends, hashes, first = find_words(data, offsets)
    begin, count, head = window_starts(first)
    _, once, index = np.unique(hashes, return_index=True, return_inverse=True)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    seen = np.unique(np.stack([index, text], 1), axis=0)
    odds = np.zeros(len(once))
    for side in (1, 0):
        n = np.bincount(seen[label[seen[:, 1]] == side, 0], minlength=len(once))
        odds += (1 if side else -1) * np.log((n + 0.5) / ((label == side).sum() + 1))
    at = begin[None, :] + np.arange(WINDOW)[:, None]
    inside = np.arange(WINDOW)[:, None] < count[None, :]
    rows = index[np.minimum(at, max(0, len(index) - 1))] if len(index) else np.zeros(at.shape, np.int64)
    suspicion = np.where(inside, odds[rows] if len(odds) else 0, -99).max(0)
    owner = np.repeat(np.arange(len(texts)), np.diff(head))
    network, adam = Network(seed), Adam(0.01)
    # Small samples are read more often, so that every network sees enough steps.
    epochs = max(epochs, min(80, -(-MIN_STEPS * 128 // (2 * len(texts)))))
    for epoch in range(epochs):
        adam.rate = 0.01 * (0.05 + 0.95 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)))
        if epoch > 1:
            table = network.gates(low, starts[once], ends[once], hashes[once])
            suspicion = network.logits(table, index, begin, count)
        top = np.lexsort((-suspicion, owner))[head[:-1]]
        clean = np.flatnonzero(label[owner] == 0)
        chosen = np.r_[top, r.choice(clean, min(len(clean), len(texts)), replace=False)]
        # Toxic windows come twice, against the larger number of clean ones.
        chosen = np.r_[chosen, top[label == 1]]
        r.shuffle(chosen)
        for a in range(0, len(chosen), 128):
            part = chosen[a : a + 128]
            used, local = np.unique(rows[:, part], return_inverse=True)
            w = once[used]
            network.step(low, starts[w], ends[w], hashes[w], local.reshape(WINDOW, -1), inside[:, part],
                         label[owner[part]].astype(np.float32), adam,
                         2 * (r.random((len(w), 1)) < 0.5).astype(np.float32))
    return network


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = MAX_PER_CLASS) -> Network | None:
    """Train on labelled rows for which ``usable`` (an expression on doc_id) holds."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & usable)
        .groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    chosen = [known.filter(F.col("label") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class * (2 - side)) for side in (0, 1)]
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id"  # at most 3 * per_class narrow rows
    )
    rows = sorted(sample.collect(), key=lambda r: (int(mix(np.array([r.doc_id], np.int64).view(U))[0]), r.text or ""))
    return train([r.text or "" for r in rows], [r.label for r in rows])


class _Scorer:
    """Scores pieces of texts and remembers the gate inputs of words it has seen."""

    def __init__(self, network: Network):
        self.network = network
        self.known = np.zeros(0, U)
        self.table = np.zeros((0, 6 * _HIDDEN), np.float32)

    def rows(self, low, starts, ends, hashes) -> np.ndarray:
        """Row in ``table`` of every word."""
        distinct, once, index = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        place[place == len(self.known)] = 0
        fresh = self.known[place] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if fresh.any():
            if len(self.known) + fresh.sum() > CACHE_WORDS:
                self.known, self.table = self.known[:0], self.table[:0]
                fresh[:] = True
            w = once[fresh]
            gates = self.network.gates(low, starts[w], ends[w], hashes[w])
            known = np.r_[self.known, distinct[fresh]]
            order = np.argsort(known)
            self.known, self.table = known[order], np.concatenate([self.table, gates])[order]
        return np.searchsorted(self.known, distinct)[index]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        low, starts, ends, hashes, first = find_words(data, offsets)
        index = self.rows(low, starts, ends, hashes) if len(starts) else np.zeros(0, np.int64)
        begin, count, head = window_starts(first)
        logits = self.network.logits(self.table, index, begin, count)
        return _sigmoid(np.maximum.reduceat(logits, head[:-1])).astype(float)


def score(docs: DataFrame, network: Network | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted; one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        scorer = _Scorer(shared.value) if shared.value is not None else None
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for a, b, data, offsets in pieces(batch.column(1)):
                if scorer is not None:
                    scores[a:b] = scorer.score(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return base.mapInArrow(run, "doc_id long, score double, predicted int")
