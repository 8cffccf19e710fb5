"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of a word vector and the mean of its character n-gram vectors (both from
hashed tables), so unseen spellings are near seen ones. Two gated recurrent layers read windows of
``WINDOW`` words, one in each direction; attention pools the states of a window and a linear layer
scores it. All windows of the whole text are scored, each half over the one before, and a document
takes its highest window: one toxic passage in a long text counts in full.

Training sees document labels only: each round picks a document's highest window as the one to
learn from. It uses at most ``max_docs`` labelled documents per class (a documented bound), whole up to
``max_chars`` characters. Of a longer one that is not toxic it takes a stretch of that size from a
place that a hash picks; a longer toxic one does not say where it is toxic, and is left out of
training. Everything else covers all rows and whole texts.

Null texts and texts without words score the share of toxic labels, as learned from labelled texts
without words and, where these are few, from all. Without labelled rows every score is 0. A
document that is labelled twice counts as toxic if any label says so. Repeated rows score alike, an
empty table gives no rows, extra columns are kept, and a column named score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytetext as bt
from .shared import fitted, hash_sample, stretch_of

WINDOW, STRIDE = 32, 16
WORDS, GRAMS, DIM, HIDDEN = 1 << 15, 1 << 14, 12, 8
_ADDED = ("score",)


@dataclass
class Net:
    word: np.ndarray
    gram: np.ndarray
    wx: np.ndarray  # 2 x DIM x 3H: reset, update, new
    wh: np.ndarray  # 2 x H x 3H
    b: np.ndarray  # 2 x 3H
    att: np.ndarray  # 2H
    out: np.ndarray  # 2H
    bias: np.ndarray  # 1
    prior: float = 0.0  # the score of texts without words

    def parts(self) -> list[np.ndarray]:
        return [self.word, self.gram, self.wx, self.wh, self.b, self.att, self.out, self.bias]


def fresh(seed: int, base: float) -> Net:
    rng = np.random.default_rng(seed)
    f = lambda *s, sd: rng.normal(0, sd, s).astype(np.float32)
    return Net(
        f(WORDS, DIM, sd=0.1), f(GRAMS, DIM, sd=0.1), f(2, DIM, 3 * HIDDEN, sd=0.3), f(2, HIDDEN, 3 * HIDDEN, sd=0.3),
        np.zeros((2, 3 * HIDDEN), np.float32), f(2 * HIDDEN, sd=0.3), f(2 * HIDDEN, sd=0.3), np.array([base], np.float32),
    )


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word slot per word, and (owner, gram slot) of its character trigrams and short words."""
    slot = (bt.mix(hashes) >> np.uint64(64 - 15)).astype(np.int64)
    length = end - start
    times = np.maximum(length - 2, 1)
    owner = np.repeat(np.arange(len(start)), times)
    offset = np.arange(len(owner)) - (np.cumsum(times) - times)[owner]
    a = start[owner] + offset
    h = bt.run_hashes_at(data, a, np.minimum(a + 3, end[owner]))
    return slot, owner, (bt.mix(h + np.uint64(77)) >> np.uint64(64 - 14)).astype(np.int64)


def word_vectors(net: Net, slot: np.ndarray, owner: np.ndarray, gram: np.ndarray) -> np.ndarray:
    n = len(slot)
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    mean = np.add.reduceat(net.gram[gram], first, 0) / count[:, None] if n else np.zeros((0, DIM), np.float32)
    return net.word[slot] + mean.astype(np.float32)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word) of every window: one each STRIDE words, half a window, the last one at
    the text's end, and at least one per document. Any STRIDE words in a row are in one window."""
    n = np.diff(first)
    times = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(n)), times)
    nth = np.arange(len(doc)) - (np.cumsum(times) - times)[doc]
    return doc, first[:-1][doc] + np.minimum(nth * STRIDE, np.maximum(n - WINDOW, 0)[doc])


def _gates(pre: np.ndarray, h: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rec = h @ wh
    rz = np.tanh(0.5 * (pre[:, : 2 * HIDDEN] + rec[:, : 2 * HIDDEN])) * 0.5 + 0.5
    r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
    new = np.tanh(pre[:, 2 * HIDDEN :] + r * rec[:, 2 * HIDDEN :])
    return r, z, new, rec[:, 2 * HIDDEN :]


def forward(net: Net, pre: np.ndarray, idx: np.ndarray, live: np.ndarray, keep: bool = False):
    """Logit per window. ``pre``: inputs' gate sums per distinct word (2 x words x 3H); ``idx``:
    windows x WINDOW into it; ``live``: which places hold a word."""
    n = len(idx)
    states = np.zeros((WINDOW, n, 2 * HIDDEN), np.float32)
    trace: list = [[None] * WINDOW, [None] * WINDOW]
    full = not keep and bool(live.all())
    on = None if full else live.T[:, :, None].astype(np.float32)
    for way in (0, 1):
        h = np.zeros((n, HIDDEN), np.float32)
        part = slice(way * HIDDEN, (way + 1) * HIDDEN)
        for t in range(WINDOW) if way == 0 else range(WINDOW - 1, -1, -1):
            r, z, new, rec = _gates(pre[way][idx[:, t]], h, net.wh[way])
            nxt = new + z * (h - new)
            if not full:
                nxt = on[t] * nxt + (1 - on[t]) * h
            if keep:
                trace[way][t] = (h, r, z, new, rec)
            h = nxt
            states[t, :, part] = h
    e = np.where(live.T, states @ net.att, np.float32(-30))
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    pooled = np.einsum("tn,tnd->nd", a, states)
    logit = pooled @ net.out + net.bias[0]
    return (logit, states, a, pooled, trace, on) if keep else logit


def backward(net: Net, kept, grad: np.ndarray):
    """Gradients of the summed loss; ``grad``: d loss / d logit per window."""
    _, states, a, pooled, trace, on = kept
    d_out, d_bias = pooled.T @ grad, np.array([grad.sum()], np.float32)
    d_pooled = grad[:, None] * net.out[None]
    d_a = np.einsum("nd,tnd->tn", d_pooled, states)
    d_e = a * (d_a - (a * d_a).sum(0))
    d_att = np.einsum("tn,tnd->d", d_e, states)
    d_states = a[:, :, None] * d_pooled[None] + d_e[:, :, None] * net.att
    n = len(grad)
    d_pre = np.zeros((2, WINDOW, n, 3 * HIDDEN), np.float32)
    d_wh = np.zeros_like(net.wh)
    for way in (0, 1):
        back = np.zeros((n, HIDDEN), np.float32)
        part = slice(way * HIDDEN, (way + 1) * HIDDEN)
        for t in range(WINDOW - 1, -1, -1) if way == 0 else range(WINDOW):
            h, r, z, new, rec = trace[way][t]
            total = back + d_states[t, :, part]
            on_t = total * on[t]
            d_new = on_t * (1 - z) * (1 - new * new)
            d_z = on_t * (h - new) * z * (1 - z)
            d_r = d_new * rec * r * (1 - r)
            d_pre[way, t] = np.concatenate([d_r, d_z, d_new], 1)
            d_rec = np.concatenate([d_r, d_z, d_new * r], 1)
            d_wh[way] += h.T @ d_rec
            back = total * (1 - on[t]) + on_t * z + d_rec @ net.wh[way].T
    return d_pre, d_wh, d_att, d_out, d_bias


def gate_sums(net: Net, vectors: np.ndarray) -> np.ndarray:
    return np.stack([vectors @ net.wx[w] + net.b[w] for w in (0, 1)])


def distinct_words(w: bt.Words) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each word's row among the distinct ones, and their ids."""
    h, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
    return back, word_ids(w.data, w.start[first], w.end[first], h)


def _places(back: np.ndarray, first: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pos = at[:, None] + np.arange(WINDOW)
    live = pos < first[1:][doc][:, None]
    if not len(back):
        return np.zeros(pos.shape, np.int64), live
    return back[np.minimum(pos, len(back) - 1)], live


def train(texts: list[str], toxic: list[int], *, base_rate: float | None = None, epochs: int = 7, rate: float = 0.02, batch: int = 256, seed: int = 3) -> Net | None:
    """Learns from whole texts and their labels. ``base_rate``: the share of toxic documents where
    the sample's differs; scores are shifted to it."""
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    y = np.array(toxic, np.float32)
    share = float(np.clip(y.mean(), 0.02, 0.98))
    net = fresh(seed, 0.0)
    raw = [t.encode() for t in texts]
    w = bt.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), bt.byte_class("alnum"))
    back, (slot, owner, gram) = distinct_words(w)
    count = np.bincount(owner, minlength=len(slot))
    first = np.cumsum(count) - count
    doc, at = windows(w.first)
    idx, live = _places(back, w.first, doc, at)
    starts = np.searchsorted(doc, np.arange(len(y)))
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in net.parts()]
    step = 0
    for epoch in range(epochs):
        pre = gate_sums(net, word_vectors(net, slot, owner, gram))
        logit = np.concatenate([forward(net, pre, idx[i : i + 2048], live[i : i + 2048]) for i in range(0, len(idx), 2048)])
        noise = rng.gumbel(0, 0.3 if epoch < 2 else 0.02, len(logit))
        order = np.lexsort((-(logit + noise), doc))
        top = order[starts]
        extra = rng.integers(starts, np.append(starts[1:], len(doc)))
        pick = np.concatenate([top, np.concatenate([extra[y == 0], order[np.minimum(starts + 1, len(order) - 1)][y == 0]])])
        if epoch < 2:
            pick = np.concatenate([pick, extra[y > 0], rng.integers(starts, np.append(starts[1:], len(doc)))[y > 0]])
        pick = np.unique(pick)
        rng.shuffle(pick)
        for lo in range(0, len(pick), batch):
            rows = pick[lo : lo + batch]
            used, local = np.unique(idx[rows], return_inverse=True)
            local = local.reshape(len(rows), WINDOW)
            c = count[used]
            g_owner = np.repeat(np.arange(len(used)), c)
            g = gram[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[used], c)] if len(slot) else gram
            vec = word_vectors(net, slot[used], g_owner, g)
            kept = forward(net, gate_sums(net, vec), local, live[rows], keep=True)
            target = y[doc[rows]]
            p = 1 / (1 + np.exp(-kept[0]))
            grad = ((p - target) / len(rows)).astype(np.float32)
            d_pre, d_wh, d_att, d_out, d_bias = backward(net, kept, grad)
            d_gate = np.zeros((2, len(used), 3 * HIDDEN), np.float32)
            for way in (0, 1):
                np.add.at(d_gate[way], local.T.reshape(-1), d_pre[way].reshape(-1, 3 * HIDDEN))
            d_vec = d_gate[0] @ net.wx[0].T + d_gate[1] @ net.wx[1].T
            d_word, d_gram = np.zeros_like(net.word), np.zeros_like(net.gram)
            np.add.at(d_word, slot[used], d_vec)
            np.add.at(d_gram, g, (d_vec / c[:, None])[g_owner])
            grads = [d_word, d_gram, np.stack([vec.T @ d_gate[w_] for w_ in (0, 1)]), d_wh, d_gate.sum(1), d_att, d_out, d_bias]
            step += 1
            for part, gr, (m, v) in zip(net.parts(), grads, moment, strict=True):
                m += 0.1 * (gr - m)
                v += 0.01 * (gr * gr - v)
                part -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    if base_rate is not None:
        base = float(np.clip(base_rate, 0.001, 0.999))
        net.bias += np.float32(np.log(base / (1 - base)) - np.log(share / (1 - share)))
    bare = np.diff(w.first) == 0
    net.prior = float((y[bare].sum() + 4 * (share if base_rate is None else base_rate)) / (bare.sum() + 4))
    return net


def score_words(net: Net, w: bt.Words) -> np.ndarray:
    """Per document the probability of its highest window."""
    back, ids = distinct_words(w)
    vectors = word_vectors(net, *ids) if len(ids[0]) else np.zeros((1, DIM), np.float32)
    pre = gate_sums(net, vectors)
    doc, at = windows(w.first)
    best = np.full(len(w.first) - 1, -np.inf, np.float32)
    whole = at + WINDOW <= w.first[1:][doc]
    for some in (np.flatnonzero(whole), np.flatnonzero(~whole)):
        for i in range(0, len(some), 2048):
            part = some[i : i + 2048]
            idx, live = _places(back, w.first, doc[part], at[part])
            np.maximum.at(best, doc[part], forward(net, pre, idx, live))
    return np.where(np.diff(w.first) > 0, 1 / (1 + np.exp(-best.astype(np.float64))), net.prior)


def training_rows(
    docs: DataFrame, labels: DataFrame, *, text_col: str, id_col: str, label_col: str, max_docs: int, max_chars: int
) -> tuple[DataFrame, float | None]:
    """Texts with labels (t, y, k), and the share of toxic labels among all. Per class at most ``max_docs`` labelled texts, by id hashes. The ids
    are bounded before the join, so the broadcast side is too."""
    per = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__y"))
    key = F.col(id_col).cast("string")
    ids = [hash_sample(per.where(F.col("__y") == y), key, 2 * max_docs) for y in (0, 1)]
    small = F.broadcast(ids[0].union(ids[1]))
    rows = (
        docs.where(F.col(text_col).isNotNull()).select(id_col, text_col)
        .join(small, id_col).where((F.col("__y") == 0) | (F.length(text_col) <= max_chars))
        .select(stretch_of(F.col(text_col), key, max_chars).alias("t"), F.col("__y").alias("y"), F.xxhash64(key).alias("k"))
    )
    by_class = [rows.where(F.col("y") == y).orderBy("k", "t").limit(max_docs) for y in (0, 1)]
    return by_class[0].union(by_class[1]), per.agg(F.avg(F.col("__y").cast("double"))).first()[0]


def score(docs: DataFrame, net: Net | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1). A column of that name is replaced."""
    keep = [f for f in docs.schema if f.name not in _ADDED]
    names = [f.name for f in keep]
    sent = docs.sparkSession.sparkContext.broadcast(net)
    alnum = bt.byte_class("alnum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            data, offsets = bt.column_bytes(batch[text_col])
            out = [np.zeros(0)]
            for i, j in bt.pieces(offsets, 2 << 20):
                w = bt.words(data, offsets[i : j + 1], alnum)
                out.append(np.zeros(j - i) if model is None else score_words(model, w))
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(np.concatenate(out))], [*names, *_ADDED])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return docs.mapInArrow(run, f"{schema}score double")


def fit_and_score(
    docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id",
    label_col: str = "toxic", max_docs: int = 1500, max_chars: int = 6000,
) -> DataFrame:
    """Trains on ``labels`` of ``labelled_docs`` and scores ``docs``."""
    rows, base = training_rows(
        labelled_docs, labels, text_col=text_col, id_col=id_col, label_col=label_col, max_docs=max_docs, max_chars=max_chars
    )

    def fit(found: pd.DataFrame) -> Net | None:
        found = found.sort_values(["y", "k", "t"])
        return train(found.t.tolist(), [int(y) for y in found.y], base_rate=base)

    return score(docs, fitted(rows, fit), text_col=text_col)
