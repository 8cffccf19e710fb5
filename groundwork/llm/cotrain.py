"""Quality classification by co-training on two views.

The text view describes what a document says and how it is laid out: shares of byte classes, word
shapes, repetition. The metadata view describes where it comes from: hashed source and language,
and the size of the document. Each view has its own logistic classifier. Over some rounds each
one labels the unlabelled documents that it is most sure of, and the other learns from them. Both
are then calibrated on labelled rows that neither learned from, and the calibrated views, weighted
by how well they do there, score every document.

Training uses about ``max_labelled`` labelled and ``max_pool`` unlabelled ids, twice as many at most,
chosen by hashes (documented bounds; only the features of their whole texts reach the driver). Of
an id that repeats, training sees one row, picked by a hash of the row. Scoring covers all rows and
whole texts in one pass without a shuffle; repeated rows score alike. Null texts score as empty
ones, unknown or null metadata has its own slots. With one label value or none every score is 0.5.
Extra columns are kept, a column named score is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytetext as bt
from .shared import hash_sample

META_SLOTS = 64


def _class_table() -> np.ndarray:
    """Byte -> class: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 newline, 6 sentence mark,
    7 bar or slash, 8 symbol, 9 exclamation, 10 non-ASCII."""
    t = np.zeros(256, np.int64)
    for cls, chars in ((4, " \t"), (5, "\n\r"), (6, ".,;:?'\"()-"), (7, "|/\\<>{}[]_"), (8, "#$%&*+=@^~`"), (9, "!")):
        for c in chars:
            t[ord(c)] = cls
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1], t[0x80:] = 1, 2, 3, 10
    return t


_CLASS = _class_table()
N_CLASSES = 11


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per document."""
    n = len(offsets) - 1
    own = data[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * N_CLASSES + _CLASS[own], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    w = bt.words(data, offsets, bt.byte_class("nonspace"))
    n_words = np.diff(w.first)
    word_doc = np.repeat(np.arange(n), n_words)
    same = np.zeros((3, n))
    for lag in (1, 2, 3):
        if len(w.hash) > lag:
            eq = (w.hash[lag:] == w.hash[:-lag]) & (word_doc[lag:] == word_doc[:-lag])
            same[lag - 1] = np.bincount(word_doc[lag:][eq], minlength=n)
    length = w.end - w.start
    mean = np.bincount(word_doc, length, n) / np.maximum(n_words, 1)
    wide = np.bincount(word_doc, length > 15, n) / np.maximum(n_words, 1)
    # Distinct words: sorted within documents, borders counted.
    order = np.lexsort((w.hash, word_doc))
    h, d = w.hash[order], word_doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
    distinct = np.bincount(d[new], minlength=n) / np.maximum(n_words, 1)
    share = counts / np.maximum(size, 1)[:, None]
    return np.column_stack([
        share, np.sqrt(share), np.log1p(n_words), 1 / (1 + n_words), mean, wide, distinct, (same / np.maximum(n_words, 1)).T,
        n_words / np.maximum(counts[:, 5] + 1, 1) / 50,
    ]).astype(np.float32)


def meta_features(columns: Sequence[Sequence[object]], size: np.ndarray) -> np.ndarray:
    """Hashed one-hot slots of each metadata column and the size of the document."""
    n = len(size)
    out = np.zeros((n, len(columns) * META_SLOTS + 3), np.float32)
    for c, values in enumerate(columns):
        slots = {}
        for value in set(values):
            raw = np.frombuffer(b"?" if value is None else b"=" + str(value).encode(), np.uint8)
            slots[value] = int(bt.run_hashes(raw, np.array([0]), np.array([len(raw)]))[0] % np.uint64(META_SLOTS))
        out[np.arange(n), c * META_SLOTS + np.array([slots[v] for v in values], np.int64)] = 1
    log = np.log1p(size)
    out[:, -3:] = np.column_stack([log / 10, (log / 10) ** 2, size < 100])
    return out


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    a: float = 1.0
    b: float = 0.0
    weight: float = 0.5

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.a * self.logit(x) + self.b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Newton steps on the penalised likelihood; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + reg * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(h, grad)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> View:
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    return View(mean, scale, logistic((x - mean) / scale, y, weight))


def cotrain(
    views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], *, rounds: int = 5, per_round: int = 200, trust: float = 0.5, seed: int = 11
) -> list[View] | None:
    """Two fitted and calibrated views. ``views``: features of the labelled rows, ``pool``: of the
    unlabelled ones."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(y)) % 4 == 0
    if len(set(y[~fold].tolist())) < 2:
        fold[:] = False
    y = y.astype(float)
    # Each view's rows: the labelled ones, then those that the other view taught it.
    extra: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in views]
    fitted: list[View] = []
    for _ in range(rounds + 1):
        fitted = [
            fit_view(
                np.concatenate([x[~fold], pool[v][extra[v][0]]]), np.concatenate([y[~fold], extra[v][1]]),
                np.concatenate([np.ones((~fold).sum()), np.full(len(extra[v][0]), trust)]),
            )
            for v, x in enumerate(views)
        ]
        for v in (0, 1):
            z = fitted[v].logit(pool[v]) if len(pool[v]) else np.zeros(0)
            other = 1 - v
            left = np.setdiff1d(np.arange(len(z)), extra[other][0])
            order = left[np.argsort(z[left], kind="stable")]
            share = y[~fold].mean()
            low, high = order[: int(per_round * (1 - share))], order[::-1][: int(per_round * share)]
            low, high = low[z[low] < -1.5], high[z[high] > 1.5]
            extra[other] = (np.concatenate([extra[other][0], low, high]), np.concatenate([extra[other][1], np.zeros(len(low)), np.ones(len(high))]))
    check = fold if fold.any() else np.ones(len(y), bool)
    loss = []
    for view, x in zip(fitted, views, strict=True):
        z = view.logit(x[check])
        view.a, view.b = logistic(z[:, None], y[check], np.ones(check.sum()), ridge=0.01)
        p = np.clip(sigmoid(view.calibrated(x[check])), 1e-6, 1 - 1e-6)
        loss.append(-(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean())
    base = y[check].mean()
    worst = -(base * np.log(max(base, 1e-6)) + (1 - base) * np.log(max(1 - base, 1e-6)))
    gain = np.maximum(worst - np.array(loss), 1e-3)
    for view, g in zip(fitted, gain, strict=True):
        view.weight = float(g / gain.max())
    # The views are summed around the base rate, which must count once.
    offset = np.log(base / (1 - base)) if 0 < base < 1 else 0.0
    fitted[0].b += offset * (1 - sum(v.weight for v in fitted)) / fitted[0].weight
    return fitted


def _features(names: list[str], text_col: str, meta_cols: Sequence[str], model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bt.column_bytes(batch[text_col])
            parts = [text_features(data, offsets[i : j + 1]) for i, j in bt.pieces(offsets)]
            text = np.concatenate(parts) if parts else np.zeros((0, 0), np.float32)
            meta = meta_features([batch[c].to_pylist() for c in meta_cols], np.diff(offsets))
            kept = [batch[n] for n in names]
            if model is None:
                lists = [pa.array(list(x), pa.list_(pa.float32())) for x in (text, meta)]
                yield pa.RecordBatch.from_arrays([*kept, *lists], [*names, "text_view", "meta_view"])
                continue
            views = model.value
            if views is None or not len(text):
                score = np.full(len(meta), 0.5)
            else:
                score = sigmoid(views[0].weight * views[0].calibrated(text) + views[1].weight * views[1].calibrated(meta))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], [*names, "score"])

    return run


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    meta_cols: Sequence[str] = ("source", "lang"), max_labelled: int = 4000, max_pool: int = 4000,
) -> list[View] | None:
    """Trains on bounded samples of labelled and unlabelled documents."""
    key = F.col(id_col).cast("string")
    per = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    known = hash_sample(per, key, max_labelled)
    pool = docs.select(id_col).where(F.col(id_col).isNotNull()).distinct().join(labels.select(id_col).distinct(), id_col, "left_anti")
    pool = hash_sample(pool, key, max_pool).select(id_col, F.lit(None).cast("int").alias("y"))
    chosen = F.broadcast(known.union(pool))
    # One row of each id, so that what reaches the driver is bounded by the ids.
    own = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys((text_col, *meta_cols))])
    slim = docs.select(id_col, own.alias("own")).join(chosen.withColumnRenamed("y", "__y"), id_col)
    rows = slim.groupBy(id_col, "__y").agg(F.min_by("own", F.xxhash64("own")).alias("own")).select(id_col, "__y", "own.*")
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, __y int, text_view array<float>, meta_view array<float>"
    got = rows.mapInArrow(_features([id_col, "__y"], text_col, meta_cols, None), schema).toPandas().sort_values(id_col, kind="stable")
    is_known = got["__y"].notna().to_numpy()
    if not is_known.any():
        return None
    stack = lambda c, m: np.array(got[c][m].tolist(), np.float64).reshape(int(m.sum()), -1)
    views = [stack(c, is_known) for c in ("text_view", "meta_view")]
    others = [stack(c, ~is_known) if (~is_known).any() else np.zeros((0, v.shape[1])) for c, v in zip(("text_view", "meta_view"), views, strict=True)]
    return cotrain(views, got["__y"][is_known].to_numpy(int), others)


def score(docs: DataFrame, views: list[View] | None, *, text_col: str = "text", meta_cols: Sequence[str] = ("source", "lang")) -> DataFrame:
    """``docs`` with score: the probability of label 1."""
    keep = [f for f in docs.schema if f.name != "score"]
    sent = docs.sparkSession.sparkContext.broadcast(views)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep) + "score double"
    return docs.mapInArrow(_features([f.name for f in keep], text_col, meta_cols, sent), schema)
