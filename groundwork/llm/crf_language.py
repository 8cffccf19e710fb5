"""Language identification by a linear-chain conditional random field over words.

A word's features are itself (the lexicon), its prefixes and suffixes of one to three bytes and
its inner byte n-grams of two and three, all hashed into one table of weights per language. The
transitions between the labels of neighbouring words are learned with them. Forward-backward
gives each word of a text, whole and of any length, its label probabilities, so code-switched
text is labelled word by word; a document's language is the one with the most probability mass
over its words, weighted by length, and its score is that share.

Training: conditional likelihood by gradient descent in numpy on at most ``max_docs`` labelled
documents, of a longer one a stretch of ``max_chars`` characters from a place that a hash picks (both
documented bounds), cut into stretches that are joined across languages so that switches are seen.
Everything else covers all rows and whole texts. Null texts and texts without a letter are ``und``
with score 0. Where no labelled row exists all texts are ``und``. Ties go to the first language in
order. Repeated rows are judged alike, an empty table gives no rows, extra columns are kept, and
columns of the added names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import bytetext as bt
from .shared import fitted, hash_sample, stretch_of

SLOTS = 1 << 16
_ADDED = ("lang_pred", "score")
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # SLOTS x labels, float32
    trans: np.ndarray  # labels x labels


def _spans(length: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, word, offset, size) of each feature group over words of the given byte lengths."""
    n = len(length)
    every = np.arange(n)
    yield 0, every, np.zeros(n, np.int64), length
    for k in (1, 2, 3):
        at = np.flatnonzero(length > k)
        yield k, at, np.zeros(len(at), np.int64), np.full(len(at), k)
        yield 3 + k, at, length[at] - k, np.full(len(at), k)
    for k in (2, 3):
        times = np.maximum(length - k + 1, 0)
        word = np.repeat(every, times)
        first = np.cumsum(times) - times
        yield 5 + k, word, np.arange(len(word)) - first[word], np.full(len(word), k)


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) of every feature of the words, grouped by kind."""
    words, slots = [], []
    for kind, word, offset, size in _spans(end - start):
        a = start[word] + offset
        h = bt.run_hashes_at(data, a, a + size)
        words.append(word)
        slots.append((bt.mix(h + np.uint64(kind * 0x1F123BB5)) >> np.uint64(48)).astype(np.int64))
    return np.concatenate(words), np.concatenate(slots)


def emissions(model: Crf, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Per word and label the sum of its features' weights over the root of their number."""
    word, slot = features(data, start, end)
    n, k = len(start), len(model.labels)
    count = np.bincount(word, minlength=n)
    out = np.empty((n, k), np.float32)
    for y in range(k):
        out[:, y] = np.bincount(word, model.weights[slot, y], n)
    return out / np.sqrt(np.maximum(count, 1))[:, None].astype(np.float32)


def word_emissions(model: Crf, w: bt.Words) -> np.ndarray:
    """Emissions of all words; each distinct word is scored once."""
    _, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
    return emissions(model, w.data, w.start[first], w.end[first])[back]


BLOCK = 64


def messages(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once: per word and label the potential of the word, the
    message up to it (with its potential) and the message from behind it; and the potentials of
    transitions. Rows of messages are scaled to sum to one.

    A chain runs from ``first[i]`` to ``first[i+1]`` and is cut into blocks of BLOCK words. The
    product of a block's transfer matrices carries the messages from block to block, exactly, and
    then all blocks run side by side: a chain of n words takes n / BLOCK + 2 * BLOCK steps."""
    n, k = emit.shape
    if n == 0:
        return emit.copy(), emit.copy(), emit.copy(), np.exp(trans)
    e = np.exp(emit - emit.max(1, keepdims=True))
    t = np.exp(trans - trans.max()).astype(np.float32)
    length = np.diff(first)
    blocks = -(-length // BLOCK)
    chain = np.repeat(np.arange(len(length)), blocks)
    nth = np.arange(len(chain)) - (np.cumsum(blocks) - blocks)[chain]
    begin = first[:-1][chain] + nth * BLOCK
    size = np.minimum(BLOCK, first[1:][chain] - begin)
    order = np.argsort(-size, kind="stable")
    chain, nth, begin, size = chain[order], nth[order], begin[order], size[order]
    alive = np.searchsorted(-size, -np.arange(BLOCK), "left")
    m, opening = len(size), nth == 0
    norm = lambda x: x / x.sum(-1, keepdims=True)
    enter, leave = np.full((m, k), 1.0 / k, np.float32), np.ones((m, k), np.float32)
    if blocks.max(initial=0) > 1:
        # A block's matrix: what a message that enters it leaves as.
        whole = np.broadcast_to(np.eye(k, dtype=np.float32), (m, k, k)).copy()
        for step in range(BLOCK):
            c = alive[step]
            if not c:
                break
            x = (whole[:c].reshape(-1, k) @ t).reshape(c, k, k)
            if step == 0:
                x[opening[:c]] = np.eye(k)
            x *= e[begin[:c] + step][:, None]
            whole[:c] = x / x.sum((1, 2), keepdims=True)
        whole_at = np.empty(m, np.int64)  # block in chain order -> its row here
        whole_at[order] = np.arange(m)
        start = np.cumsum(blocks) - blocks
        for b in range(int(blocks.max())):
            have = np.flatnonzero(blocks > b)
            row = whole_at[start[have] + b]
            if b:
                prev = whole_at[start[have] + b - 1]
                enter[row] = norm(np.einsum("ni,nij->nj", enter[prev], whole[prev]))
        for b in range(int(blocks.max()) - 2, -1, -1):
            have = np.flatnonzero(blocks > b + 1)
            row, nxt = whole_at[start[have] + b], whole_at[start[have] + b + 1]
            leave[row] = norm(np.einsum("nij,nj->ni", whole[nxt], leave[nxt]))
    fwd, a = np.empty_like(e), enter
    for step in range(BLOCK):
        c = alive[step]
        if not c:
            break
        at = begin[:c] + step
        moved = a[:c] @ t
        if step == 0:
            moved[opening[:c]] = 1.0
        a = norm(moved * e[at])
        fwd[at] = a
    behind, back = np.empty_like(e), leave.copy()
    for step in range(BLOCK - 1, -1, -1):
        c = alive[step]
        at = begin[:c] + step
        behind[at] = back[:c]
        back[:c] = norm((back[:c] * e[at]) @ t.T)
    return e, fwd, behind, t


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Label probabilities per word."""
    _, fwd, behind, _ = messages(emit, first, trans)
    p = fwd * behind
    return p / p.sum(1, keepdims=True) if len(p) else p


def pair_marginals(e: np.ndarray, fwd: np.ndarray, behind: np.ndarray, t: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Probabilities of the labels of words ``left`` and of the words after them: what leads to the
    first, the transition, the second's own potential, and what follows it."""
    pair = fwd[left][:, :, None] * t[None] * (e[left + 1] * behind[left + 1])[:, None, :]
    return pair / pair.sum((1, 2), keepdims=True)


def gradients(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Gradients of the log-likelihood of ``gold`` by emissions and transitions, and the number of
    pairs of neighbours."""
    e, fwd, behind, t = messages(emit, first, trans)
    p = fwd * behind
    by_word = -p / p.sum(1, keepdims=True)
    by_word[np.arange(len(gold)), gold] += 1
    inner = np.ones(max(0, len(gold)), bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    left = np.flatnonzero(inner)
    by_pair = -pair_marginals(e, fwd, behind, t, left).sum(0)
    np.add.at(by_pair, (gold[left], gold[left + 1]), 1)
    return by_word, by_pair, len(left)


def train(
    texts: list[str], langs: list[str], *, stretch: int = 12, chain: int = 48, epochs: int = 6, rate: float = 0.5,
    max_chains: int = 6000, seed: int = 7,
) -> Crf | None:
    """A model from labelled texts: every word of a text carries the text's language."""
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    raw = "\n".join(texts).encode()
    w = bt.words(np.frombuffer(raw, np.uint8), np.cumsum([0, *(len(t.encode()) + 1 for t in texts)])[: len(texts) + 1].clip(max=len(raw)), bt.byte_class("letters"))
    gold = np.repeat([labels.index(x) for x in langs], np.diff(w.first))
    _, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
    word, slot = features(w.data, w.start[first], w.end[first])
    sort = np.argsort(word, kind="stable")
    slot, count = slot[sort], np.bincount(word, minlength=len(first))
    begin = np.cumsum(count) - count
    # Stretches of one language, shuffled and joined into chains, so some borders are switches.
    cuts = [(a, min(a + stretch, e)) for s, e in zip(w.first[:-1], w.first[1:], strict=True) for a in range(s, e, stretch)]
    by_label = [[c for c in cuts if gold[c[0]] == y] for y in range(len(labels))]
    per = max_chains * (chain // stretch) // max(1, len(labels))
    cuts = [c for group in by_label for c in (group if len(group) <= per else [group[i] for i in rng.choice(len(group), per, False)])]
    k = len(labels)
    weights, trans = np.zeros((SLOTS, k), np.float32), np.zeros((k, k), np.float32)
    square = np.full((SLOTS, k), 1e-6, np.float32)
    for _ in range(epochs):
        # Half of the stretches keep to their language's run, the rest are mixed.
        keys = np.array([gold[a] + (rng.random() if rng.random() < 0.3 else 0) * k for a, _ in cuts]) + rng.random(len(cuts)) * 1e-3
        order = np.argsort(keys)
        at = np.concatenate([np.arange(*cuts[i]) for i in order]) if cuts else np.empty(0, np.int64)
        for lo in range(0, len(at), chain * 64):
            pos = at[lo : lo + chain * 64]
            bounds = np.append(np.arange(0, len(pos), chain), len(pos))
            ids = back[pos]
            n_feat = count[ids]
            owner = np.repeat(np.arange(len(pos)), n_feat)
            s = slot[np.arange(n_feat.sum()) - np.repeat(np.cumsum(n_feat) - n_feat, n_feat) + np.repeat(begin[ids], n_feat)]
            scale = 1 / np.sqrt(np.maximum(n_feat, 1)).astype(np.float32)
            emit = np.stack([np.bincount(owner, weights[s, y], len(pos)) for y in range(k)], 1).astype(np.float32) * scale[:, None]
            grad, by_pair, pairs = gradients(emit, bounds, trans, gold[pos])
            scaled = grad * scale[:, None] / 64
            for j in range(k):
                g = np.bincount(s, scaled[owner, j], SLOTS).astype(np.float32)
                square[:, j] += g * g
                weights[:, j] += rate * g / np.sqrt(square[:, j])
            trans += 0.5 * by_pair / max(1, pairs)
    return Crf(labels, weights, trans)


def label_words(model: Crf, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of a text."""
    raw = text.encode()
    w = bt.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), bt.byte_class("letters"))
    if not len(w.hash):
        return []
    p = marginals(word_emissions(model, w), w.first, model.trans)
    return [(w.text(i).decode(errors="replace"), model.labels[j], float(p[i, j])) for i, j in enumerate(p.argmax(1).tolist())]


def training_rows(docs: DataFrame, *, text_col: str, lang_col: str, id_col: str, max_docs: int, max_chars: int) -> DataFrame:
    """(t, y): about ``max_docs`` labelled texts, twice as many at most, by hashes of ids and texts."""
    ok = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    rows = docs.where(ok).select(F.col(text_col).alias("t"), F.col(lang_col).alias("y"), F.col(id_col).cast("string").alias("i"))
    picked = hash_sample(rows, F.concat_ws(":", "i", "t"), max_docs)
    return picked.select(stretch_of(F.col("t"), F.col("i"), max_chars).alias("t"), "y")


def identify(docs: DataFrame, model: Crf | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score. Columns of these names are replaced."""
    keep = [f for f in docs.schema if f.name not in _ADDED]
    names = [f.name for f in keep]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    letters = bt.byte_class("letters")
    ascii_letters = letters & (np.arange(256) < 0x80)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = sent.value
        for batch in batches:
            data, offsets = bt.column_bytes(batch[text_col])
            langs: list[str] = []
            scores: list[float] = []
            for i, j in bt.pieces(offsets, 1 << 20):
                piece = data[offsets[i] : offsets[j]]
                w = bt.words(data, offsets[i : j + 1], letters)
                n = np.diff(w.first)
                seen = np.concatenate([[0], np.cumsum(ascii_letters[piece])])[offsets[i : j + 1] - offsets[i]]
                lettered = np.diff(seen) > 0
                for d in np.flatnonzero(~lettered & (n > 0)).tolist():
                    text = piece[offsets[i + d] - offsets[i] : offsets[i + d + 1] - offsets[i]].tobytes()
                    lettered[d] = bool(_LETTER.search(text.decode(errors="replace")))
                lettered &= n > 0
                if crf is None:
                    langs += ["und"] * (j - i)
                    scores += [0.0] * (j - i)
                    continue
                p = marginals(word_emissions(crf, w), w.first, crf.trans)
                p *= (w.end - w.start)[:, None]
                mass = np.zeros((j - i, len(crf.labels)))
                some = np.flatnonzero(n)
                if len(some):
                    mass[some] = np.add.reduceat(p, w.first[:-1][some], 0)
                best = mass.argmax(1)
                share = mass[np.arange(j - i), best] / np.maximum(mass.sum(1), 1e-9)
                langs += [crf.labels[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                scores += np.where(lettered, share.clip(0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [*[batch[n] for n in names], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, *_ADDED]
            )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return docs.mapInArrow(run, f"{schema}lang_pred string, score double")


def fit_and_identify(
    docs: DataFrame, labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    max_docs: int = 3000, max_chars: int = 8000,
) -> DataFrame:
    """Trains on ``labelled`` (see ``training_rows``) and labels ``docs``."""
    rows = training_rows(labelled, text_col=text_col, lang_col=lang_col, id_col=id_col, max_docs=max_docs, max_chars=max_chars)

    def fit(found: pd.DataFrame) -> Crf | None:
        found = found.sort_values(["t", "y"])
        return train(found.t.tolist(), found.y.tolist())

    return identify(docs, fitted(rows, fit), text_col=text_col)
