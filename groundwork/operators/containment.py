"""Texts that hold whole facts, without comparing each pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Facts go to the tasks in blocks of about this many bytes, and texts are searched this many at a time.
FACT_BYTES, TEXT_BYTES = 4 << 20, 4 << 20
KEY = 8


def _grams(raw: bytes, n: int) -> np.ndarray:
    """At each byte the next ``n`` (8 at most) as a number; zeros follow the end."""
    eight = np.ndarray((len(raw),), "<u8", raw + bytes(KEY), strides=(1,))
    return eight if n == KEY else eight & np.uint64((1 << 8 * n) - 1)


def _rarest(facts: list[bytes]) -> list[int]:
    """For each fact of eight bytes or more the place of its rarest gram: that of the fewest facts, and of
    these the one of the rarest pairs of bytes."""
    own = [_grams(f, KEY)[: len(f) - KEY + 1] for f in facts]
    keys, count = np.unique(np.concatenate([np.unique(g) for g in own]) if own else np.empty(0, np.uint64), return_counts=True)
    pairs = np.zeros(1 << 16, np.int64)
    two = [np.frombuffer(f[:-1], np.uint8).astype(np.int64) << 8 | np.frombuffer(f[1:], np.uint8) for f in facts]
    for t in two:
        np.add.at(pairs, t, 1)
    out = []
    for g, t in zip(own, two):
        seen = np.r_[0, np.cumsum(pairs[t])]
        common = seen[KEY - 1 : KEY - 1 + len(g)] - seen[: len(g)]
        out.append(int(np.lexsort((common, count[np.searchsorted(keys, g)]))[0]))
    return out


class _Facts:
    """Distinct facts under a gram each, of eight bytes or, of shorter facts, all they have: a sorted table
    for each length. Facts with one opening, or one end, are told apart by what they do not share."""

    def __init__(self, facts: list[tuple[int, bytes]]):
        ids: dict[bytes, list[int]] = {}
        for i, f in facts:
            ids.setdefault(f, []).append(i)
        self.facts, self.ids = list(ids), list(ids.values())
        self.every = [i for i, f in enumerate(self.facts) if not f]
        long = [i for i, f in enumerate(self.facts) if len(f) >= KEY]
        self.place = dict(zip(long, _rarest([self.facts[i] for i in long])))
        by: dict[int, dict[int, list[int]]] = {}
        for i, f in enumerate(self.facts):
            if f:
                n, at = min(KEY, len(f)), self.place.get(i, 0)
                by.setdefault(n, {}).setdefault(int(_grams(f[at : at + n], n)[0]), []).append(i)
        self.tables = {n: (np.array(sorted(t), np.uint64), t) for n, t in by.items()}
        self.compared = 0

    def held(self, raw: bytes, first: np.ndarray, end: np.ndarray) -> set[tuple[int, int]]:
        """(text, fact) for texts at ``first`` to ``end`` of the bytes: every offset is looked up."""
        out = {(t, i) for i in self.every for t in range(len(first))}
        for n, (keys, table) in self.tables.items():
            grams = _grams(raw, n)
            for lo in range(0, len(raw), TEXT_BYTES):
                part = grams[lo : lo + TEXT_BYTES]
                near = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                at = np.flatnonzero(keys[near] == part)
                found, at = part[at].tolist(), at + lo
                text = np.searchsorted(end, at, side="right")
                for a, t, g in zip(at.tolist(), text.tolist(), found, strict=True):
                    for i in table[g]:
                        f, b = self.facts[i], a - self.place.get(i, 0)
                        if (t, i) not in out and b >= first[t] and b + len(f) <= end[t]:
                            self.compared += 1
                            if raw[b : b + len(f)] == f:
                                out.add((t, i))
        return out


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of ``TEXT_BYTES`` together, at least one text each."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TEXT_BYTES, "right")))
        yield i, j
        i = j


def _search(facts: _Facts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in _pieces(pc.binary_length(whole["text"]).to_numpy(zero_copy_only=False)):
                batch = whole.slice(lo, hi - lo)
                texts = [t.encode() for t in batch["text"].to_pylist()]
                end = np.cumsum([len(t) for t in texts])
                first = end - np.array([len(t) for t in texts])
                hits = [(t, i) for t, f in sorted(facts.held(b"".join(texts), first, end)) for i in facts.ids[f]]
                ids = batch["doc"].take(pa.array([t for t, _ in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([i for _, i in hits], pa.int64()), ids], ["fact", "doc"])

    return run


def holding(docs: DataFrame, facts: DataFrame, doc_id: str, text: str, fact_id: str, fact: str) -> DataFrame:
    """(``fact_id``, ``doc_id``) for each fact row and each document row whose text holds it.

    The rarest gram of a fact is an equi-key that is met at every offset of a text; then the whole
    fact is compared. Facts go to the tasks in blocks of bounded bytes (a longer fact is one alone), a pass
    over the texts each. Facts of any length take part, an empty one is in every text; null texts hold
    nothing and null facts are nowhere. Ids are integers."""
    known = facts.where(F.col(fact).isNotNull()).select(F.col(fact_id).cast("long").alias("id"), F.col(fact).alias("fact"))
    size = known.agg(F.sum(F.octet_length("fact") + 32)).first()[0] or 0
    n_blocks = max(1, -(-size // FACT_BYTES))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    out = None
    for block in range(n_blocks):
        mine = known.where(F.pmod(F.xxhash64("id", "fact"), F.lit(n_blocks)) == block)
        table = _Facts([(r["id"], r["fact"].encode()) for r in mine.toLocalIterator()])
        found = rows.mapInArrow(_search(table), "fact long, doc long")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("fact").alias(fact_id), F.col("doc").alias(doc_id))
