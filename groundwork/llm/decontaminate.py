"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every item gives windows of ``window`` consecutive words (an item of fewer words, but not none, is
one window). Windows of one length are searched together. A table says how far the search may jump
from a block of ``BLOCK`` words: past every position at which no window can end. Blocks with shift 0
that end a window select a bucket by the hash of the block; the bucket's test strings are in order of
a hash of the whole window, and the one that is found is compared word by word and byte by byte.

A pattern table is a few flat arrays (:class:`PatternTable`), about ten bytes for one of item text,
and is broadcast. It holds at most ``block_bytes`` of item text; a larger benchmark is searched in
blocks, one pass each, with a written table between. The table of shifts has eight slots or more
for a block of words, so that positions are skipped at every size of the benchmark. The documents
stay where they are: no shuffle.

Null and empty texts and texts without words have n_words 0 and no hit; a null item id marks words
but is not reported; items given twice count once; an empty benchmark hits nothing; an empty table
gives no rows; repeated rows are judged alike; other columns are kept, those of the added names
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytetext as bt
from .shared import written

#: Words of a block; documents are searched in stretches of so many words, side by side.
BLOCK, STRETCH = 3, 256
_ADDED = ("n_words", "n_hit", "spans", "items")
_TYPES = "n_words long, n_hit long, spans array<struct<first:int,last:int>>, items array<string>"
_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32())])


def _chained(h: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words that end at each of ``end``."""
    out = bt.mix(h[end - n + 1] + np.uint64(n))
    for k in range(n - 2, -1, -1):
        out = bt.mix(h[end - k] + out)
    return out


def _runs(count: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


class PatternTable:
    """All windows of ``length`` words of the items whose words are ``w``; ``item`` says which item each
    of the documents of ``w`` is, -1 where it has no id."""

    def __init__(self, length: int, w: bt.Words, item: np.ndarray):
        self.length, self.block = length, min(BLOCK, length)
        keep = np.flatnonzero(np.diff(w.first) >= length)
        n = np.diff(w.first)[keep]
        self.data, self.start, self.end, self.hash = w.data, w.start.astype(np.int32), w.end.astype(np.int32), w.hash
        # Shifts: a block that ends at word e of an item ends a window if e >= length - 1, and else
        # stands length - 1 - e words before the end of the item's first one.
        far = _runs(n)
        word = np.repeat(w.first[keep], n) + far
        ends = far >= self.block - 1
        shift = np.maximum(0, length - 1 - far[ends])
        key = _chained(w.hash, word[ends], self.block)
        self.bits = max(12, int(len(key)).bit_length() + 3)
        self.shift = np.full(1 << self.bits, min(255, length - self.block + 1), np.uint8)
        np.minimum.at(self.shift, self._slot(key), np.minimum(shift, 255).astype(np.uint8))
        # Buckets: windows by the hash of their last block, then by the hash of all their words.
        last = word[far >= length - 1]
        suffix, full = _chained(w.hash, last, self.block), _chained(w.hash, last, length)
        order = np.lexsort((full, suffix))
        suffix, full, last, owner = suffix[order], full[order], last[order], np.repeat(item[keep], n - length + 1)[order]
        same = np.ones(max(0, len(last) - 1), bool)
        for k in range(length):
            same &= w.hash[last[1:] - k] == w.hash[last[:-1] - k]
        new = np.r_[np.ones(min(1, len(last)), bool), ~same]
        cut = np.flatnonzero(new)
        self.full, self.last = full[cut], last[cut].astype(np.int32)
        self.items, self.items_at = owner.astype(np.int32), np.append(cut, len(last))
        suffix = suffix[cut]
        opens = np.flatnonzero(np.r_[True, suffix[1:] != suffix[:-1]]) if len(cut) else cut
        self.suffix, self.bucket = suffix[opens], np.append(opens, len(cut))
        self.looked = 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, w: bt.Words) -> tuple[np.ndarray, np.ndarray]:
        """(last word, window) of each occurrence in the documents of ``w``."""
        m = self.length
        none = np.empty(0, np.int64)
        if len(w.hash) < m or not len(self.full):
            return none, none
        # Stretches of documents: where a window may end, from the first such word on.
        count = np.maximum(np.diff(w.first) - (m - 1), 0)
        times = -(-count // STRETCH)
        at = np.repeat(w.first[:-1] + m - 1, times) + _runs(times) * STRETCH
        stop = np.minimum(at + STRETCH, np.repeat(w.first[1:], times))
        found = []
        while len(at):
            self.looked += len(at)
            jump = self.shift[self._slot(_chained(w.hash, at, self.block))]
            hit = jump == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(jump, 1)
            left = at < stop
            at, stop = at[left], stop[left]
        if not found:
            return none, none
        return self._confirmed(w, np.sort(np.concatenate(found)))

    def _confirmed(self, w: bt.Words, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = _chained(w.hash, end, self.block)
        b = np.minimum(np.searchsorted(self.suffix, key), len(self.suffix) - 1)
        ok = self.suffix[b] == key
        end, b = end[ok], b[ok]
        full = _chained(w.hash, end, self.length)
        low, high = self.bucket[b], self.bucket[b + 1]
        stop = high.copy()
        while (open_ := low < high).any():  # each in its own bucket
            mid = (low + high) // 2
            less = self.full[np.minimum(mid, len(self.full) - 1)] < full
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        ok = low < stop
        ok[ok] = self.full[low[ok]] == full[ok]
        end, window = end[ok], low[ok]
        same = np.ones(len(end), bool)
        for k in range(self.length):
            i, j = end[same] - k, self.last[window[same]] - k
            same[same] = self._equal(w, i, j)
        return end[same], window[same]

    def _equal(self, w: bt.Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether words ``i`` of ``w`` and ``j`` of the items are the same bytes."""
        size = w.end[i] - w.start[i]
        same = size == self.end[j] - self.start[j]
        size = np.where(same, size, 0)
        off = _runs(size)
        differ = w.data[np.repeat(w.start[i], size) + off] != self.data[np.repeat(self.start[j], size) + off]
        return same & (np.bincount(np.repeat(np.arange(len(i)), size), differ, len(i)) == 0)


class Patterns:
    """The pattern tables of a block of items, by window length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.names = sorted({i for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.names)}
        raw = [(t or "").encode() for _, t in items]
        item = np.array([number.get(i, -1) for i, _ in items], np.int64)
        w = bt.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), bt.byte_class("alnum"))
        n = np.diff(w.first)
        self.tables = []
        for m in sorted({int(min(x, window)) for x in n.tolist() if x}):
            mine = np.flatnonzero(n >= m if m == window else n == m)
            self.tables.append(PatternTable(m, _chosen(w, mine), item[mine]))

    def occurrences(self, w: bt.Words) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(first word, last word) of occurrences, and per table (last word, item number)."""
        first, last, named = [], [], []
        for t in self.tables:
            end, window = t.search(w)
            first.append(end - t.length + 1)
            last.append(end)
            count = t.items_at[window + 1] - t.items_at[window]
            item = t.items[np.repeat(t.items_at[window], count) + _runs(count)]
            named.append((np.repeat(end, count)[item >= 0], item[item >= 0]))
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return cat(first), cat(last), named


def _chosen(w: bt.Words, docs: np.ndarray) -> bt.Words:
    """The words of some documents of ``w``."""
    n = np.diff(w.first)[docs]
    at = np.repeat(w.first[docs], n) + _runs(n)
    return bt.Words(w.data, w.start[at], w.end[at], w.hash[at], np.append(0, np.cumsum(n)))


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], b)
        else:
            out.append({"first": a, "last": b})
    return out


def _step(sent, text_col: str):
    """Adds a block's occurrences to what earlier blocks found."""
    alnum = bt.byte_class("alnum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = sent.value
        for batch in batches:
            names = [n for n in batch.schema.names if n not in _ADDED]
            data, offsets = bt.column_bytes(batch[text_col])
            had = {c: batch[c].to_pylist() for c in ("spans", "items")}
            n_words: list[int] = []
            for i, j in bt.pieces(offsets):
                w = bt.words(data, offsets[i : j + 1], alnum)
                n_words += np.diff(w.first).tolist()
                first, last, named = patterns.occurrences(w)
                doc = np.searchsorted(w.first, last, "right") - 1
                more: dict[int, list[tuple[int, int]]] = {}
                for d, a, b in zip(doc.tolist(), (first - w.first[doc]).tolist(), (last - w.first[doc]).tolist(), strict=True):
                    more.setdefault(d, []).append((a, b))
                for d, spans in more.items():
                    had["spans"][i + d] = _merged([(s["first"], s["last"]) for s in had["spans"][i + d]] + spans)
                for end, item in named:
                    pairs = np.unique(np.stack([np.searchsorted(w.first, end, "right") - 1, item]), axis=1)
                    for d, k in pairs.T.tolist():
                        had["items"][i + d].append(patterns.names[k])
            items = [sorted(set(x)) for x in had["items"]]
            n_hit = [sum(s["last"] - s["first"] + 1 for s in x) for x in had["spans"]]
            yield pa.RecordBatch.from_arrays(
                [*[batch[n] for n in names], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(had["spans"], pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string()))],
                [*names, *_ADDED],
            )

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, block_bytes: int = 8 << 20,
) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside an occurrence), spans (their runs, by word
    position) and items (the items with an occurring window, sorted as strings). Columns of these
    names are replaced. One item longer than ``block_bytes`` is a block of its own."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in _ADDED]
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Blocks are dealt by hash: half full on average, so that hardly one goes beyond the bound.
    n_blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    bench = bench.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    df = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<struct<first:int,last:int>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    for block in range(n_blocks):
        items = [(r["item"], r["text"]) for r in bench.where(F.col("block") == block).select("item", "text").distinct().toLocalIterator()]
        df = df.mapInArrow(_step(spark.sparkContext.broadcast(Patterns(items, window)), text_col), f"{schema}, {_TYPES}")
        if block + 1 < n_blocks:
            df = written(df, "decontaminate")
    return df
