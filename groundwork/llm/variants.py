"""Spelling variants by finite-state composition.

The vocabulary is a minimised acceptor. Composed with a transducer that allows exactly one inserted,
deleted or replaced symbol, and with the acceptor again, it accepts the pairs of near words. The pairs are
enumerated from initial states that part the vocabulary: a state of the acceptor reached by the first half
of a word, and one of the acceptor of reversed words reached by its last half. With l the length of the
shorter word of a pair and h = l // 2, a pair whose first difference lies at h or later leaves the state of
its first h symbols together; any other pair has its last l - h symbols in common and leaves the state of
the reversed acceptor. So each pair comes from one state alone, states hold few words, and no state holds a
fixed share of the vocabulary. A state with more than ``block_words`` words is cut into blocks, of which
each two are composed: memory is bounded and no pair is lost.

Within a block the acceptor is built from sorted words, equal right languages merged. The composition
follows equal symbols, then one edit at the first difference, then equal symbols again, so each pair has one
accepting path; words are named by their place in the order, which follows from counts in the states.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased. Where ``drop_every`` divides the
crc32 of ``<id>:<run>``, the occurrence loses the code point at crc32 modulo its length. Null text has no
words, a null id counts as empty. Runs of any length are handled. Repeated rows count each time. Ties of the
largest n go to the word that is smaller in code points. Without words the result is empty; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import bytetext as bt
from .shared import Scratch

SLICE_BYTES = 4 << 20
#: Words of one block of an initial state; two blocks are composed at a time.
BLOCK_WORDS = 4000

_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: U+00C0 to U+00FF are this byte and one continuation byte.
_LEAD = 0xC3


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()
#: Runs of more bytes than this get their checksums one by one.
_LONG = 48


def run_crc(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The crc32 of each run, going on from ``seed`` (the crc32 of what stands before)."""
    size = end - start
    order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")
    state, first, length = ~seed[order], start[order], size[order]
    n_long = int(np.searchsorted(-length, -_LONG, "left"))
    for k in range(_LONG):
        n = int(np.searchsorted(-length, -k, "left"))  # runs of more than k bytes
        if n <= n_long:
            break
        part = slice(n_long, n)
        state[part] = _CRC[(state[part] ^ data[first[part] + k]) & 0xFF] ^ (state[part] >> 8)
    state = ~state
    for i in range(n_long):
        state[i] = zlib.crc32(data[first[i] : first[i] + length[i]].tobytes(), int(seed[order[i]]))
    out = np.empty(len(size), np.uint32)
    out[order] = state
    return out


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs, and the document of each."""
    lead = data == _LEAD
    after = np.r_[False, lead[:-1]] if len(data) else lead
    inside = np.r_[False, _LETTER[data] | lead | after, False]
    begin, end = inside[1:] & ~inside[:-1], ~inside[1:] & inside[:-1]
    for b in offsets[1:-1]:  # a run ends with its document
        if 0 < b < len(data) and inside[b] and inside[b + 1]:
            begin[b] = end[b] = True
    start, end = np.flatnonzero(begin), np.flatnonzero(end)
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_counter(drop_every: int, min_length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) to (word, n), words of a slice at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            data, offsets = bt.column_bytes(batch.column("text"))
            for lo, hi in bt.pieces(offsets, SLICE_BYTES):
                base = offsets[lo]
                part = _LOWER[data[base : offsets[hi]]]
                start, end, doc = _runs(part, offsets[lo : hi + 1] - base)
                if not len(start):
                    continue
                seed = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[lo:hi]], np.uint32)
                crc = run_crc(part, start, end, seed[doc])
                leads = np.r_[0, np.cumsum(part == _LEAD)]
                points = end - start - (leads[end] - leads[start])
                dropped = crc.astype(np.int64) % drop_every == 0
                changed = []
                for i in np.flatnonzero(dropped & (points > min_length)).tolist():
                    word, at = part[start[i] : end[i]].tobytes().decode(), int(crc[i]) % int(points[i])
                    changed.append(word[:at] + word[at + 1 :])
                whole = ~dropped & (points >= min_length)
                first, size = start[whole], (end - start)[whole]
                ends = np.r_[0, np.cumsum(size)].astype(np.int64)
                body = part[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
                words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body)))
                found = pc.value_counts(pa.chunked_array([words, pa.array(changed, pa.large_string())]))
                yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])

    return count


def vocabulary(docs: DataFrame, *, min_length: int = 5, min_count: int = 3, drop_every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least ``min_length`` code points and ``min_count`` occurrences."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(word_counter(drop_every, min_length), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Acceptor:
    """The minimal acyclic acceptor of sorted distinct strings. ``arcs[s]``: (symbol, next state, words
    before this arc) by symbol; ``final[s]``: whether a word ends here; ``words[s]``: words from here."""

    def __init__(self, strings: list[str]):
        self.arcs: list[tuple] = []
        self.final: list[bool] = []
        self.words: list[int] = []
        known: dict[tuple, int] = {}

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.arcs)
                total, arcs = int(node[0]), []
                for symbol, to in node[1]:
                    arcs.append((symbol, to, total))
                    total += self.words[to]
                self.arcs.append(tuple(arcs))
                self.final.append(node[0])
                self.words.append(total)
            return state

        path: list[list] = [[False, []]]  # the states of the last string, not yet settled: final, arcs
        last = ""
        for s in strings:
            same, most = 0, min(len(last), len(s))
            while same < most and s[same] == last[same]:
                same += 1
            for at in range(len(last), same, -1):
                path[at - 1][1].append((last[at - 1], settle(path.pop())))
            path.extend([False, []] for _ in range(len(s) - same))
            path[-1][0] = True
            last = s
        for at in range(len(last), 0, -1):
            path[at - 1][1].append((last[at - 1], settle(path.pop())))
        self.start = settle(path[0])


def near_pairs(a: Acceptor, b: Acceptor) -> Iterator[tuple[int, int]]:
    """The composition of ``a``, the one-edit transducer and ``b``: places (i in a, j in b) of words that
    differ by one symbol inserted, deleted or replaced. With ``a is b`` each pair comes once."""
    arcs_a, arcs_b, final_a, final_b = a.arcs, b.arcs, a.final, b.final
    same = a is b
    before = [(a.start, b.start, 0, 0)]  # no edit yet: one path, of equal symbols
    after: list[tuple[int, int, int, int]] = []  # one edit made: only equal symbols from here
    while before:
        x, y, i, j = before.pop()
        left, right = arcs_a[x], arcs_b[y]
        to_b = {symbol: (to, n) for symbol, to, n in right}
        for c, p, n in left:
            if c in to_b:
                q, m = to_b[c]
                before.append((p, q, i + n, j + m))
            for d, q, m in right:
                if c < d or c != d and not same:  # c is replaced by d
                    after.append((p, q, i + n, j + m))
        # d is inserted: what follows in the left word begins with another symbol, or ends.
        for d, q, m in right:
            if final_a[x] and final_b[q]:
                yield i, j + m
            to_q = {symbol: (to, k) for symbol, to, k in arcs_b[q]}
            for c, p, n in left:
                if c != d and c in to_q:
                    to, k = to_q[c]
                    after.append((p, to, i + n, j + m + k))
        if not same:  # c is deleted
            for c, p, n in left:
                if final_b[y] and final_a[p]:
                    yield i + n, j
                to_p = {symbol: (to, k) for symbol, to, k in arcs_a[p]}
                for d, q, m in right:
                    if c != d and d in to_p:
                        to, k = to_p[d]
                        after.append((to, q, i + n + k, j + m))
        while after:
            x, y, i, j = after.pop()
            if same and x == y:
                yield from ((i + k, j + k) for k in range(a.words[x]))
                continue
            if final_a[x] and final_b[y]:
                yield i, j
            to_b = {symbol: (to, n) for symbol, to, n in arcs_b[y]}
            for c, p, n in arcs_a[x]:
                if c in to_b:
                    q, m = to_b[c]
                    after.append((p, q, i + n, j + m))


def state_pairs(rows: list[tuple[str, int]], x: int, y: int, half: int, backward: bool) -> Iterator[tuple[int, int]]:
    """Places of near pairs of blocks ``x`` and ``y`` of one state. Rows: word, its block, in any order.
    ``half`` symbols are the state's own; other pairs of its words are left to the states they belong to."""

    def tail(word: str) -> str:
        return word[: len(word) - half][::-1] if backward else word[half:]

    def acceptor(block: int) -> tuple[Acceptor, list[int]]:
        own = sorted((tail(w), at) for at, (w, b) in enumerate(rows) if b == block)
        return Acceptor([t for t, _ in own]), [at for _, at in own]

    a = acceptor(x)
    b = a if x == y else acceptor(y)
    most = 2 * half if backward else 2 * half + 1  # of the shorter word
    for i, j in near_pairs(a[0], b[0]):
        p, q = a[1][i], b[1][j]
        u, v = sorted((rows[p][0], rows[q][0]), key=len)
        if len(u) <= most and not (backward and len(v) > len(u) and v.startswith(u[: len(u) - half])):
            yield p, q


def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (state, x, y, half, backward, block, word, n) in order of state and blocks to pairs, both ways."""
    out: list[list] = [[], [], []]
    held: list[tuple[str, int, int]] = []
    key = None

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(out, (pa.string(), pa.string(), pa.int64()))]
        for c in out:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "near", "near_n"])

    def close() -> None:
        if len(held) < 2:
            return
        for i, j in state_pairs([r[:2] for r in held], *key[1:]):
            (u, _, m), (v, _, n) = held[i], held[j]
            for column, both in zip(out, ((u, v), (v, u), (n, m))):
                column.extend(both)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("state", "x", "y", "half", "backward", "word", "block", "n")]
        for *at, word, block, n in zip(*columns):
            if at != key:
                close()
                held, key = [], at
            held.append((word, block, n))
        if len(out[0]) > 50_000:
            yield flush()
    close()
    yield flush()


def near_words(words: DataFrame, *, min_length: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, near, near_n) for every two near words of ``words`` (word, n), each pair both ways."""
    size = F.length("word")
    halves = []
    for short in (size, size - 1):  # the word is the shorter or the longer one of a pair
        ok = short >= min_length
        front, back = F.floor(short / 2).cast("int"), F.ceil(short / 2).cast("int")
        halves += [F.when(ok, F.struct(front.alias("half"), F.lit(False).alias("backward"))), F.when(ok, F.struct(back.alias("half"), F.lit(True).alias("backward")))]
    own = F.when(F.col("at.backward"), F.expr("right(word, at.half)")).otherwise(F.expr("left(word, at.half)"))
    rows = words.select("word", "n", F.explode(F.array_distinct(F.array_compact(F.array(*halves)))).alias("at"))
    rows = rows.select("word", "n", "at.*", own.alias("state"))
    state = ["state", "half", "backward"]
    many = rows.groupBy(*state).agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    parts = F.ceil(F.col("held") / block_words).cast("int")
    rows = rows.join(many, state).select(*state, "word", "n", parts.alias("parts"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    dealt = rows.select(*state, "x", "y", "block", "word", "n").repartition(*state, "x", "y").sortWithinPartitions(*state, "x", "y")
    return dealt.mapInArrow(compose, "word string, near string, near_n bigint")


def follow(forms: DataFrame, tmp: Scratch) -> DataFrame:
    """(word, root) from (word, form): each form's last form. The n of forms at least doubles from word to
    form, so ways are short, and each round halves what is left of them."""
    ways = tmp.write(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = tmp.write(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        tmp.drop(ways)
        ways = step.select("word", "root")
        if step.where("moved").isEmpty():
            return ways


def spelling_variants(docs: DataFrame, *, min_length: int = 5, min_count: int = 3, drop_every: int = 97, ratio: int = 2, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    tmp = Scratch(docs.sparkSession)
    words = tmp.write(vocabulary(docs, min_length=min_length, min_count=min_count, drop_every=drop_every, id_col=id_col, text_col=text_col), "vocabulary")
    near = near_words(words, min_length=min_length, block_words=block_words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    ok = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(ok, F.col("best.near")).alias("form"), F.when(ok, -F.col("best.less")).alias("form_n"),
    )
    found = tmp.write(found, "forms")
    roots = follow(found.where("form IS NOT NULL"), tmp)
    out = found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return tmp.result(out, "variants")
