"""Chunks by structure within a budget of tokens.

A document is a list of blocks in order: headings with a level, and texts. A chunk holds texts below one
path of headings, and its tokens are those of the headings and the text together, counted by a vocabulary,
not by blanks. Texts that exceed the budget are cut at the ends of sentences, then between words, then
between characters; then neighbours below one path are joined while they fit. Headings that leave less than
half of the budget give way from the outermost, and the last one is cut.

Where a vocabulary never joins characters across blanks and line ends, as byte-level ones with the usual pattern,
a text's tokens are the sum of its parts': each is counted once, and a batch's texts together. Other vocabularies
count what is joined anew.

Documents are dealt by key and read in order, and a task holds the chunk that it is at, so a document may be
of any length. Null and blank texts are passed over; headings without a text make no chunk."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed value: the most tokens of a chunk.
MAX_TOKENS = 512
#: Characters that are counted in one call.
CALL_CHARS = 200_000
Counter = Callable[[list[str]], list[int]]


def counts_add(path: str) -> bool:
    """Whether tokens of the file at ``path`` begin anew at each blank and line end between other characters:
    byte-level vocabularies with the usual pattern, no normaliser, and no added tokens but special ones."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return usual and not spec.get("normalizer") and not spec.get("post_processor") and all(t.get("special") for t in spec.get("added_tokens") or [])


def vocabulary_counter(path: str) -> Callable[[], Counter]:
    """A counter by the tokenizer file at ``path``, opened once per task."""

    def opened() -> Counter:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = True

        def count(texts: list[str]) -> list[int]:
            return [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]

        count.adds = counts_add(path)
        return count

    return opened


def context(headings: list[str], text: str) -> str:
    return "\n".join([*headings, text])


def counted(count: Counter, texts: list[str]) -> list[int]:
    """The tokens of each text; equal ones are counted once, in calls of bounded size."""
    known: dict[str, int] = dict.fromkeys(texts, 0)
    held, size = [], 0
    for text in [*known, None]:
        if held and (text is None or size + len(text) > CALL_CHARS):
            known.update(zip(held, count(held)))
            held, size = [], 0
        if text is not None:
            held.append(text)
            size += len(text)
    return [known[t] for t in texts]


class _Chunks:
    """The fold over one document's blocks."""

    def __init__(self, count: Counter, most: int):
        self.count, self.most = count, most
        self.path: list[tuple[int, str]] = []
        self.headings: list[str] = []
        self.held: str | None = None
        self.tokens = 0

    def size(self, text: str) -> int:
        return self.count([context(self.headings, text)])[0]

    def heading(self, level: int, text: str) -> Iterator[tuple[list[str], str, int]]:
        yield from self.end()
        self.path = [(n, h) for n, h in self.path if n < level] + [(level, text)]
        self.headings = [h for _, h in self.path]
        while self.headings and self.size("") > self.most // 2:
            if len(self.headings) > 1:
                self.headings = self.headings[1:]
            elif len(self.headings[0]) > 1:
                self.headings = [self.headings[0][: len(self.headings[0]) // 2]]
            else:
                self.headings = []

    def pieces(self, text: str) -> Iterator[str]:
        """Parts of a text that fit, each as long as its kind of border allows."""
        if self.size(text) <= self.most:
            yield text
            return
        for border in (r"(?<=[.!?])\s+", r"\s+", None):
            parts = re.split(border, text) if border else list(text)
            if len(parts) > 1:
                break
        joint = " " if border else ""
        lo = 0
        while lo < len(parts):
            # The most parts that fit, doubling and then halving the step: a count costs a pass over its text.
            n, step = 1, 1
            while lo + n < len(parts) and self.size(joint.join(parts[lo : lo + n + step])) <= self.most:
                n += step
                step *= 2
            while step > 1:
                step //= 2
                if lo + n < len(parts) and self.size(joint.join(parts[lo : lo + n + step])) <= self.most:
                    n += step
            part = joint.join(parts[lo : lo + n])
            lo += n
            if len(part) > 1 and n == 1 and self.size(part) > self.most:
                yield from self.pieces(part)
            else:
                yield part

    def text(self, text: str) -> Iterator[tuple[list[str], str, int]]:
        for piece in self.pieces(text):
            joined = piece if self.held is None else f"{self.held}\n{piece}"
            size = self.size(joined)
            if self.held is not None and size > self.most:
                yield from self.end()
                joined, size = piece, self.size(piece)
            self.held, self.tokens = joined, size

    def end(self) -> Iterator[tuple[list[str], str, int]]:
        if self.held is not None:
            yield self.headings, self.held, self.tokens
        self.held = None


class _Sums(_Chunks):
    """The same where counts add up: a text comes with its tokens, or they are counted."""

    def __init__(self, count: Counter, most: int):
        super().__init__(count, most)
        self.above, self.line = 0, count(["\n"])[0]

    def heading(self, level: int, text: str) -> Iterator[tuple[list[str], str, int]]:
        yield from super().heading(level, text)
        # What headings take before any text: a text of one letter shows it.
        with_text, alone = self.count([context(self.headings, "x"), "x"])
        self.above = with_text - alone

    def cut(self, text: str, n: int) -> Iterator[tuple[str, int]]:
        """As :meth:`pieces`, with the tokens of each."""
        if self.above + n <= self.most:
            yield text, n
            return
        parts = re.split(r"(?<=[.!?])\s+", text)
        if len(parts) == 1:
            parts = text.split()
        if len(parts) == 1:
            pieces = list(self.pieces(text))
            yield from zip(pieces, counted(self.count, pieces))
            return
        sums = [0, *accumulate(counted(self.count, [f" {p}" for p in parts]))]
        lo = 0
        while lo < len(parts):
            first = self.count([parts[lo]])[0]
            # The last part with which the sum fits, the first one counted without a blank before it.
            hi = max(lo + 1, bisect_right(sums, self.most - self.above - first + sums[lo + 1], lo + 1) - 1)
            part, size = " ".join(parts[lo:hi]), first + sums[hi] - sums[lo + 1]
            lo = hi
            if len(part) > 1 and self.above + size > self.most:
                yield from self.cut(part, size)
            else:
                yield part, size

    def text(self, text: str, n: int | None = None) -> Iterator[tuple[list[str], str, int]]:
        for piece, size in self.cut(text, self.count([text])[0] if n is None else n):
            if self.held is not None and self.tokens + self.line + size > self.most:
                yield from self.end()
            self.tokens = self.above + size if self.held is None else self.tokens + self.line + size
            self.held = piece if self.held is None else f"{self.held}\n{piece}"


def hybrid_chunks(blocks: DataFrame, key: str, counter: Callable[[], Counter], max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(key, ord, headings, chunk, tokens). ``blocks``: key, pos, level (0: text), text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, state, now, n = counter(), None, None, 0
        adds = getattr(count, "adds", False)
        for batch in batches:
            rows: list[tuple] = []

            def emit(found: Iterator[tuple[list[str], str, int]], of) -> None:
                nonlocal n
                for headings, chunk, tokens in found:
                    rows.append((of, n, list(headings), chunk, tokens))
                    n += 1

            texts = [" ".join((text or "").split()) for text in batch.text]
            sizes = counted(count, ["" if level else text for level, text in zip(batch.level, texts)]) if adds else texts
            for k, level, text, size in zip(batch[key], batch.level, texts, sizes):
                if state is None or k != now:
                    if state is not None:
                        emit(state.end(), now)
                    state, now, n = (_Sums if adds else _Chunks)(count, max_tokens), k, 0
                if text:
                    emit(state.heading(int(level), text) if level else state.text(text, size) if adds else state.text(text), k)
            yield pd.DataFrame(rows, columns=[key, "ord", "headings", "chunk", "tokens"], dtype=object)
        if state is not None:
            rows = [(now, n + i, list(h), c, t) for i, (h, c, t) in enumerate(state.end())]
            yield pd.DataFrame(rows, columns=[key, "ord", "headings", "chunk", "tokens"], dtype=object)

    dealt = blocks.select(key, "pos", "level", "text").where(f"`{key}` IS NOT NULL").repartition(key).sortWithinPartitions(key, "pos")
    return dealt.mapInPandas(run, f"`{key}` {dict(blocks.dtypes)[key]}, ord int, headings array<string>, chunk string, tokens int")
