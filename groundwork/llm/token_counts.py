"""Exact token counts by prefix dynamic programming over a byte-pair vocabulary.

Text is cut into the pieces that the tokenizer's own pattern cuts; merges never cross them. For a
piece, count[i] is the exact number of tokens of its first i bytes: the encoding of a prefix ends
in the one token t for which the encoding of what precedes t ends in a token that stays beside t
under the merges, so count[i] = count[i - len(t)] + 1. A document stores the running count at
every piece border; together they answer budget and truncation questions for every prefix without
encoding again.

The vocabulary file is a parameter, read once per Python worker. Pieces met before are looked up
in a table of bounded size. Files with a normaliser, another pre-tokeniser or other added tokens
are refused. Null and empty texts have no tokens. Special tokens inside a text count as one token,
as the library does by default. No shuffle; one pass. Repeated rows count alike, an empty table
gives no rows, other columns are kept, those of the added names are replaced.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern by which byte-level vocabularies of this kind cut text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered per Python worker, and pairs of tokens.
MAX_PIECES, MAX_PAIRS = 300_000, 500_000


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _check(spec: dict) -> None:
    """Refuses files whose steps differ from those that are followed here."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [t["content"] for t in spec["added_tokens"] if not t.get("special") or t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model.get("type") != "BPE" or spec.get("normalizer") or not byte_level or not plain or odd:
        raise ValueError("not a byte-level pair vocabulary without normaliser: token counts would not be exact")


class PrefixCounter:
    """Token counts of every prefix of a text, for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_of_char()
        raw = lambda s: bytes(chars[c] for c in s)
        _check(spec)
        special = [t["content"] for t in spec["added_tokens"]]
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.tails = {t[i:] for t in self.ids for i in range(len(t))}
        self.specials = special
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cut = regex.compile(PIECES)
        self.pair_ok: dict[tuple[bytes, bytes], bool] = {}
        self.known = _Known(self)

    def merge(self, piece: bytes) -> list[bytes]:
        """The tokens of a short piece by its merges, lowest rank first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def stays(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens side by side are their own encoding; an empty left asks of one."""
        key = (left, right)
        got = self.pair_ok.get(key)
        if got is None:
            if len(self.pair_ok) >= MAX_PAIRS:
                self.pair_ok.clear()
            got = self.pair_ok[key] = self.merge(left + right) == [t for t in key if t]
        return got

    def prefixes(self, piece: bytes) -> list[int]:
        """count[i] for i from 0 to the length of the piece."""
        count, last, ids, tails = [0], [b""], self.ids, self.tails
        for i in range(1, len(piece) + 1):
            for a in range(i - 1, -1, -1):
                t = piece[a:i]
                if t not in tails:
                    a = -1
                    break
                if t in ids and self.stays(last[a], t):
                    break
            else:
                a = -1
            if a < 0:
                raise ValueError(f"the vocabulary cannot encode {piece[:i]!r}")
            count.append(count[a] + 1)
            last.append(t)
        return count

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of ordinary text, and special tokens (True)."""
        at = 0
        if any(s in text for s in self.specials):
            for m in self.special.finditer(text):
                yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        yield (text[at:] if at else text), False

    def pieces(self, text: str) -> tuple[list[str], list[int]]:
        """The pieces of a text and their counts."""
        if not any(s in text for s in self.specials):
            own = self.cut.findall(text)
            return own, list(map(self.known.__getitem__, own))
        pieces, counts = [], []
        for part, is_special in self.segments(text):
            own = [part] if is_special else self.cut.findall(part)
            pieces += own
            counts += [1] if is_special else [self.known[p] for p in own]
        return pieces, counts

    def count(self, text: str) -> int:
        return sum(self.pieces(text)[1])

    def cut_at(self, pieces: list[str], counts: list[int], budget: int) -> int:
        """The most characters of a text that ``budget`` of its own tokens cover: the counts of
        whole pieces, then the prefix counts of the piece that is cut."""
        total = list(accumulate(counts))
        k = bisect_right(total, budget)
        whole = sum(map(len, pieces[:k]))
        left, chars = budget - (total[k - 1] if k else 0), whole
        if k < len(pieces) and left > 0 and not (self.special and self.special.fullmatch(pieces[k])):
            inside, at = self.prefixes(pieces[k].encode()), 0
            for n, c in enumerate(pieces[k], 1):
                at += len(c.encode())
                if inside[at] <= left:
                    chars = max(chars, whole + n)
        return chars

    def fit(self, text: str, budgets: Sequence[int]) -> list[int]:
        """:meth:`cut_at` for each budget."""
        pieces, counts = self.pieces(text)
        return [self.cut_at(pieces, counts, b) for b in budgets]


class _Known(dict):
    """Counts of pieces met before."""

    def __init__(self, of: PrefixCounter):
        super().__init__()
        self.of = of

    def __missing__(self, piece: str) -> int:
        n = self.of.prefixes(piece.encode())[-1]
        if len(piece) <= 32:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, *, text_col: str = "text", budgets: Sequence[int] = ()) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and, where ``budgets`` are given, fits: per budget the
    characters that fit. Columns of these names are replaced."""
    added = ["n_bytes", "n_tokens", *(["fits"] if budgets else [])]
    keep = [f for f in docs.schema if f.name not in added]
    names, wanted = [f.name for f in keep], list(budgets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(vocabulary)
        for batch in batches:
            n_bytes, n_tokens, fits = [], [], []
            for value in batch[text_col]:
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                pieces, counts = of.pieces(text)
                total = sum(counts)
                n_tokens.append(total)
                if wanted:
                    fits.append([len(text) if total <= b else of.cut_at(pieces, counts, b) for b in wanted])
            cols = [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())]
            cols += [pa.array(fits, pa.list_(pa.int32()))] if wanted else []
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], *cols], [*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    tail = "n_bytes long, n_tokens long" + (", fits array<int>" if wanted else "")
    return docs.mapInArrow(run, f"{schema}, {tail}" if schema else tail)
