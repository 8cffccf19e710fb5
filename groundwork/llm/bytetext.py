"""Vectorised word handling over whole Arrow string columns.

A batch of texts is looked at as one UTF-8 byte buffer. Words are maximal runs of bytes of a
256-entry class table, and each word gets a 64-bit hash from prefix sums, so no Python object is
made per word. Memory is bounded by the batch and by ``pieces``, which cuts a batch at document
borders; a single document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_POW = _powers(_BASE, _BLOCK)
_INV = _powers(pow(_BASE, -1, 1 << 64), _BLOCK)
_TABLE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def byte_class(inside: str) -> np.ndarray:
    """256 booleans. ``alnum``: digits, ASCII letters and all bytes from 0x80; ``letters``: the
    same without digits; ``nonspace``: all but space and 0x09-0x0D."""
    b = np.arange(256)
    if inside == "nonspace":
        return ~((b == 0x20) | ((b >= 0x09) & (b <= 0x0D)))
    low = b | 0x20
    word = ((low >= 0x61) & (low <= 0x7A) & (b < 0x80)) | (b >= 0x80)
    if inside == "letters":
        return word
    if inside == "alnum":
        return word | ((b >= 0x30) & (b <= 0x39))
    raise ValueError(f"unknown byte class {inside!r}")


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """Words of some documents: byte borders within ``data``, a hash each, and per document the
    index of its first word (``first`` has one entry more than there are documents)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its document borders; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = col.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, col.offset * 8)
    if values is None or off[-1] == off[0]:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(values, np.uint8, int(off[-1] - off[0]), int(off[0]))
    return data, off - off[0]


def pieces(offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``limit`` bytes together, at least one document each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> Words:
    """All words of the documents ``data[offsets[i]:offsets[i+1]]``."""
    base = offsets[0]
    data = data[base : offsets[-1]]
    offsets = offsets - base
    n = len(data)
    if lower:
        data = _LOWER[data]
    ok = inside[data]
    begins = np.empty(n + 1, bool)
    ends = np.empty(n + 1, bool)
    begins[:n] = ok
    begins[1:n] &= ~ok[:-1]
    begins[n] = False
    ends[1:] = ok
    ends[1:n] &= ~ok[1:]
    ends[0] = False
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    if len(inner):
        split = inner[ok[inner] & ok[inner - 1]]
        begins[split] = True
        ends[split] = True
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends)
    return Words(data, start, end, run_hashes(data, start, end), np.searchsorted(start, offsets))


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run, equal for equal bytes wherever they stand."""
    n = len(data)
    out = np.zeros(len(start), np.uint64)
    if n == 0 or len(start) == 0:
        return out
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    carry, shift = np.uint64(0), 1
    for at in range(0, n, _BLOCK):
        part = _TABLE[data[at : at + _BLOCK]] * _POW[: min(_BLOCK, n - at)]
        if at:
            part *= np.uint64(shift)
        np.cumsum(part, out=total[at + 1 : at + 1 + len(part)])
        total[at + 1 : at + 1 + len(part)] += carry
        carry = total[min(n, at + _BLOCK)]
        shift = shift * pow(_BASE, _BLOCK, 1 << 64) % (1 << 64)
    out = (total[end] - total[start]) * _INV[start % _BLOCK]
    block = start // _BLOCK
    if n > _BLOCK:
        back = pow(pow(_BASE, _BLOCK, 1 << 64), -1, 1 << 64)
        out *= _powers(back, int(block[-1]) + 1)[block]
    return mix(out ^ (end - start).astype(np.uint64))


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document its sorted distinct ``size``-word shingle hashes, laid end to end, and the
    borders. A document of fewer words, but not none, has its whole sequence as one shingle."""
    h, first = w.hash, w.first
    count = np.diff(first)
    if len(h) >= size:
        s = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            s = mix(s) + h[k : len(h) - size + 1 + k]
        s = mix(s)
    else:
        s = np.empty(0, np.uint64)
    out, borders = [], np.zeros(len(count) + 1, np.int64)
    for i, n in enumerate(count.tolist()):
        a = int(first[i])
        if n >= size:
            x = np.sort(s[a : a + n - size + 1])
            if len(x) > 1:
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
        elif n:
            v = h[a : a + 1].copy()
            for k in range(1, n):
                v = mix(v) + h[a + k : a + k + 1]
            x = mix(v ^ np.uint64(0xA5A5A5A5A5A5A5A5 + n))
        else:
            x = h[:0]
        out.append(x)
        borders[i + 1] = borders[i] + len(x)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), borders


def run_hashes_at(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``run_hashes`` for runs in any order, each of few bytes or many."""
    out = np.zeros(len(start), np.uint64)
    size = end - start
    left = np.arange(len(start))
    k = 0
    while len(left):
        left = left[size[left] > k]
        out[left] += _TABLE[data[start[left] + k]] * _POW[k % _BLOCK]
        k += 1
        if k == 64 and len(left):  # long runs: one by one
            for i in left.tolist():
                whole = data[start[i] : end[i]]
                out[i] = run_hashes(whole, np.array([0]), np.array([len(whole)]))[0]
            return bt_mix_short(out, size)
    return bt_mix_short(out, size)


def bt_mix_short(out: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Finishes the hashes of runs of up to 64 bytes; longer ones are finished already."""
    short = size <= 64
    out[short] = mix(out[short] ^ size[short].astype(np.uint64))
    return out
