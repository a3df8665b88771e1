"""Vectorised work on the bytes of many texts at once: words, word hashes and shingle hashes.

Hashes are 64 bits wide. A word's hash is a polynomial over a fixed random byte table, modulo 2**64, then mixed; a prefix
sum over the whole batch gives all words' polynomials without a loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_STEPS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n + n // 4, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        _powers[base] = have = np.cumprod(table)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty; bytes start at offset 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


class Words:
    """The words of each text: starts and ends in the bytes, and first[i]:first[i + 1], the words of text i."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.buf, self.off = raw(column)
        if lower:
            self.buf = _LOWER[self.buf]
        n = len(self.buf)
        full = self.off[:-1] < self.off[1:]
        space = _SPACE[self.buf]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        before[self.off[:-1][full]] = True
        after[self.off[1:][full] - 1] = True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, self.off)
        self.counts = np.diff(self.first)
        self.space = space

    def hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def spans(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hashes of the bytes from starts to ends, with lower those of A-Z as of a-z."""
        n = len(self.buf)
        if not n:
            return np.zeros(0, np.uint64)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[_LOWER[self.buf] if lower else self.buf] * _power_table(_BASE, n), out=prefix[1:])
        inverse = _power_table(_BASE_INVERSE, n)
        return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def shingles(words: Words, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its width-word shingles; with fewer words, of the whole sequence."""
    h = words.hashes()
    n = max(0, len(h) - width + 1)
    every = np.zeros(n, np.uint64)
    for j in range(width):
        every += h[j : n + j] * _STEPS[j]
    every = mix(every)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(every[a : b - width + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif b > a:
            whole = np.append(h[a:b] * _STEPS[20 : 20 + b - a], _STEPS[40 + b - a]).sum(dtype=np.uint64)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
