"""Words of many texts at once, as arrays over their UTF-8 bytes.

Words are ``[^\\x20\\x09-\\x0D]+``; all of these separators are single ASCII bytes, so bytes suffice. A word's
hash is a 64-bit polynomial over its bytes, mixed; equal words have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
CHUNK = 1 << 20  # bytes of text at a time: a worker needs some 50 times as much
_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 2**64)))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of some texts: byte ranges, and which text each one is in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~SPACES[data]
        fresh = np.zeros(len(data) + 1, bool)
        fresh[offsets] = True
        before = np.ones(len(data), bool)
        before[1:] = ~inside[:-1]
        after = np.ones(len(data), bool)
        after[:-1] = ~inside[1:]
        self.starts = np.flatnonzero(inside & (before | fresh[:-1]))
        self.ends = np.flatnonzero(inside & (after | fresh[1:])) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        #: words of text i are numbers first[i] to first[i + 1] - 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """Of the words, or of byte ranges inside them."""
        powers, inverse = _power_tables(len(self.data) + 1)
        if not hasattr(self, "_sums"):
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_VALUES[self.data] * powers[: len(self.data)], out=self._sums[1:])
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        return mix((self._sums[ends] - self._sums[starts]) * inverse[starts])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of strings; null counts as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes, one row at least."""
    _, offsets = buffers(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, len(texts))
        lo = min(hi, len(texts))


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges start, start + 1, ..., one after the other."""
    out = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) if len(sizes) else np.zeros(0, np.int64)
    return out + np.arange(len(out))
