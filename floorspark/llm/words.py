"""Words and shingles of whole texts as arrays of 64-bit hashes.

The helpers work on the bytes of an Arrow batch at once. A word is hashed from
prefix sums over the batch, so no Python object is made per word. Texts are cut
at byte separators only, which never occur inside a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time (whole texts: one longer text comes alone).
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_MIX = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators: space and \t to \r.
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

#: Separators: all ASCII but digits and letters.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:128] = [not chr(b).isalnum() for b in range(128)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place); a bijection."""
    x ^= x >> np.uint64(32)
    x *= _WORD_MIX
    x ^= x >> np.uint64(32)
    x *= _WORD_MIX
    x ^= x >> np.uint64(32)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        up = np.full(size, _BASE)
        down = np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


class Words:
    """The words of a slice of texts: hash, text, and byte range of each.

    ``first`` has, for each text, the index of its first word, and one more.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        low = LOWER[data]
        inside = ~separators[low]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        up, down = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[low] * up[: len(data)], dtype=np.uint64, out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and each text's first run (and one more).

        A text of fewer words has one shingle, its whole sequence; a text
        without words has none.
        """
        h, n = self.hash, np.diff(self.first)
        runs = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        at = np.concatenate([[0], np.cumsum(runs)])
        total = len(h)
        chain = np.zeros(max(0, total - k + 1), dtype=np.uint64)
        for j in range(k if total >= k else 0):
            chain = mix(chain * _BASE + h[j : total - k + 1 + j])
        index = np.repeat(self.first[:-1] - at[:-1], runs) + np.arange(at[-1])
        out = chain[np.minimum(index, max(0, len(chain) - 1))] if len(chain) else np.zeros(at[-1], dtype=np.uint64)
        for i in np.flatnonzero((n < k) & (n > 0)):
            value = np.array([n[i]], dtype=np.uint64)
            for x in h[self.first[i] : self.first[i + 1]]:
                value = mix(value * _BASE + x)
            out[at[i]] = value[0]
        return out, at


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of whole texts; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    _, where, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(where, dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
