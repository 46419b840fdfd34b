"""Words of Arrow string arrays as 64-bit hashes, straight from the UTF-8 buffer.

A word is a maximal run of ASCII letters and digits and of characters beyond ASCII; a Chinese,
Japanese or Korean character (UTF-8 lead bytes E3 to ED) is a word of its own. ASCII and Latin-1
capitals are folded. Nothing is made per word in Python: a batch costs some numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_pow: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = 1 << max(20, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _pow[base] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string array; a null row is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), off


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, word offsets by row) of the rows whose bytes ``data[off[0]:off[-1]]`` are."""
    b = _LOWER[data[off[0] : off[-1]]]
    rows = off - off[0]
    n = len(b)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    hi = b >= 128
    if hi.any():
        fold = np.flatnonzero((b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97) & (b[:-1] == 0xC3)) + 1
        b[fold] += 32
    word = _IS_WORD[b]
    start = word.copy()
    start[1:] &= ~word[:-1]
    if hi.any():
        lead = (b >= 0xE3) & (b <= 0xED)
        if lead.any():
            start |= lead
            start[3:] |= lead[:-3] & word[3:]
    first = rows[:-1][rows[:-1] < n]
    start[first] = word[first]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    v = np.where(word, b, 0).astype(np.uint64)
    v *= _powers(_R, n)
    # a word that ends with its row: what follows up to the next start are zeros, as rows start anew
    h = np.add.reduceat(v, starts) * _powers(_R_INV, n)[starts]
    return mix64(h), np.searchsorted(starts, rows).astype(np.int64)
