"""Words of many texts at once, as hashes, by array operations on an Arrow column's bytes.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A word's hash is a polynomial of its bytes
modulo 2^64, found from running sums of the bytes, and then mixed; no Python runs per word. The
bytes are taken in chunks that end between words, so the arrays stay small however long a text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes taken at once; a longer word makes a longer chunk.
CHUNK = 1 << 18
_powers: dict[int, np.ndarray] = {}


def _table(lower: bool) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    return out


def _inside(plain: bool) -> np.ndarray:
    """Which bytes are of words."""
    b = np.arange(256)
    if not plain:
        return ~((b == 32) | ((b >= 9) & (b <= 13)))
    return ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; those of a usual chunk are kept."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, CHUNK + (CHUNK >> 3))
        got = np.full(size, base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size <= 2 * CHUNK:
            _powers[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _end(raw: np.ndarray, at: int, of_words: np.ndarray) -> int:
    """The first place from ``at`` on that is no byte of a word, or the end."""
    step = 1 << 12
    while at < len(raw):
        out = np.flatnonzero(~of_words[raw[at : at + step]])
        if len(out):
            return at + int(out[0])
        at += step
    return len(raw)


def _chunk(raw: np.ndarray, edges: np.ndarray, of_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every word of ``raw``; words end at ``edges`` too."""
    inside = of_words[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    value = _table(True)[raw].astype(np.uint64)
    value += np.uint64(1)
    value *= _power(_BASE, len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return a, mix((total[b] - total[a]) * _power(_INVERSE, len(raw))[a])


def words(column: pa.Array, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each row); a null text has none.

    ``column``: one Arrow string array. ``plain``: lower-case all letters, and let ASCII punctuation
    separate words too.
    """
    column = column.cast(pa.large_string()).fill_null("")
    if plain:
        column = pc.utf8_lower(column)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    if last == first:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8, last - first, first)
    offsets, of_words = offsets - first, _inside(plain)
    out, before, at = [], np.zeros(n + 1, np.int64), 0
    while at < len(raw):
        to = _end(raw, min(at + CHUNK, len(raw)), of_words)
        # the rows that begin inside the chunk
        edges = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, to, "left")]
        starts, h = _chunk(raw[at:to], np.unique(edges) - at, of_words)
        out.append(h)
        before += np.searchsorted(starts + at, offsets)
        at = to
    return np.concatenate(out), np.diff(before)
