"""Words as 64-bit fingerprints, taken from Arrow text columns without making Python strings.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so UTF-8 is never cut.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PLAIN = np.arange(256, dtype=np.uint8)
LOWER = PLAIN.copy()
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
OTHER = 0xC2B2AE3D27D4EB4F  # of fingerprints that do not depend on the first ones
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


@cache
def _byte_values(base: int = BASE) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(base - BASE & 0xFFFFFFFFFFFFFFFF))


@cache
def _powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    first: np.ndarray  # words of text i are first[i]:first[i + 1]
    starts: np.ndarray  # byte ranges of the words
    ends: np.ndarray
    hashes: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words_of(column: pa.Array, fold: bool = False) -> Words:
    """The words of every text. fold: A-Z count as a-z."""
    data, at = text_bytes(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, np.zeros(len(at), np.int64), none, none, np.zeros(0, np.uint64))
    space = SPACE[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    before[at[:-1][at[:-1] < len(data)]] = True
    after[at[1:][at[1:] > 0] - 1] = True
    np.logical_not(space, out=space)
    starts, ends = np.flatnonzero(space & before), np.flatnonzero(space & after) + 1
    return Words(data, np.searchsorted(starts, at), starts, ends, _hashes(data, starts, ends, LOWER if fold else PLAIN))


def other_hashes(words: Words) -> np.ndarray:
    """A second fingerprint of every word as it stands."""
    return _hashes(words.data, words.starts, words.ends, PLAIN, OTHER)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, change: np.ndarray, base: int = BASE) -> np.ndarray:
    """Polynomial fingerprints from prefix sums, some thousand words at a time."""
    values = _byte_values(base)[change]
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        n = CHUNK if hi - lo <= CHUNK else hi - lo
        up, down = _powers(CHUNK, base) if n == CHUNK else _powers.__wrapped__(n, base)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(values[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return mix(out)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The fingerprint of every k consecutive words, text bounds not regarded."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(BASE)
        out += hashes[j : j + n]
    return mix(out)


def inside(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the n - k + 1 grams lie in one text."""
    ok = np.ones(max(0, n - k + 1), dtype=bool)
    for j in range(1, k):
        cut = first[1:-1] - j
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok
