"""Vectorised text primitives for code that runs inside Arrow batches.

Words, lines and byte windows are located and hashed with numpy over the raw UTF-8
buffer of a batch, so no Python object is made per word.  All functions are pure and
use fixed constants: a retried task gives the same bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20
#: Odd multiplier of the positional hash; odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed 64-bit seeds that depend on nothing but n and salt."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(salt))


_BYTE_VALUES = seeds(256, 77)
#: Longer words are hashed by xxh3: the positional hash is a polynomial modulo 2**64, for
#: which long texts can be made to collide; up to this length it is one of random byte values.
SHORT_WORD = 64
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers[which]
    if len(have) < n:
        size = 1 << int(n - 1).bit_length()
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = _powers[which] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``limit`` bytes; null is empty.

    A row is never split, so a row longer than the limit is a run of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, and where each row's words begin.

    A word is a maximal run of bytes other than space and 0x09 to 0x0D.  Row i has the
    words ``first[i]:first[i + 1]``.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    opens[inner] = inside[inner]
    closes[inner - 1] = inside[inner - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    data = _LOWER[data] if lower else data
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power("up", BASE, n), out=total[1:])
    value = (total[end] - total[begin]) * _power("down", BASE_INVERSE, n)[begin]
    hashes = mix(value + (end - begin).astype(np.uint64))
    view = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(end - begin > SHORT_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(view[begin[i] : end[i]])
    return hashes, np.searchsorted(begin, offsets)


def line_windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, digest as two longs) of each run of ``width`` lines that holds a word.

    Lines are what lies between newlines of one row.  Runs of equal lines are equal bytes,
    line ends included, so the digest is the 128-bit xxh3 of a window's bytes.
    """
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    begin, end = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([offsets[1:], breaks]))
    per_row = 1 + np.diff(np.searchsorted(breaks, offsets))
    owner = np.repeat(np.arange(len(per_row)), per_row)
    start = np.flatnonzero(owner[: len(owner) - width + 1] == owner[width - 1 :]) if len(owner) >= width else np.zeros(0, np.int64)
    words = np.zeros(n + 1, np.int64)
    np.cumsum(~_SPACE[data], out=words[1:])
    opens, closes = begin[start], end[start + width - 1]
    worded = words[closes] > words[opens]
    start, opens, closes = start[worded], opens[worded], closes[worded]
    first = np.cumsum(per_row) - per_row
    return owner[start], start - first[owner[start]], digests(data, opens, closes)


def digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 128-bit xxh3 digests of byte ranges, as rows of two longs."""
    view = memoryview(np.ascontiguousarray(data))
    made = [xxhash.xxh3_128_digest(view[b:e]) for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; empty when there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weights = seeds(width, 1234) | np.uint64(1)
    out = words[:n] * weights[0]
    for k in range(1, width):
        out += words[k : k + n] * weights[k]
    return mix(out)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the width-word windows; a shorter text is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, min(width, len(words))))
