"""Hashed words and word shingles of Arrow text columns, in numpy.

Equality of words and shingles is equality of 64-bit hashes: a chance collision
within two documents of 10,000 shingles has a probability below 1e-11.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes handled at once; longer texts are cut at white space.
SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15
#: Odd multipliers for the places in a shingle.
PLACES = [U(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) | 1) for k in range(64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the final step of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95))
CACHE: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for slices of the usual size."""
    if len(CACHE.get("up", ())) <= n:
        CACHE["up"] = powers(BASE, max(n, SLICE))
        CACHE["down"] = powers(pow(BASE, -1, 1 << 64), max(n, SLICE))
    return CACHE["up"], CACHE["down"]


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def hashed_slice(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of lower-cased bytes and where the words start; words also end at ``breaks``."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = ~space(data)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    breaks = breaks[(breaks > 0) & (breaks < len(data))]
    begins[breaks] = letter[breaks]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:]
    ends[breaks - 1] = letter[breaks - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start]), start


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the offsets of its rows; null rows are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(buffers[2]) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut(data: np.ndarray) -> Iterator[np.ndarray]:
    """One long text in slices that end at white space."""
    at = 0
    while len(data) - at > SLICE:
        window = SLICE
        while True:
            gaps = np.flatnonzero(space(data[at + window // 2 : at + window]))
            if len(gaps) or at + window >= len(data):
                break
            window *= 2
        end = at + window // 2 + int(gaps[-1]) + 1 if len(gaps) else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word offsets of the rows) of consecutive rows, about ``SLICE`` bytes each."""
    data, offsets = text_bytes(texts)
    row, rows = 0, len(texts)
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1
        last = min(max(last, row + 1), rows)
        part = data[offsets[row] : offsets[last]]
        if len(part) > SLICE:
            hashes = np.concatenate([hashed_slice(lowered(p), np.zeros(0, np.int64))[0] for p in cut(part)])
            yield row, hashes, np.array([0, len(hashes)])
        else:
            inner = offsets[row : last + 1] - offsets[row]
            hashes, starts = hashed_slice(lowered(part), inner)
            yield row, hashes, np.searchsorted(starts, inner)
        row = last


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words."""
    n = len(words) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        total += words[k : k + n] * PLACES[k]
    return mix(total)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every row; a shorter text is one shingle, no words give none."""
    for _, words, offsets in hashed_words(texts):
        every = shingle_hashes(words, size)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b - a >= size:
                yield np.unique(every[a : b - size + 1])
            elif b > a:
                whole = words[a:b] * np.array(PLACES[: b - a])
                yield mix(np.array([whole.sum(dtype=np.uint64) + U(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
