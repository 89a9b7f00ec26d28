"""Sets of word shingles as 64-bit hashes, for whole Arrow columns at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A-Z count as a-z.
_BYTE[65:91] = _BYTE[97:123]
_WORD_OF_SHINGLE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        size = 1 << max(1, n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.multiply.accumulate(step)
    return _POWERS[0], _POWERS[1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes together; a longer text is a run of its own."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the texts in words).  Words are runs of other than ASCII white space; no word crosses texts."""
    space = (data == 32) | (data >= 9) & (data <= 13)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~space
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:len(data)], dtype=np.uint64)])
    h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, size: int = 5, step: int = 1 << 18) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word shingles, or of its whole word sequence where it has fewer words."""
    data, offsets = text_bytes(texts)
    weight = _WORD_OF_SHINGLE[:size]
    for a, b in slices(offsets, step):
        h, at = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        full = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            full += h[k:k + len(full)] * weight[k]
        full = mix(full)
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if y - x >= size:
                yield np.unique(full[x:y - size + 1])
            elif y > x:
                yield mix((h[x:y] * weight[:y - x]).sum(dtype=np.uint64, keepdims=True) + np.uint64(y - x))
            else:
                yield np.zeros(0, np.uint64)
