"""Distinct word shingles of many texts as sorted 64-bit hashes, computed over whole Arrow buffers with numpy."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from patronage.llm.common import text_column

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lowered and cut at ASCII white space, and the n + 1 offsets between texts.

    A word's hash is a polynomial of its bytes, taken from running sums over the whole buffer.
    """
    data, at = text_column(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = np.empty(len(data) + 1, bool)
    inside[:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    inside[-1] = False
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cuts = at[1:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = inside[cuts]
    stops = inside[:-1] & ~inside[1:]
    inner = at[1:-1]
    inner = inner[inner > 0] - 1
    stops[inner] = inside[inner]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    size = 1 << int(len(data)).bit_length()
    lowered = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((lowered.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size)[: len(data)], out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * _powers(_INVERSE, size)[first])
    return hashes, np.searchsorted(first, at)


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles and the n + 1 offsets between texts.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    hashes, at = word_hashes(texts)
    counts = np.diff(at)
    total = len(hashes)
    text = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(at[1:], counts) - np.arange(total)  # words from here to the text's end
    starts = (left >= words) | ((np.arange(total) == np.repeat(at[:-1], counts)) & (left < words))
    length = np.minimum(left, words)
    rolled = length.astype(np.uint64)
    padded = np.concatenate((hashes, np.zeros(words, np.uint64)))
    for k in range(words):
        within = k < length
        rolled = np.where(within, mix(rolled * np.uint64(0xD6E8FEB86659FD93) + padded[k : k + total]), rolled)
    values, owner = rolled[starts], text[starts]
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]
