"""Words, shingles and their hashes inside tasks.

A word is a run of anything but space and the control characters 9 to 13; A-Z count as a-z.
That is what ``bytes.split`` and ``bytes.lower`` do.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_STRETCH = 1 << 14  # bytes of text hashed at once
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b]).lower()) for b in range(256)], np.uint64)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words in order."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2^64."""
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def texts_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cuts): 64-bit hashes of the lower-cased words of a column of texts, none NULL, in order, and where each text's begin and end.

    All words are hashed at once: a word's hash is the sum of its bytes' hashes times the powers of an odd
    number, of which sums over whole stretches of text are differences. They differ from those of ``word_hashes``.
    """
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if ends[0] == ends[-1]:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    blank = _SPACE[data]
    bound = np.zeros(len(data) + 1, bool)
    bound[ends] = True
    starts = np.flatnonzero(~blank & (bound[:-1] | np.insert(blank[:-1], 0, True)))
    stops = np.flatnonzero(~blank & (bound[1:] | np.append(blank[1:], True))) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(stops, base + _STRETCH, "right")))
        up, down = _powers(max(_STRETCH, 1 << int(stops[to - 1] - base).bit_length()))
        own = data[base : stops[to - 1]]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[own] * up[: len(own)])])
        out[at:to] = (sums[stops[at:to] - base] - sums[starts[at:to] - base]) * down[starts[at:to] - base]
        at = to
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ (out >> np.uint64(29)), np.searchsorted(starts, ends)


def window_hashes(hashes: np.ndarray, words: int) -> np.ndarray:
    """64-bit hashes of all runs of ``words`` words; of the whole if it is shorter, none if empty."""
    n = len(hashes)
    words = min(words, n)
    if not n:
        return hashes
    out = hashes[: n - words + 1].copy()
    for j in range(1, words):
        out ^= out >> np.uint64(29)
        out *= _MIX
        out += hashes[j : n - words + 1 + j]
    return out ^ (out >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingles of a text, as 64-bit hashes."""
    return np.unique(window_hashes(word_hashes(text), words))
