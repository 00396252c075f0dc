"""Word shingles of whole texts as sets of 64-bit hashes, computed for many texts at once.

A word is a run of other bytes than \\x09-\\x0D and \\x20, A-Z lower-cased.  A text's set holds its distinct
shingles of ``width`` words; a text of fewer words has all of them as one shingle; a text without
words has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Bytes of text that are hashed together.
TOGETHER = 1 << 18

_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_random = np.random.Generator(np.random.PCG64(20240101))
_PLACE = 64
_BYTES = _random.integers(0, 2**64, 256 * _PLACE, dtype=np.uint64)  # one number per byte and place in its word
_WORDS = _random.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word."""
    data = np.frombuffer(raw.lower(), np.uint8)
    solid = ~_BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    offsets = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(offsets, lengths)
    values = _BYTES[(data[solid].astype(np.int64) * _PLACE) | (place % _PLACE)]
    if lengths.max() > _PLACE:
        values = values * (2 * (place // _PLACE) + 1).astype(np.uint64)
    return starts, mix(np.add.reduceat(values, offsets) ^ lengths.astype(np.uint64) * _WORDS[15])


def _sets_together(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    starts, words = word_hashes(b" ".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(starts, ends)
    full = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for j in range(width):
        full += words[j : j + len(full)] * _WORDS[j]
    full = mix(full)
    first = 0
    for end in last.tolist():
        if end - first >= width:
            yield np.unique(full[first : end - width + 1])
        elif end > first:
            few = words[first:end] * _WORDS[: end - first]
            yield mix(few.sum(keepdims=True) + _WORDS[8:9] * np.uint64(len(few)))
        else:
            yield np.zeros(0, np.uint64)
        first = end


def shingle_sets(texts: Iterator[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text, in order."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield from _sets_together(held, width)
            held, size = [], 0
    if held:
        yield from _sets_together(held, width)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
