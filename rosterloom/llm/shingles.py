"""Hashed word shingles of many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rosterloom.llm import units as U

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = [np.uint64(pow(0xD1342543DE82EF95, k, 1 << 64)) for k in range(64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every lower-cased word of all texts, and the number of words of each."""
    data, offsets = U.flat(pc.utf8_lower(texts.cast(pa.large_string())))
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begins[firsts] = inside[firsts]
    at = np.flatnonzero(begins)
    per_text = np.diff(np.searchsorted(at, offsets))
    place = np.cumsum(inside)  # the bytes of words alone, one word right after another
    starts = place[at] - 1
    data = data[inside]
    ends = np.append(starts[1:], len(data))
    out = [np.zeros(0, np.uint64)]
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), U.WINDOW)), len(starts)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        base = starts[a]
        h, v = U._hashes(data[base:ends[b - 1]], starts[a:b] - base, ends[a:b] - base)
        out.append(_mixed(h + (v << np.uint64(1))))
    return np.concatenate(out), per_text


def shingles(texts: pa.Array, words: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct shingles, as sorted hashes, and how often each occurs.

    A text with fewer words has one shingle, of all of them; one without words has none.
    """
    h, per_text = word_hashes(texts)
    n = len(h) - words + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(words if n > 0 else 0):
        rolled += h[k:k + n] * _ODD[k]
    rolled = _mixed(rolled)
    out, end = [], 0
    for count in per_text.tolist():
        start, end = end, end + count
        if count >= words:
            out.append(np.unique(rolled[start:end - words + 1], return_counts=True))
        elif count:
            whole = (h[start:end] * np.array(_ODD[:count], np.uint64)).sum(keepdims=True) + np.uint64(count)
            out.append((_mixed(whole), np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out
