"""Cuts texts into units that a tokenizer treats independently, and remembers units it has seen.

A unit is a stretch of text between safe cuts: byte pairs across which no piece can reach.
What a tokenizer says of a unit is then the same alone and within its text, and has to be
asked once per distinct unit. All of it works on Arrow's flat buffers with numpy, many texts at
a time. Units are known by two 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20
LONG = 256
_SPACES = np.zeros(256, bool)
_SPACES[[*range(0x21), 0x7F]] = True
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 … base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), 1 << 64))
        out = np.concatenate([out, out * step])
    return out[:n].copy()


_random = np.random.default_rng(20240)
_T1, _T2 = (_random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_UP = _powers(_BASE, WINDOW + 2 * LONG + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), WINDOW + 2 * LONG + 1)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (and the last ends). Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def parts(batch: pa.RecordBatch, column: str, size: int = 4 * WINDOW) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `size` bytes of text, at least a row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    slot = (np.cumsum(sizes) - sizes) // size
    cuts = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), batch.num_rows)
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def safe_pairs(specials: tuple[str, ...] = ()) -> np.ndarray:
    """For pre-tokenizers that part letters, digits, marks and white space: the byte pairs
    between which they always part. A space belongs to what follows; an apostrophe may."""
    kind = np.zeros(128, np.uint8)
    for i in range(0x21, 0x7F):
        kind[i] = 1 if chr(i).isalpha() else 2 if chr(i).isdigit() else 3
    safe = np.zeros((256, 256), bool)
    a, b = kind[:, None], kind[None, :]
    safe[:128, :128] = (a > 0) & (b > 0) & (a != b)
    safe[ord("'"), :] = False
    for text in specials:
        raw = text.encode()
        for x, y in zip(raw, raw[1:]):
            safe[x, y] = False
    # Before white space, after anything but white space; see unspaced().
    safe[0x21:0x7F, 0x20] = safe[0x21:0x7F, 0x0A] = True
    safe[0x80:, 0x20] = safe[0x80:, 0x0A] = True
    return safe


def after_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the cuts follow a white-space character of several bytes, or may."""
    one = data[at - 1]
    far = np.flatnonzero(one >= 0x80)
    i = at[far]
    a, b, c = data[i - 1], data[np.maximum(i - 2, 0)], data[np.maximum(i - 3, 0)]
    out = np.zeros(len(at), bool)
    out[far] = (((b == 0xC2) & ((a == 0x85) | (a == 0xA0))) | ((c == 0xE1) & (b == 0x9A)) |
                ((c == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((c == 0xE3) & (b == 0x80)))
    return out


@dataclass
class Window:
    """Some units in the order of the text: their bytes, hashes and documents."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    h: np.ndarray
    v: np.ndarray

    def raw(self, unit: int) -> bytes:
        return self.data[self.start[unit]:self.end[unit]].tobytes()


def windows(texts: pa.Array, safe: np.ndarray,
            unspaced: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = after_space,
            size: int = WINDOW) -> Iterator[Window]:
    """All units of the texts, about `size` bytes at a time."""
    data, offsets = flat(texts)
    if not len(data):
        return
    pair = data[:-1].astype(np.uint16) << 8
    pair |= data[1:]
    cut = safe.ravel()[pair]
    at = np.flatnonzero(cut) + 1
    if unspaced is not None and len(at):
        at = at[~unspaced(data, at)]
    mark = np.zeros(len(data) + 1, bool)
    mark[at] = True
    mark[offsets] = True
    starts = np.flatnonzero(mark)
    starts, ends = starts[:-1], starts[1:]
    per_doc = np.diff(np.searchsorted(starts, offsets))
    docs = np.repeat(np.arange(len(offsets) - 1), per_doc)
    edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), size)), len(starts)))
    for a, b in zip(edges[:-1], edges[1:]):
        base = starts[a]
        part = data[base:ends[b - 1]]
        s, e = starts[a:b] - base, ends[a:b] - base
        h, v = _hashes(part, s, e)
        yield Window(part, s, e, docs[a:b], h, v)


def _hashes(data, start, end):
    """Two hashes of each unit, from running sums of byte values times powers."""
    long = (end - start) > LONG
    s, e, some = start, end, data
    if long.any():
        some = data[~np.repeat(long, end - start)]
        e = np.cumsum(np.where(long, 0, end - start))
        s = e - np.where(long, 0, end - start)
    out = []
    for values in (_T1, _T2):
        terms = values[some]
        terms *= _UP[:len(some)]
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        out.append((sums[e] - sums[s]) * _DOWN[s])
    h, v = out
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(long):
        digest = hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=16).digest()
        h[i], v[i] = np.frombuffer(digest, np.uint64)
    return h, v


class Known:
    """A hash table of units in numpy arrays. Full, it starts anew: memory is bounded, and a
    forgotten unit is only asked for again."""

    def __init__(self, bits: int = 21):
        self.bits, self.most = bits, 1 << (bits - 1)
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.h = np.zeros(self.most, np.uint64)
        self.v = np.zeros(self.most, np.uint64)
        self.n = 0

    def find(self, h: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The entry of each unit, -1 if it has none."""
        mask = (1 << self.bits) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        out = self.slots[slot]
        wrong = np.flatnonzero((out >= 0) & ((self.h[out] != h) | (self.v[out] != v)))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & mask
            found = self.slots[slot[wrong]]
            out[wrong] = found
            bad = (found >= 0) & ((self.h[found] != h[wrong]) | (self.v[found] != v[wrong]))
            wrong = wrong[bad]
        return out

    def _place(self, entries: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (self.h[entries] & np.uint64(mask)).astype(np.int64)
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            left = self.slots[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & mask

    def add(self, h: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each unit; and for each new entry, in order, a unit that it is of."""
        at = self.find(h, v)
        firsts = []
        while len(new := np.flatnonzero(at < 0)):
            _, first = np.unique(h[new], return_index=True)
            first = new[first]
            need = self.n + len(first)
            if need > len(self.h):  # one window with more than fits: grow
                room = np.zeros(max(need, 2 * len(self.h)) - len(self.h), np.uint64)
                self.h, self.v = np.concatenate([self.h, room]), np.concatenate([self.v, room])
            if need * 2 > len(self.slots):
                while need * 2 > 1 << self.bits:
                    self.bits += 1
                self.slots = np.full(1 << self.bits, -1, np.int32)
                self._place(np.arange(self.n, dtype=np.int32))
            entries = np.arange(self.n, need, dtype=np.int32)
            self.h[entries], self.v[entries] = h[first], v[first]
            self.n = need
            self._place(entries)
            firsts.append(first)
            at[new] = self.find(h[new], v[new])
        return at, np.concatenate(firsts) if firsts else np.zeros(0, np.int64)


class Pool:
    """Rows of numbers of any length, one per entry, in one growing array."""

    def __init__(self, kind):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.values, self.used = np.zeros(1 << 16, self.kind), 0
        self.at, self.size, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values = _room(self.values, self.used + len(values))
        self.at, self.size = _room(self.at, self.n + len(sizes)), _room(self.size, self.n + len(sizes))
        self.values[self.used:self.used + len(values)] = values
        self.size[self.n:self.n + len(sizes)] = sizes
        self.at[self.n:self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(values)
        self.n += len(sizes)

    def rows(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of these entries, one after another, and the size of each."""
        sizes = self.size[entries]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.at[entries] - (ends - sizes), sizes)
        return self.values[shift + np.arange(len(shift))], sizes


def _room(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    out = np.zeros(max(n, 2 * len(array)), array.dtype)
    out[:len(array)] = array
    return out


def hashes_of(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of units given as bytes."""
    hs, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    step = WINDOW // LONG
    for i in range(0, len(units), step):
        part = units[i:i + step]
        sizes = np.array([len(u) for u in part], np.int64)
        ends = np.cumsum(sizes)
        h, v = _hashes(np.frombuffer(b"".join(part), np.uint8), ends - sizes, ends)
        hs.append(h)
        vs.append(v)
    return np.concatenate(hs), np.concatenate(vs)
