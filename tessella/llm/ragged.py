"""Ragged NumPy arrays: texts as flat code points, tokens as spans, spans as hashes.

Everything here works inside one Python task on bounded groups of rows.
"""

from __future__ import annotations

import ctypes
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_CHARS = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def groups(texts: list[str], limit: int = GROUP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows with about ``limit`` characters.

    A text is never cut: one longer than ``limit`` is a group of its own.
    """
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(text) + 8
    if start < len(texts):
        yield start, texts[start:]


def arrow_groups(texts: pa.Array, limit: int) -> Iterator[tuple[int, list[str]]]:
    """``groups`` of a column without NULLs; only one group's texts are unpacked at a time."""
    start = held = 0
    for i, size in enumerate(pc.utf8_length(texts).to_pylist()):
        if held and held + size > limit:
            yield start, texts.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += size + 8
    if start < len(texts):
        yield start, texts.slice(start).to_pylist()


def give_back() -> None:
    """Return what this worker has freed to the system, where its C library can; workers stay
    alive between tasks, and what one stage held would otherwise add to the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the n + 1 offsets of the texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return codes, offsets


def text_of(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


@lru_cache(maxsize=1)
def general_classes() -> np.ndarray:
    """Per code point: 1 letter, 2 number, 0 other."""
    first = {"L": 1, "N": 2}
    kinds = map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))
    return np.fromiter((first.get(k[0], 0) for k in kinds), np.uint8, sys.maxunicode + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = np.uint64(pow(self.base, len(self.values), 1 << 64))
            self.values = np.concatenate([self.values, self.values * step])
        return self.values


_UP, _DOWN = _Powers(_BASE), _Powers(_BASE_INVERSE)


class SpanHasher:
    """64-bit hashes of spans of one array, after one pass over it."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _UP.upto(n)[:n], out=self.prefix[1:])
        self.down = _DOWN.upto(n + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal spans have equal hashes wherever they stand."""
        raw = (self.prefix[ends] - self.prefix[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHasher(codes).hashes(starts, ends)


def runs(inside: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of ``inside``; ``new`` breaks runs before a position."""
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = ~inside[1:] | new[1:]
    if n:
        after[-1] = True
    return np.flatnonzero(inside & (~before | new)), np.flatnonzero(inside & after) + 1


def breaks(n: int, offsets: np.ndarray) -> np.ndarray:
    """True where a text starts."""
    new = np.zeros(n + 1, bool)
    new[offsets] = True
    return new[:n]


def gather(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' items one after the other, and the n + 1 offsets of the spans."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return codes[index], offsets


def sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of values per owner 0..n-1."""
    return np.bincount(owner, weights=values, minlength=n)[:n]


class HashIndex:
    """Places of sorted, evenly spread 64-bit keys: a table over their first bits, then a
    short walk."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.searchsorted(keys, edges).astype(np.int32)
        self.walk = int(np.diff(np.append(self.first, len(keys))).max()) if len(keys) else 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hit, place); the place of a miss is any valid one."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(self.first[(hashes >> self.shift).astype(np.int64)], len(self.keys) - 1)
        hit = self.keys[at] == hashes
        open_ = np.flatnonzero(~hit)
        for _ in range(self.walk):
            if not len(open_):
                break
            here = np.minimum(at[open_] + 1, len(self.keys) - 1)
            at[open_] = here
            found = self.keys[here] == hashes[open_]
            hit[open_[found]] = True
            open_ = open_[~found & (self.keys[here] < hashes[open_])]
        return hit, at


class SpanCache:
    """Values already computed for span hashes; emptied when it outgrows ``limit``."""

    def __init__(self, limit: int = 1_500_000):
        self.limit = limit
        self.keys = np.zeros(0, np.uint64)
        self.values: np.ndarray | None = None

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hit, place) for sorted distinct hashes."""
        place = np.searchsorted(self.keys, hashes)
        hit = np.zeros(len(hashes), bool)
        ok = place < len(self.keys)
        hit[ok] = self.keys[place[ok]] == hashes[ok]
        return hit, place

    def values_for(self, hashes: np.ndarray, compute) -> np.ndarray:
        """Value of each sorted distinct hash; ``compute(missing)`` gives those not held."""
        hit, place = self.find(hashes)
        fresh = compute(np.flatnonzero(~hit))
        out = np.zeros(len(hashes), fresh.dtype)
        if self.values is not None and hit.any():
            out[hit] = self.values[place[hit]]
        out[~hit] = fresh
        if not hit.all():
            if self.values is None or len(self.keys) + len(fresh) > self.limit:
                self.keys, self.values = hashes.copy(), out.copy()
            else:
                self.keys = np.insert(self.keys, place[~hit], hashes[~hit])
                self.values = np.insert(self.values, place[~hit], fresh)
        return out
