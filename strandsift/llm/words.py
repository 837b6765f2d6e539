"""Vectorised word scanning of Arrow text columns.

A word is a maximal run of bytes other than space and ``\\x09``-``\\x0D``; that equals ``[^\\x20\\x09-\\x0D]+``
on code points, because every byte of a multi-byte UTF-8 character is at least 0x80.  Word hashes are 64-bit
polynomial hashes over random byte values.  Everything works on byte segments of half a megabyte, so memory
follows the number of words of one slice, not the size of the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = b" \t\n\v\f\r"
SEGMENT = 1 << 19
SLICE = 2 << 20
ROWS = 8192

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE)] = True
_rng = np.random.default_rng(74093)
EXACT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = EXACT.copy()
FOLDED[65:91] = EXACT[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: White space and ASCII punctuation.
LOOSE = _SPACE.copy()
LOOSE[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
#: Odd factors for the positions inside a shingle or n-gram.
FACTORS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.multiply.accumulate(np.full(1024, _BASE))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.full(1 << int(n - 1).bit_length(), _BASE))
    return _powers


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string column; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut record batches, without copying, into pieces with about ``size`` bytes of text (a longer text stands alone)
    and at most ROWS rows."""
    for batch in batches:
        off, _ = buffers(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = min(lo + ROWS, max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1))
            yield batch.slice(lo, hi - lo)
            lo = hi


@dataclass
class Words:
    """Words of consecutive documents: document d has the words ``first[d]`` to ``first[d + 1]``."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def _cut(data: np.ndarray, off: np.ndarray, at: int, end: int, space: np.ndarray) -> int:
    """The first place from ``at`` on where no word is cut."""
    limit = int(off[np.searchsorted(off, at)]) if at < end else end
    while at < limit:
        hit = np.flatnonzero(space[data[at : min(limit, at + 4096)]])
        if len(hit):
            return at + int(hit[0])
        at = min(limit, at + 4096)
    return limit


def scan(col: pa.Array, table: np.ndarray = EXACT, space: np.ndarray = _SPACE) -> Words:
    """All words of a text column with their byte ranges and hashes; ``table`` FOLDED ignores the case of A-Z, and
    ``space`` tells which bytes separate words."""
    off, data = buffers(col)
    starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    at, stop = int(off[0]), int(off[-1])
    while at < stop:
        to = _cut(data, off, min(stop, at + SEGMENT), stop, space)
        part = data[at:to]
        solid = ~space[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[0] = edge[-1] = True
        inner = off[np.searchsorted(off, at, "right") : np.searchsorted(off, to, "left")]
        edge[inner - at] = True
        gap = ~solid
        begin = edge[:-1].copy()
        begin[1:] |= gap[:-1]
        close = edge[1:].copy()
        close[:-1] |= gap[1:]
        s = np.flatnonzero(solid & begin)
        e = np.flatnonzero(solid & close) + 1
        if len(s):
            n = e - s
            lead = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(lead, n)
            value = table[part[solid]] * powers(int(n.max()))[place]
            hashes.append(mix(np.add.reduceat(value, lead) + n.astype(np.uint64) * FACTORS[63]))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    start = np.concatenate(starts)
    return Words(np.searchsorted(start, off), start, np.concatenate(ends), np.concatenate(hashes), data, off)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that lie inside one document, and the index of each one's first word."""
    total = len(words.hash)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(total - n + 1, np.uint64)
    if n <= 8:
        for j in range(n):
            h += words.hash[j : total - n + 1 + j] * FACTORS[j]
    else:  # by doubling: a window is two shorter ones, which may overlap
        h, have = words.hash * FACTORS[0], 1
        while have < n:
            step = min(have, n - have)
            size = total - have - step + 1
            h = mix(h[:size] + np.uint64(step)) * FACTORS[1] + h[step : step + size] * FACTORS[2]
            have += step
    inside = np.zeros(total - n + 1, bool)
    where = np.arange(total - n + 1)
    last = np.repeat(words.first[1:], words.counts())[: total - n + 1]
    inside = where + n <= last
    return mix(h[inside] + np.uint64(n)), where[inside]


def whole(hashes: np.ndarray) -> np.uint64:
    """Hash of a word sequence of any length."""
    f = powers(len(hashes) + 1)[: len(hashes)]
    tail = np.array([len(hashes)], np.uint64) * FACTORS[62]
    return mix(np.sum(hashes * f, keepdims=True) + tail)[0]


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def binaries(parts: list[np.ndarray]) -> pa.Array:
    """A binary column of numpy arrays' bytes."""
    return pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from all values in a row and the size of each list."""
    off = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
