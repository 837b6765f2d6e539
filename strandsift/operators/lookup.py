"""Patterns looked up inside Arrow batches of texts: the small helper of :mod:`strandsift.operators.text`.

Texts and patterns are compared as UTF-8, where a pattern can only begin at a character.  A pattern is known by its first 1,
2, 4, 8 or 16 bytes, the most that it has; numbers of so many bytes at every place of a text are held against a table of bits
and then against the patterns' own, and what is left is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZES = (1, 2, 4, 8, 16)
#: Bytes of texts that are looked through at once, and candidates that are compared at once.
SEGMENT, MOST = 1 << 20, 1 << 20
SPREAD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC4CEB9FE1A85EC53)


def _loads(data: np.ndarray, unit: int) -> np.ndarray:
    """The numbers of ``unit`` bytes at every place; ``data`` has 16 bytes more than are looked at."""
    return np.ndarray((len(data) - 15,), f"<u{unit}", data, strides=(1,))


def _grams(data: np.ndarray, size: int, lo: int, hi: int) -> np.ndarray:
    here = _loads(data, min(size, 8))
    if size < 16:
        return here[lo:hi].astype(np.uint64)
    wide = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return wide[lo:hi] * MIX ^ wide[lo + 8 : hi + 8]


def _bits(gram: np.ndarray, n: int) -> np.ndarray:
    return ((gram * SPREAD) >> np.uint64(64 - n)).astype(np.int64)


def table(patterns: list[bytes]) -> dict:
    """What :func:`hits` looks patterns up by; they are known by their places in the list, and none is empty."""
    size = np.array([len(p) for p in patterns], np.int64)
    start = np.append(0, np.cumsum(size))
    data = np.frombuffer(b"".join(patterns) + bytes(24), np.uint8)
    classes = []
    for i, s in enumerate(SIZES):
        own = np.flatnonzero((size >= s) & (size < SIZES[i + 1] if i + 1 < len(SIZES) else size >= s))
        if not len(own):
            continue
        gram = np.concatenate([_grams(data, s, int(start[p]), int(start[p]) + 1) for p in own])
        order = np.argsort(gram, kind="stable")
        known, first, times = np.unique(gram[order], return_index=True, return_counts=True)
        n = min(22, max(10, int(16 * len(known)).bit_length()))
        seen = np.zeros(1 << n, bool)
        seen[_bits(known, n)] = True
        classes.append((s, n, seen, known, first, times, own[order]))
    return {"data": data, "start": start[:-1], "size": size, "classes": classes}


def _slices(times: np.ndarray) -> Iterator[slice]:
    """Slices of rows with about MOST repetitions each."""
    sums = np.cumsum(times)
    lo = 0
    while lo < len(times):
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + MOST, "right")))
        yield slice(lo, hi)
        lo = hi


def _matches(known: dict, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pattern, row, byte) of all occurrences in ``data``, whose rows begin at ``off``."""
    for lo in range(0, int(off[-1]), SEGMENT):
        hi = min(lo + SEGMENT, int(off[-1]))
        for s, n, seen, grams, first, times, order in known["classes"]:
            here = _grams(data, s, lo, hi)
            at = np.flatnonzero(seen[_bits(here, n)])
            here = here[at]
            i = np.minimum(np.searchsorted(grams, here), len(grams) - 1)
            same = grams[i] == here
            at, i = at[same] + lo, i[same]
            unit = min(s, 8)
            text, own = _loads(data, unit), _loads(known["data"], unit)
            for part in _slices(times[i]):
                many = times[i[part]]
                inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                which, place = order[np.repeat(first[i[part]], many) + inside], np.repeat(at[part], many)
                row = np.searchsorted(off, place, "right") - 1
                fits = place + known["size"][which] <= off[row + 1]
                which, place, row = which[fits], place[fits], row[fits]
                step, open_ = 0 if s == 16 else s, np.ones(len(which), bool)
                while True:
                    left = np.flatnonzero(open_ & (known["size"][which] > step))
                    if not len(left):
                        break
                    w = which[left]
                    shift = np.minimum(step, known["size"][w] - unit)
                    open_[left] = text[place[left] + shift] == own[known["start"][w] + shift]
                    step += unit
                if open_.any():
                    yield which[open_], row[open_], place[open_]


def hits(known: dict, col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows of a column of texts: the first row, the number of rows, and (pattern, row, pos) of all occurrences in
    them; rows count from the first one, positions are code points."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col) or col.buffers()[2] is None:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    whole = np.frombuffer(col.buffers()[2], np.uint8)
    row = 0
    while row < len(col):
        to = max(row + 1, int(np.searchsorted(off, off[row] + SEGMENT, "right")) - 1)
        begins = off[row : to + 1] - off[row]
        data = np.concatenate([whole[off[row] : off[to]], np.zeros(24, np.uint8)])
        found = list(_matches(known, data, begins))
        if found:
            which, at, place = (np.concatenate(x) for x in zip(*found, strict=True))
            before = begins[at]
            if (data >= 128).any():
                chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                place, before = chars[place], chars[before]
            yield row, to - row, which, at, place - before
        row = to


def merged(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last): the ranges of each row, where they overlap or touch merged."""
    order = np.lexsort((first, row))
    row, first, last = row[order], first[order], last[order]
    wide = int(last.max(initial=0)) + 2
    reach = np.maximum.accumulate(row * wide + last)  # a row's ends are all beyond those of the row before
    new = np.ones(len(row), bool)
    new[1:] = row[1:] * wide + first[1:] > reach[:-1] + 1
    new[1:] |= row[1:] != row[:-1]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(row)) - 1
    return row[begin], first[begin], (reach[end] - row[end] * wide) if len(begin) else last[:0]
