"""Vectorised statistics of documents and lines over the bytes of an Arrow text column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import SPACE, Words, grams, mix

SYMBOLS = b"#*$%&|<>"


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


IS_SPACE = table(SPACE)
IS_SYMBOL = table(SYMBOLS)
IS_UPPER = table(bytes(range(65, 91)))
IS_LOWER = table(bytes(range(97, 123)))
IS_DIGIT = table(bytes(range(48, 58)))
IS_POINT = table(b"!\"'(),-./:;?@[\\]^_`{}~+=")
IS_SHOUT = table(b"!")
#: The first byte of each character that isn't white space.
IS_WORD_CHAR = 1 - np.maximum(IS_SPACE, table(bytes(range(0x80, 0xC0))))
IS_CHAR = 1 - table(bytes(range(0x80, 0xC0)))


def tally(data: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many bytes of each range are in the table ``of``."""
    out = np.zeros(len(offsets) - 1, np.int64)
    some = np.diff(offsets) > 0
    if some.any():
        part = of[data[offsets[0] : offsets[-1]]]
        out[some] = np.add.reduceat(part, offsets[:-1][some] - offsets[0], dtype=np.int64)
    return out


def repeated_words(words: Words, n: int = 3) -> np.ndarray:
    """Which words lie in an n-word window that the document has twice or more (the first one included)."""
    h, at = grams(words, n)
    cover = np.zeros(len(words.hash) + 1, np.int32)
    if len(h):
        key = mix(h + words.documents()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover[at[twice]] += 1
        np.subtract.at(cover, at[twice] + n, 1)
    return np.cumsum(cover)[:-1] > 0


def duplicate_lines(words: Words) -> np.ndarray:
    """Of each document, the lines with a word that equal an earlier line."""
    out = np.zeros(len(words.first) - 1, np.int64)
    for d, (a, z) in enumerate(zip(words.offsets[:-1], words.offsets[1:], strict=True)):
        lines = [x for x in words.data[a:z].tobytes().split(b"\n") if x and not x.isspace()]
        out[d] = len(lines) - len(set(lines))
    return out


def distinct_words(words: Words) -> np.ndarray:
    doc = words.documents()
    order = np.lexsort((words.hash, doc))
    fresh = np.r_[True, (words.hash[order][1:] != words.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])][: len(doc)]
    return np.bincount(doc[order][fresh], minlength=len(words.first) - 1)


def lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all lines (the newline belongs to the line before it), and each document's first line.

    An empty document has no line.
    """
    lo, hi = words.offsets[0], words.offsets[-1]
    ends = np.flatnonzero(words.data[lo:hi] == 10) + lo + 1
    edges = np.unique(np.concatenate((ends, words.offsets)))
    edges = edges[(edges >= lo) & (edges <= hi)]
    return edges, np.searchsorted(edges[:-1], words.offsets)


def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def arrow(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], list(columns))
