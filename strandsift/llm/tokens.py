"""Token counts with a map-side two-tier lookup.

A text is cut at spaces and control white space into pre-tokens, across which no piece of the vocabulary reaches
(checked when the model is loaded), so their token counts add up.  Tier one is a broadcast table of the hashes and
counts of frequent pre-tokens, from a bounded sample; tier two is a cache in each worker, filled by encoding.
No pre-token is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample
from .textstats import arrow
from .words import EXACT, Words, buffers, mix, scan, signed, slices

FREQUENT = 1 << 16
SAMPLE = 4000
CACHE = 1 << 20
_MARK = "▁"
_MARK_BYTES = _MARK.encode()
_JOINED = np.uint64(0xD6E8FEB86659FD93)


class Counter:
    """Counts tokens of whole texts with a sentencepiece model, by pre-tokens."""

    def __init__(self, model: bytes, hashes: np.ndarray | None = None, counts: np.ndarray | None = None):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.hashes = np.zeros(0, np.uint64) if hashes is None else hashes
        self.counts = np.zeros(0, np.int64) if counts is None else counts
        self.cache: dict[bytes, int] = {}
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        #: Control white space that no piece holds together with other characters; the rest counts as letters.
        self.control = np.zeros(256, bool)
        for c in "\t\v\f\r\n":
            self.control[ord(c)] = not any(c in p and len(p) > 1 for p in pieces) and self._encode([f"a{c}b"])[0] == self._encode(["a"])[0] + 2
        self.space = self.control.copy()
        self.space[32] = True
        #: A model whose pieces reach over spaces, or that changes white space, is used on whole texts.
        spans = any(_MARK in p.lstrip(_MARK) for p in pieces) or not self.control[10]
        self.whole = spans or self._encode(["a b", "a  b"]) != [2, 3] or self._encode(["a b"])[0] != 2 * self._encode(["a"])[0]
        self.prefix = self._encode(["\n"])[0]
        #: Tokens of one space that stands before control white space.
        self.alone = self._encode(["a \n"])[0] - self._encode(["a\n"])[0]

    def _encode(self, texts: list) -> list[int]:
        return [len(x) for x in self.sp.encode(texts, num_threads=1)] if texts else []

    def _lookup(self, keys: list[bytes]) -> np.ndarray:
        """Counts of pre-tokens through the worker's cache.  A key that begins with a newline has no space before it."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        missing = [k for k in dict.fromkeys(keys) if k not in self.cache]
        for k, n in zip(missing, self._encode([k.decode() for k in missing]), strict=True):
            self.cache[k] = n - self.prefix if k[:1] == b"\n" else n
        return np.array([self.cache[k] for k in keys], np.int64)

    def of_words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the ordinary pre-tokens (one word, with one space or none before it), 0 for other words; token counts."""
        data, start = words.data, words.start
        doc = words.documents()
        begin = words.offsets[doc]
        one = (start > begin) & (data[np.maximum(start - 1, 0)] == 32)
        two = one & (start - 1 > begin) & (data[np.maximum(start - 2, 0)] == 32)
        lead = start == begin
        odd = two | (one & (start - 1 == begin))
        key = np.where(one | lead, words.hash, mix(words.hash ^ _JOINED))
        codes, unique = pd.factorize(key)
        first = np.zeros(len(unique), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        n = np.zeros(len(unique), np.int64)
        if len(self.hashes):
            i = np.minimum(np.searchsorted(self.hashes, unique), len(self.hashes) - 1)
            n = np.where(self.hashes[i] == unique, self.counts[i], 0)
        rest = np.flatnonzero(n == 0)
        w = first[rest]
        raw = [data[a:z].tobytes() for a, z in zip(start[w], words.end[w], strict=True)]
        n[rest] = self._lookup([x if spaced else b"\n" + x for x, spaced in zip(raw, (one | lead)[w], strict=True)])
        each = n[codes]
        for k in np.flatnonzero(odd):
            a = int(start[k])
            while a > begin[k] and data[a - 1] == 32:
                a -= 1
            # the model puts one more space before a text
            spaces = int(start[k]) - a - (a > begin[k])
            each[k] = self._lookup([b" " * spaces + data[start[k] : words.end[k]].tobytes()])[0]
        return np.where(odd, np.uint64(0), key), each

    def count(self, col: pa.Array) -> np.ndarray:
        """Token counts of a text column."""
        if self.whole:
            return np.array(self._encode([x or "" for x in col.to_pylist()]), np.int64)
        words = scan(col, EXACT, self.space)
        out = np.zeros(len(col), np.int64)
        if len(words.hash):
            each = self.of_words(words)[1]
            total = np.r_[0, np.cumsum(each)]
            out = total[words.first[1:]] - total[words.first[:-1]]
        off, data = words.offsets, words.data
        lo, hi = int(off[0]), int(off[-1])
        part = data[lo:hi]
        control = self.control[part]
        total = np.r_[0, np.cumsum(control)]
        out = out + total[off[1:] - lo] - total[off[:-1] - lo]
        # runs of spaces that no word follows, and texts that begin with control white space
        after = np.full(len(part) + 1, True)
        after[:-1] = control
        after[off[1:] - lo] = True
        for i in np.flatnonzero((part == 32) & after[1:]):
            d = int(np.searchsorted(off, lo + i, "right")) - 1
            a = lo + int(i)
            while a > off[d] and data[a - 1] == 32:
                a -= 1
            spaces = lo + int(i) + 1 - a - (a > off[d])
            out[d] += self._lookup([b" " * spaces])[0] if spaces else self.alone
        for d in np.flatnonzero(off[1:] > off[:-1]):
            if self.control[data[off[d]]]:
                out[d] += self.prefix - 1
        for d in self._marked(words):
            out[d] = self._encode([data[off[d] : off[d + 1]].tobytes().decode()])[0]
        return out

    @staticmethod
    def _marked(words: Words) -> list[int]:
        """Texts that hold the model's own space mark; they are encoded whole."""
        lo, hi = int(words.offsets[0]), int(words.offsets[-1])
        part = words.data[lo:hi]
        at = np.flatnonzero(part[:-2] == _MARK_BYTES[0]) if len(part) > 2 else np.zeros(0, int)
        at = at[(part[at + 1] == _MARK_BYTES[1]) & (part[at + 2] == _MARK_BYTES[2])]
        return np.unique(np.searchsorted(words.offsets, at + lo, "right") - 1).tolist()


_worker: dict[int, Counter] = {}


def _counter(model: bytes, hashes, counts) -> Counter:
    """One per worker process, so that the cache lives as long as the worker."""
    key = hash((model, len(hashes) if hashes is not None else -1, hashes.tobytes() if hashes is not None else b""))
    if key not in _worker:
        _worker.clear()
        _worker[key] = Counter(model, hashes, counts)
    return _worker[key]


def frequent_lengths(docs: DataFrame, model: bytes, most: int = SAMPLE, size: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and token counts of about the ``size`` most frequent pre-tokens of a bounded sample of texts.

    The table only saves encoding: what it lacks is encoded, so the sample has no effect on results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model)
        seen: dict[int, list[int]] = {}
        if counter.whole:
            return
        for b in slices(batches, "text"):
            words = scan(b.column("text"), EXACT, counter.space)
            if len(words.hash):
                key, n = counter.of_words(words)
                codes, unique = pd.factorize(key)
                tokens = np.zeros(len(unique), np.int64)
                tokens[codes] = n
                for k, c, t in zip(unique.tolist(), np.bincount(codes).tolist(), tokens.tolist(), strict=True):
                    old = seen.setdefault(k, [0, t])
                    old[0] += c
        seen.pop(0, None)
        top = sorted(seen.items(), key=lambda x: (-x[1][0], x[0]))[:size]
        yield arrow({"hash": signed(np.array([k for k, _ in top], np.uint64)), "seen": np.array([v[0] for _, v in top], np.int64), "tokens": np.array([v[1] for _, v in top], np.int64)})

    sample = bounded_sample(docs.where("text is not null"), "doc_id", most).select("text").repartition(4)
    rows = sample.mapInArrow(run, "hash long, seen long, tokens long").groupBy("hash").agg(F.sum("seen").alias("seen"), F.first("tokens").alias("tokens"))
    top = rows.orderBy(F.desc("seen"), "hash").limit(size).toPandas()
    hashes = top["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], top["tokens"].to_numpy(np.int64)[order]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Tokens are those that sentencepiece gives for the whole text without begin or end marks.

    Defined cases: a null or empty text has 0 bytes and 0 tokens; null and repeated doc_ids are returned as they
    are; an empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    with open(model_path, "rb") as f:
        model = f.read()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast((model, *frequent_lengths(slim, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(*sent.value)
        for b in slices(batches, "text"):
            n = counter.count(b.column("text"))
            size = np.diff(buffers(b.column("text"))[0])
            yield arrow({"doc_id": b.column("doc_id"), "n_bytes": size.astype(np.int64), "n_tokens": n.astype(np.int64), "over_limit": n > limit})

    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

