"""Benchmark decontamination by pigeonhole edit matching.

An item of n tokens may be changed in e = floor(rate * n) tokens.  It is cut into e + 1 pieces; a passage with at
most e token edits holds at least one piece unchanged.  Documents look up all their piece-length token windows in
the set of pieces, and every hit is verified with Myers' bit-parallel distance around the place it implies.  Tokens
are runs of characters other than white space and ASCII punctuation, with A-Z lower-cased.

Scale: documents are never shuffled.  Items are sent to the workers in blocks of a bounded number of tokens, one at a
time: where there are several blocks, what a block gives is written before the next one is sent, so a larger benchmark
takes more passes, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .durable import durable
from .words import FOLDED, LOOSE, Words, grams, lists, scan, signed, slices

RATE = 0.2
BLOCK_TOKENS = 1_000_000
_BITS = 20


def myers(masks: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """The least edit distance of a pattern of length ``m`` to any part of ``text``, and where the first such part ends."""
    ones = (1 << m) - 1
    high = 1 << (m - 1)
    pv, mv, score = ones, 0, m
    best, end = m, 0
    for i, t in enumerate(text):
        eq = masks.get(t, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & ones)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & ones
        mh = (mh << 1) & ones
        pv = mh | (~(xv | ph) & ones)
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


def pattern(tokens: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, t in enumerate(tokens):
        masks[t] = masks.get(t, 0) | 1 << i
    return masks


@dataclass
class Block:
    """Items of one block: their tokens, error budgets, and the pieces by length."""

    ids: list
    tokens: list[list[int]]
    budget: list[int]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # length: seen bits, hashes, items, places

    def hits(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(item, word of the hit, implied first word of the item, both in the whole slice) for every piece found."""
        for length, (seen, keys, item, place) in self.pieces.items():
            h, at = grams(words, length)
            maybe = np.flatnonzero(seen[h >> np.uint64(64 - _BITS)])
            lo = np.searchsorted(keys, h[maybe])
            hi = np.searchsorted(keys, h[maybe], "right")
            for i, a, z in zip(at[maybe[hi > lo]], lo[hi > lo], hi[hi > lo], strict=True):
                for k in range(a, z):
                    yield int(item[k]), int(i), int(i - place[k])


def block(ids: list, tokens: list[np.ndarray], rate: float) -> Block:
    budget = [int(rate * len(t)) for t in tokens]
    found: dict[int, list[tuple[int, int, int]]] = {}
    for i, (t, e) in enumerate(zip(tokens, budget, strict=True)):
        cuts = np.linspace(0, len(t), e + 2).astype(int)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            n = int(hi - lo)
            one = Words(np.array([0, n]), np.zeros(n), np.zeros(n), t[lo:hi], np.zeros(0), np.zeros(2))
            found.setdefault(n, []).append((int(grams(one, n)[0][0]), i, int(lo)))
    pieces = {}
    for n, rows in found.items():
        rows.sort()
        keys = np.array([r[0] for r in rows], np.uint64)
        seen = np.zeros(1 << _BITS, bool)
        seen[keys >> np.uint64(64 - _BITS)] = True
        pieces[n] = (seen, keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return Block(ids, [t.tolist() for t in tokens], budget, pieces)


def find(words: Words, items: Block) -> list[tuple[int, int, int, int, int]]:
    """(document, item, edits, first token, end token) for each document and item that match: the place with the
    fewest edits, of those the first."""
    doc_of = np.searchsorted(words.first, np.arange(len(words.hash)), "right") - 1 if len(words.hash) else np.zeros(0, int)
    places: dict[tuple[int, int], set[int]] = {}
    for item, i, at in items.hits(words):
        # the hit lies inside one document; the implied start may not
        places.setdefault((int(doc_of[i]), item), set()).add(at)
    out = []
    for (d, item), starts in sorted(places.items()):
        tokens, e = items.tokens[item], items.budget[item]
        lo, hi = int(words.first[d]), int(words.first[d + 1])
        masks, m = pattern(tokens), len(tokens)
        best = None
        reach = -1
        spans: list[list[int]] = []
        for at in sorted(starts):
            a, z = max(lo, at - e), min(hi, at + m + e)
            if z <= a:
                continue
            if a <= reach and spans:
                spans[-1][1] = max(spans[-1][1], z)
            else:
                spans.append([a, z])
            reach = spans[-1][1]
        for a, z in spans:
            text = words.hash[a:z].tolist()
            edits, end = myers(masks, m, text)
            if edits <= e and (best is None or edits < best[0]):
                back = text[max(0, end - m - e) : end][::-1]
                _, size = myers(pattern(tokens[::-1]), m, back)
                best = (edits, a + end - size - lo, a + end - lo)
        if best:
            out.append((d, item, *best))
    return out


def _tokens(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words = scan(b.column("text"), FOLDED, LOOSE)
            yield pa.RecordBatch.from_arrays([b.column("item_id"), lists(signed(words.hash), words.counts(), pa.int64())], ["item_id", "tokens"])

    return items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, f"item_id {kind}, tokens array<long>")


def _blocks(items: DataFrame, id_col: str, text_col: str, rate: float) -> Iterator[tuple[Block, bool]]:
    """Items in blocks of about BLOCK_TOKENS tokens, and whether more blocks follow; items of equal tokens are one entry
    with all their ids, and items without a token match nothing and are left out."""
    cut = _tokens(items, id_col, text_col).where("size(tokens) > 0")
    cut = durable(cut.groupBy("tokens").agg(F.collect_list(F.struct("item_id")).alias("ids")), "items")
    total = cut.agg(F.sum(F.size("tokens"))).first()[0] or 0
    count = -(-total // BLOCK_TOKENS)
    for k in range(count):
        mine = cut.where(F.pmod(F.xxhash64("tokens"), F.lit(count)) == k)
        rows = sorted(((sorted((x["item_id"] for x in r["ids"]), key=lambda i: (i is None, i)), r["tokens"]) for r in mine.toLocalIterator()), key=lambda r: r[1])
        yield block([r[0] for r in rows], [np.array(r[1], np.int64).view(np.uint64) for r in rows], rate), k + 1 < count


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE
) -> DataFrame:
    """(doc_id, item_id, edits, first_token, end_token) for each document row and item of which a passage of the
    document is within floor(rate * n) token insertions, deletions and replacements, n being the item's tokens.

    Defined cases: null or empty texts, and items without a token, match nothing; a null doc_id or item_id is
    returned as null; repeated rows on either side are each reported; empty tables give an empty result; other
    columns are not read.
    """
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kinds[0]}, item_id {kinds[1].simpleString()}, edits int, first_token int, end_token int"
    out, many = docs.sparkSession.createDataFrame([], schema), False
    id_type = to_arrow_type(kinds[1])
    for b, more in _blocks(items, item_col, item_text, rate):
        sent = docs.sparkSession.sparkContext.broadcast(b)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                found = [(d, name, *rest) for d, i, *rest in find(scan(part.column("text"), FOLDED, LOOSE), sent.value) for name in sent.value.ids[i]]
                if found:
                    d, names, *rest = zip(*found, strict=True)
                    d, names, rest = np.array(d, np.int64), pa.array(names, id_type), [pa.array(x, pa.int32()) for x in rest]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), names, *rest], ["doc_id", "item_id", "edits", "first_token", "end_token"])

        part = slim.mapInArrow(run, schema)
        if more or many:  # one block at a time is with the workers
            part, many = durable(part, "contaminated"), True
            sent.unpersist()
        out = out.unionAll(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no passage of an item (as in :func:`contamination`).

    Defined cases: as there; rows that repeat are judged alike, and other columns may have any names.
    """
    many = False
    for b, more in _blocks(items, item_col, item_text, rate):
        sent = docs.sparkSession.sparkContext.broadcast(b)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col):
                clean = np.ones(part.num_rows, bool)
                clean[[x[0] for x in find(scan(part.column(text_col), FOLDED, LOOSE), sent.value)]] = False
                yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if more or many:  # one block at a time is with the workers
            docs, many = durable(docs, "clean"), True
            sent.unpersist()
    return docs
