"""Language-model scores from a log-frequency Bloom filter.

Texts are cut into slices, and every slice sends, for each range of hashes, one packed block of its distinct words and
word pairs with their counts in the training texts.  A range adds its blocks up to exact counts, fills its own segment
of the filter, looks all its n-grams up in it and answers every slice with one level for each n-gram that it sent; the
slices then score their texts.  A count c is quantised to the level 1 + floor(log2 c); the filter holds an n-gram once
for every level up to its own, so probing level after level until a probe fails gives the level back, and a level
stands for the mean of the counts in it.

Scale: no count is left out at any size.  A segment has ``BITS_EACH`` bits for each n-gram and level, and ranges get
more, not larger, as the texts grow; no machine holds the whole filter.  The base score is exact: frequent words come
from a bounded broadcast table, the rest from a join on the word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .textstats import arrow
from .words import FACTORS, FOLDED, ROWS, Words, lists, mix, scan, signed, slices

#: The most bits of one range's segment, by a bound on its n-grams from the bytes and rows of the texts.
MAX_BITS = 1 << 28
BITS_EACH = 8
PROBES = 4
TOP = 48
FREQUENT = 1 << 17
CHUNK = 6 << 20
END = np.uint64(0x5851F42D4C957F2D)
_WORD, _PAIR = 1, 2


def with_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each document's words, and the first token of each document."""
    n = len(words.first) - 1
    tokens = np.empty(len(words.hash) + n, np.uint64)
    tokens[np.arange(len(words.hash)) + words.documents()] = words.hash
    tokens[words.first[1:] + np.arange(n)] = END
    return tokens, words.first + np.arange(n + 1)


def pairs(tokens: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before it; before a document stands an end."""
    before = np.concatenate((np.array([END]), tokens[:-1]))
    return mix(before * FACTORS[20] + tokens * FACTORS[21])


def singles(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens * FACTORS[22])


def _distinct(text: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Tokens and the first of each document; by kind the sorted n-grams and which one each token is.  Of pairs, the
    bits of the range and the next 32 are kept."""
    tokens, first = with_ends(scan(text, FOLDED))
    two = pairs(tokens) >> np.uint64(32 - bits)
    return tokens, first, {k: np.unique(x, return_inverse=True) for k, x in ((_WORD, singles(tokens)), (_PAIR, two))}


def _small(c: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more follow in full."""
    return np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype(np.int64).tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    c = np.frombuffer(data, np.uint8, n).astype(np.int64)
    if len(data) > n:
        c[c == 255] = np.frombuffer(data, np.int64, offset=n)
    return c


_BLOCK = "first long, kind int, part int, keys binary, counts binary, more int"
_NAMES = ["first", "kind", "part", "keys", "counts", "more"]


def _cut(docs: DataFrame) -> DataFrame:
    """(doc_id, train, text) with a row number; rows of equal number / ROWS are a slice with about CHUNK bytes of text."""
    names = ["doc_id", "train", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 24
        for b in slices(batches, "text", CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(at * ROWS + np.arange(b.num_rows)), *(b.column(c) for c in names)], ["row", *names])
            at += 1

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(names).mapInArrow(run, f"row long, {kinds}")


def _probes(cut: DataFrame, bits: int) -> DataFrame:
    """The distinct n-grams of each run of rows of one slice with their training counts (0 where only other texts have
    them), one block for each run, kind and range.  A slice is one run, or more where it is read in more batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column("row").to_numpy()
            cuts = np.flatnonzero(np.r_[True, np.diff(number // ROWS) != 0, True]) if len(number) else []
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                part = b.slice(start, stop - start)
                _, first, found = _distinct(part.column("text"), bits)
                learned = np.repeat(part.column("train").to_numpy(zero_copy_only=False).astype(float), np.diff(first))
                rows = []
                for kind, (keys, of) in found.items():
                    counts = np.bincount(of, learned, len(keys)).astype(np.int64)
                    where = (keys >> np.uint64(32 if kind == _PAIR else 64 - bits)).astype(np.int64)
                    keys = keys.astype(np.uint32) if kind == _PAIR else keys
                    edge = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True])
                    rows += [(int(number[start]), kind, int(where[lo]), keys[lo:hi].tobytes(), _small(counts[lo:hi]), 0) for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)

    return cut.select("row", "train", "text").mapInArrow(run, _BLOCK)


def _answered(probes: DataFrame, bits: int) -> DataFrame:
    """For each kind and range, the counts of the n-grams of the training texts (first -1), and for each run's block
    the levels that the range's segment gives back, in the order of the block."""

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        kind, part = int(key[0]), int(key[1])
        sent = [np.frombuffer(k, np.uint32 if kind == _PAIR else np.uint64) for k in rows["keys"]]
        sizes = [len(k) for k in sent]
        keys, of = np.unique(np.concatenate(sent), return_inverse=True)
        c = np.bincount(of, np.concatenate([_large(x, n) for x, n in zip(rows["counts"], sizes, strict=True)])).astype(np.int64)
        held = c > 0
        probed = keys.astype(np.uint64) if kind == _PAIR else keys >> np.uint64(32 - bits)
        level = probe(fill(kind, probed[held], c[held]), kind, probed)[of].astype(np.uint8)
        out = [(int(n), kind, part, b"", x.tobytes(), 0) for n, x in zip(rows["first"], np.split(level, np.cumsum(sizes)[:-1]), strict=True)]
        if held.any():
            k, c = keys[held], c[held]
            more = c > 1
            counts = c[more].astype(np.uint32 if c.max() < 1 << 32 else np.uint64).tobytes()
            out.append((-1, kind, part, np.concatenate((k[~more], k[more])).tobytes(), counts, int(more.sum())))
        return pd.DataFrame(out, columns=_NAMES)

    return probes.groupBy("kind", "part").applyInPandas(merge, _BLOCK)


def _gathered(train: DataFrame, bits: int) -> DataFrame:
    """All n-gram counts of the training texts, one block for each kind and range."""
    docs = train.select(F.lit(0).alias("doc_id"), F.lit(True).alias("train"), "text")
    return _answered(_probes(_cut(docs), bits), bits).where("first < 0")


def _unpack(kind: int, keys: bytes, counts: bytes, more: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(keys, np.uint32 if kind == _PAIR else np.uint64)
    c = np.ones(len(k), np.int64)
    if more:
        c[-more:] = np.frombuffer(counts, np.uint32 if len(counts) == 4 * more else np.uint64)
    return k, c


def _levels(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(c.astype(np.float64))[1], TOP)


def _word_counts(blocks: DataFrame) -> DataFrame:
    """(hash, c) for every training token, by its hash as a single."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                k, c = _unpack(_WORD, row["keys"], row["counts"], row["more"])
                yield arrow({"hash": signed(k), "c": c})

    return blocks.where(F.col("kind") == _WORD).mapInArrow(run, "hash long, c long")


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words with the largest counts, ``most`` at most: a threshold on the count, from a histogram in steps of a
    quarter of an octave, so that no task and no driver sorts them."""
    step = F.floor(4 * F.log2("c")).cast("int")
    least, total = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return counts.where(step >= least) if least is not None else counts.limit(0)


def _histogram(blocks: DataFrame) -> pd.DataFrame:
    """n-grams and tokens by kind and level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = _unpack(row["kind"], row["keys"], row["counts"], row["more"])[1]
                n = np.bincount(_levels(c), minlength=TOP + 1)
                total = np.bincount(_levels(c), weights=c, minlength=TOP + 1).astype(np.int64)
                yield arrow({"kind": np.full(TOP + 1, row["kind"], np.int32), "level": np.arange(TOP + 1, dtype=np.int32), "n": n.astype(np.int64), "total": total})

    rows = blocks.mapInArrow(run, "kind int, level int, n long, total long").where("n > 0")
    return rows.groupBy("kind", "level").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas()


def _places(keys: np.ndarray, level: int, size: int) -> list[np.ndarray]:
    """The bits of a segment that stand for n-grams at a level."""
    a = mix(keys * FACTORS[24] + np.array([level], np.uint64) * FACTORS[25])
    b = mix(a + FACTORS[26])
    low = np.uint64(0xFFFFFFFF)
    wide = np.uint64(size)
    return [((x * wide) >> np.uint64(32)).astype(np.int64) for x in (a & low, a >> np.uint64(32), b & low, b >> np.uint64(32))][:PROBES]


def _places_of(kind: int, keys: np.ndarray, level: int, size: int) -> list[np.ndarray]:
    return _places((keys & np.uint64(0xFFFFFFFF)) * np.uint64(4) + np.uint64(kind), level, size)


def fill(kind: int, keys: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The segment of a range: each n-gram at every level up to its own, in BITS_EACH bits for each of them."""
    level = _levels(c)
    seg = np.zeros(max(64, BITS_EACH * int(level.sum())), bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        for place in _places_of(kind, keys[level >= j], j, len(seg)):
            seg[place] = True
    return seg


def probe(seg: np.ndarray, kind: int, keys: np.ndarray) -> np.ndarray:
    """The levels that a segment gives back; 0 for n-grams that it doesn't hold."""
    level = np.zeros(len(keys), np.int64)
    alive = np.arange(len(keys))
    for j in range(1, TOP + 1):
        ok = np.ones(len(alive), bool)
        for place in _places_of(kind, keys[alive], j, len(seg)):
            ok &= seg[place]
        alive = alive[ok]
        if not len(alive):
            break
        level[alive] = j
    return level


@dataclass
class Filter:
    """The segments of a small model by kind and range, with the mean counts of the levels by kind."""

    bits: int
    segments: dict[tuple[int, int], np.ndarray]
    means: dict[int, np.ndarray]

    def counts(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        """Mean counts of the levels that the filter gives back; 0 for n-grams that it doesn't hold."""
        part = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        level = np.zeros(len(hashes), np.int64)
        for p in np.unique(part):
            if (seg := self.segments.get((kind, int(p)))) is not None:
                level[part == p] = probe(seg, kind, hashes[part == p] >> np.uint64(32 - self.bits))
        return self.means[kind][level]


def level_means(hist: pd.DataFrame) -> dict[int, np.ndarray]:
    means = {k: np.zeros(TOP + 1) for k in (_WORD, _PAIR)}
    for r in hist.itertuples():
        means[r.kind][r.level] = r.total / r.n
    return means


def build_filter(blocks: DataFrame, hist: pd.DataFrame, bits: int) -> Filter:
    """All segments on the driver, for models that fit there; scoring leaves them where the ranges are."""
    segments = {}
    for r in blocks.toLocalIterator():
        k, c = _unpack(r["kind"], r["keys"], r["counts"], r["more"])
        segments[r["kind"], r["part"]] = fill(r["kind"], k.astype(np.uint64) if r["kind"] == _PAIR else k >> np.uint64(32 - bits), c)
    return Filter(bits, segments, level_means(hist))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums by document (each has a token at least)."""
    return np.add.reduceat(values, first[:-1]) if len(first) > 1 else np.zeros(0)


def language_model_scores(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", weight: float = 200.0, max_bits: int = MAX_BITS, frequent: int = FREQUENT
) -> DataFrame:
    """One row per input row: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (A-Z lower-cased) and one end.  ``train`` is a condition on the columns of ``docs``; rows
    for which it is true are learned from.  base_score sums log10((c + 1) / (N + V + 1)) over the tokens, with exact
    training counts c, tokens N and distinct tokens V.  score sums log10 of (c(vw) + weight * p(w)) / (c(v) + weight)
    with the counts that the filter gives back and p(w) = (c(w) + 1) / (N + V + 1).  ``max_bits`` bounds one range of
    the filter: there are as many ranges as keep to it.

    Defined cases: a null or empty text has one token, the end; a null doc_id is scored, and learned from where
    ``train`` is true (a null condition is false); repeated rows all count and are each returned; without training
    rows N = V = 0 and all scores are 0; an empty table gives an empty result; other columns are only read by
    ``train``.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    volume, rows = (x or 0 for x in slim.agg(F.sum(F.octet_length("text")), F.count("*")).first())
    most = BITS_EACH * (volume / 2 + 2 * rows)  # levels of a kind are no more than its tokens
    bits = min(24, max(4, math.ceil(math.log2(max(1, volume / (4 << 20), most / max_bits)))))
    cut = durable(_cut(slim), "slices")
    answers = durable(_answered(_probes(cut, bits), bits), "ngrams")
    blocks = answers.where("first < 0")
    hist = _histogram(blocks)
    of_words = hist[hist["kind"] == _WORD]
    n_train, v = int(of_words["total"].sum()), int(of_words["n"].sum())
    counts = _word_counts(blocks)
    top = _frequent(counts, frequent).toPandas()
    hashes = top["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    sent = spark.sparkContext.broadcast((hashes[order], top["c"].to_numpy(np.int64)[order], level_means(hist)))
    space = n_train + v + 1

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known, c_known, means = sent.value
        left = left.sort_by("row").combine_chunks().to_batches()[0]
        of_run, kinds, parts = (right.column(c).to_numpy() for c in ("first", "kind", "part"))
        starts = np.unique(of_run)
        edges = np.r_[np.searchsorted(left.column("row").to_numpy(), starts), left.num_rows]
        out = []
        for start, lo, hi in zip(starts, edges[:-1], edges[1:], strict=True):
            b = left.slice(lo, hi - lo)
            tokens, first, found = _distinct(b.column("text"), bits)
            near = {}
            for kind in found:
                at = np.flatnonzero((of_run == start) & (kinds == kind))
                levels = right.column("counts").take(pa.array(at[np.argsort(parts[at])])).to_pylist()
                near[kind] = means[kind][np.frombuffer(b"".join(levels), np.uint8)]
            unique, codes = found[_WORD]
            words = unique[codes]
            i = np.minimum(np.searchsorted(known, unique), max(0, len(known) - 1))
            hit = known[i] == unique if len(known) else np.zeros(len(unique), bool)
            exact = np.where(hit, c_known[i], 0) if len(known) else np.zeros(len(unique), np.int64)
            c1 = np.where(hit, exact, near[_WORD])[codes]
            c0 = np.concatenate((c1[-1:], c1[:-1]))  # the last token is an end
            c2 = np.minimum(near[_PAIR][found[_PAIR][1]], c1)
            p = (c2 + weight * (c1 + 1) / space) / (np.maximum(c0, c2) + weight)
            seen = hit[codes]
            doc = np.repeat(np.arange(b.num_rows), np.diff(first))
            rest = np.flatnonzero(~seen)
            order = np.lexsort((words[rest], doc[rest]))
            rest = rest[order]
            head = np.flatnonzero(np.r_[True, (words[rest][1:] != words[rest][:-1]) | (doc[rest][1:] != doc[rest][:-1])][: len(rest)])
            times = np.diff(np.r_[head, len(rest)])
            sizes = np.bincount(doc[rest[head]], minlength=b.num_rows)
            out.append(
                arrow(
                    {
                        "row": b.column("row"), "doc_id": b.column("doc_id"), "train": b.column("train"), "n_tokens": np.diff(first).astype(np.int64),
                        "n_seen": _sums(seen, first).astype(np.int64), "logs": _sums(np.log10(exact[codes] + 1.0), first), "score": _sums(np.log10(p), first),
                        "rare": lists(signed(words[rest[head]]), sizes, pa.int64()), "times": lists(times.astype(np.int32), sizes, pa.int32()),
                    }
                )
            )
        return pa.Table.from_batches(out)

    if not n_train:
        words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        zero = F.lit(0).cast("long")
        return slim.select("doc_id", "train", (words + 1).cast("long").alias("n_tokens"), zero.alias("n_known"), zero.alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    schema = f"row long, doc_id {kind}, train boolean, n_tokens long, n_seen long, logs double, score double, rare array<long>, times array<int>"
    asked = answers.where("first >= 0").select("first", "kind", "part", "counts")
    by_slice = [d.groupBy(F.expr(f"{c} div {ROWS}")) for d, c in ((cut, "row"), (asked, "first"))]
    scored = durable(by_slice[0].cogroup(by_slice[1]).applyInArrow(score, schema), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("hash"), F.col("x.times").alias("times"))
    found = rare.join(counts, "hash").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rest"))
    return scored.join(found, "row", "left").select(
        "doc_id",
        "train",
        "n_tokens",
        (F.col("n_seen") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(space))).alias("base_score"),
        "score",
    )
