"""Substring dedup by level-wise doubling.

Every window of 50 words that two documents share holds a shared 25-word window, the one whose hash is least among
the 26 inside it.  So the first level counts these least 25-word windows alone (about one in thirteen); only places
around those that repeat are extended to twice the length, and so on until the asked length is reached or no
candidate survives.  The last level looks at every window that is left.

Scale: all shuffled rows are a hash, a doc_id and a place; copies of whole documents are set aside by one hash
first; a window that very many documents share is summed before the exchange.  What the sums give is written down, so
that the joins with it have a bare exchange on either side, which Spark splits where a window is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import drop, durable
from .names import fresh
from .words import FACTORS, Words, grams, lists, mix, scan, signed, slices

WINDOW = 50
BASE = 25


def levels(window: int, base: int) -> list[int]:
    """The lengths, each at most twice the one before; the last is ``window``."""
    out = [window]
    while (out[0] + 1) // 2 >= base:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _slide(values: np.ndarray, width: int, of) -> np.ndarray:
    """of.reduce over ``width`` values from each place on."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = of(out[:-step], out[step:])
        have += step
    return out


def window_starts(words: Words, window: int, spans: list[np.ndarray] | None) -> np.ndarray:
    """Which words start a window inside one document (and inside one of the document's spans of first words)."""
    n = len(words.hash)
    ok = np.zeros(n, bool)
    for d, (lo, hi) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        if hi - lo >= window:
            if spans is None:
                ok[lo : hi - window + 1] = True
            else:
                s = spans[d]
                step = np.zeros(hi - lo + 2, np.int32)
                np.add.at(step, np.clip(s[:, 0], 0, hi - lo), 1)
                np.add.at(step, np.clip(s[:, 1], 0, hi - lo), -1)
                ok[lo : hi - window + 1] = np.cumsum(step)[: hi - lo - window + 1] > 0
    return ok


def anchors(words: Words, length: int, window: int, spans: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (word indexes) and hashes of the ``length``-word windows that are least in some candidate window."""
    n, width = len(words.hash), window - length + 1
    h, at = grams(words, length)
    if not len(h):
        return at, h
    dense = np.full(n + width, np.iinfo(np.uint64).max, np.uint64)
    dense[at] = h
    least = _slide(dense, width, np.minimum)[:n]
    least = np.where(window_starts(words, window, spans), least, np.uint64(0))
    most = _slide(np.concatenate((np.zeros(width - 1, np.uint64), least)), width, np.maximum)
    at = at[(most[at] == h) & (h > 0)]
    return at, dense[at]


def _gather(values: np.ndarray, at: np.ndarray, words: Words, kind: pa.DataType) -> pa.Array:
    """A list for each document of ``values``, which belong to the words ``at`` (ascending)."""
    return lists(values, np.diff(np.searchsorted(at, words.first)), kind)


def _spans(places: pa.Array, length: int, window: int) -> list[np.ndarray]:
    """Ranges of first words of the windows that contain a window of ``length`` at one of the places."""
    out = []
    for p in places:
        p = np.asarray(p.values.to_numpy(zero_copy_only=False), np.int64)
        out.append(np.stack((p - (window - length), p + 1), axis=1))
    return out


def _scan_documents(docs: DataFrame, kind: str, length: int, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words = scan(b.column("text"))
            raw = words.data.tobytes() if len(words.data) < 1 << 16 else memoryview(words.data)
            digest = [hashlib.sha256(b" ".join(bytes(raw[lo:hi]).split())).digest() for lo, hi in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
            at, h = anchors(words, length, window) if length < window else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            local = at - np.repeat(words.first[:-1], np.diff(np.searchsorted(at, words.first)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(words.counts().astype(np.int64)), pa.array(digest, pa.binary()), _gather(signed(h), at, words, pa.int64()), _gather(local.astype(np.int32), at, words, pa.int32())],
                ["doc_id", "n_words", "digest", "hashes", "places"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, digest binary, hashes array<long>, places array<int>")


def _next_anchors(candidates: DataFrame, kind: str, before: int, length: int, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words = scan(b.column("text"))
            at, h = anchors(words, length, window, _spans(b.column("places"), before, window))
            n = np.diff(np.searchsorted(at, words.first))
            doc = np.repeat(np.arange(b.num_rows), n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc)), pa.array(signed(h)), pa.array((at - words.first[doc]).astype(np.int32))], ["doc_id", "hash", "place"]
            )

    return candidates.mapInArrow(run, f"doc_id {kind}, hash long, place int")


def window_hashes(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows, and two independent hashes (64 and 32 bits) of each."""
    h, at = grams(words, window)
    other = Words(words.first, words.start, words.end, mix(words.hash + FACTORS[40]), words.data, words.offsets)
    return at, h, (grams(other, window)[0] >> np.uint64(33)).astype(np.int32)


def _last_windows(candidates: DataFrame, kind: str, before: int, window: int) -> DataFrame:
    """(hash, guard, doc_id) once for each different candidate window of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words = scan(b.column("text"))
            spans = _spans(b.column("places"), before, window) if before < window else None
            ok = window_starts(words, window, spans)
            at, h, g = window_hashes(words, window)
            keep = ok[at]
            at, h, g = at[keep], h[keep], g[keep]
            doc = np.repeat(np.arange(b.num_rows), np.diff(np.searchsorted(at, words.first)))
            order = np.lexsort((h, doc))
            order = order[np.r_[True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])][: len(order)]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc[order])), pa.array(signed(h[order])), pa.array(g[order])], ["doc_id", "hash", "guard"])

    return candidates.mapInArrow(run, f"doc_id {kind}, hash long, guard int")


def _cut(candidates: DataFrame, kind: str, window: int) -> DataFrame:
    """Remove the flagged windows' words: (doc_id, digest, n_removed, kept_sha256, kept_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words = scan(b.column("text"))
            at, h, g = window_hashes(words, window)
            first = np.searchsorted(at, words.first)
            step = np.zeros(len(words.hash) + 1, np.int32)
            for d, flagged in enumerate(b.column("flagged")):
                fh = np.sort(flagged.values.field("hash").to_numpy().view(np.uint64))
                order = np.argsort(flagged.values.field("hash").to_numpy().view(np.uint64))
                fg = flagged.values.field("guard").to_numpy()[order]
                mine = slice(first[d], first[d + 1])
                i = np.minimum(np.searchsorted(fh, h[mine]), len(fh) - 1)
                hit = at[mine][(fh[i] == h[mine]) & (fg[i] == g[mine])]
                step[hit] += 1
                step[hit + window] -= 1
            gone = np.cumsum(step)[:-1] > 0
            out: list[list] = [[], [], [], []]
            for lo, hi, a, z in zip(words.first[:-1], words.first[1:], words.offsets[:-1], words.offsets[1:], strict=True):
                raw = words.data[a:z].tobytes()
                every = raw.split()
                out[0].append(hashlib.sha256(b" ".join(every)).digest())
                mask = gone[lo:hi]
                kept = [w for w, x in zip(every, mask, strict=True) if not x]
                out[1].append(int(mask.sum()))
                out[2].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                out[3].append(remaining_text(raw, words.start[lo:hi] - a, mask))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
                ["doc_id", "digest", "n_removed", "kept_sha256", "kept_text"],
            )

    return candidates.mapInArrow(run, f"doc_id {kind}, digest binary, n_removed long, kept_sha256 string, kept_text string")


def remaining_text(raw: bytes, start: np.ndarray, gone: np.ndarray) -> str:
    """The text without the removed words; of the white space around a removed run, that before it stays."""
    if not gone.any():
        return raw.decode()
    turn = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    parts, at = [], 0
    for lo, hi in zip(turn[::2], turn[1::2], strict=True):
        parts.append(raw[at : start[lo]])
        at = int(start[hi]) if hi < len(start) else len(raw)
    parts.append(raw[at:])
    out = b"".join(parts)
    return (out.rstrip(b" \t\n\v\f\r") if gone[-1] else out).decode()


def repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, base: int = BASE, with_text: bool = False
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (and with_text: kept_text, null if nothing is removed).

    A word is removed when it is covered by a window of ``window`` consecutive words whose word sequence also starts
    in a document with a smaller doc_id; windows are judged on the input.  kept_sha256 is that of the kept words
    joined by one space.

    Defined cases: a null text has no words; a text with fewer words than ``window`` loses nothing; a row with a null
    doc_id neither loses words nor makes others lose any; rows that repeat a doc_id count as one document, so they
    take nothing from each other; an empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    steps = levels(window, base)
    scanned = durable(_scan_documents(slim, kind, steps[0], window), "scanned")
    able = scanned.where("doc_id is not null").where(F.col("n_words") >= window)
    copies = durable(able.groupBy("digest").agg(F.min("doc_id").alias("first")), "copies")
    alone = able.join(copies.withColumnRenamed("first", "doc_id"), ["doc_id", "digest"])
    result = scanned.select("doc_id", "n_words", "digest").join(copies, "digest", "left")
    if len(steps) > 1:
        rows = alone.select("doc_id", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("doc_id", F.col("x.hashes").alias("hash"), F.col("x.places").alias("place"))
        candidates = slim
        for before, length in zip(steps[:-1], steps[1:], strict=True):
            shared = rows.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("hash")
            live = rows.join(durable(shared, "shared"), "hash").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
            older, candidates = candidates, durable(candidates.drop("places").join(live, "doc_id"), "candidates")
            drop(older)
            if length == window or candidates.isEmpty():
                break
            rows = _next_anchors(candidates, kind, before, length, window)
    else:
        before, candidates = window, durable(slim.join(alone.select("doc_id").distinct(), "doc_id").withColumn("places", F.array().cast("array<int>")), "candidates")
    windows = durable(_last_windows(candidates, kind, before, window), "windows")
    least = windows.groupBy("hash", "guard").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("hash", "guard", "lo")
    least = durable(least, "least")
    flagged = windows.join(least, ["hash", "guard"]).where("doc_id > lo").groupBy("doc_id").agg(F.collect_list(F.struct("hash", "guard")).alias("flagged"))
    changed = _cut(candidates.join(flagged, "doc_id"), kind, window).dropDuplicates(["doc_id", "digest"])
    changed = changed if with_text else changed.drop("kept_text")
    changed = durable(changed, "changed")
    drop(windows)
    copy = F.col("first") < F.col("doc_id")
    own = result.join(changed, ["doc_id", "digest"], "left")
    out = own.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        "digest",
        *([F.when(copy, F.lit("")).otherwise(F.when(F.col("n_removed") > 0, F.col("kept_text"))).alias("kept_text")] if with_text else []),
    )
    return out if with_text else out.drop("digest")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with all columns, where the words that :func:`repeated_windows` marks are cut out of the text.

    Texts that lose nothing stay as they are, white space included; a text that loses all words becomes empty.  The
    column ``length_col``, where there is one, gets the new length in code points.

    Defined cases: as in :func:`repeated_windows`; rows with a null doc_id and null texts stay as they are, rows that
    repeat a doc_id are each returned, an empty table gives an empty one, and other columns may have any names.
    """
    key, digest, kept = fresh(docs, "key", "digest", "kept")
    done = repeated_windows(docs, id_col, text_col, with_text=True, **options).where("kept_text is not null and doc_id is not null")
    done = done.select(F.col("doc_id").alias(key), F.col("digest").alias(digest), F.col("kept_text").alias(kept)).dropDuplicates([key, digest])
    words = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    own = docs.withColumn(digest, F.unhex(F.sha2(words.cast("binary"), 256)))
    joined = own.join(done.withColumnsRenamed({key: id_col}), [id_col, digest], "left")
    new = joined.withColumn(text_col, F.coalesce(kept, F.col(text_col)))
    if length_col in docs.columns:
        new = new.withColumn(length_col, F.when(F.col(kept).isNotNull(), F.length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return new.select(*docs.columns)
