"""Counting k-mers of up to 31 bases by minimizers.

A k-mer's minimizer is the m-mer with the least hash among its m-mers and their reverse complements, so both strands of a
k-mer have the same one.  Neighbouring k-mers of a read mostly share it: such a run (a super-k-mer, up to 64 bases) is one
row of two longs, and copies inside a block of reads are one row with a count.  Runs are dealt by the hash of their
minimizer, and the k-mers are cut out of the two longs by shifts on the other side of the shuffle, where both strands meet
in one sum; no string and no single k-mer is shuffled.  Minimizers with so many k-mers that they would be a task of their
own are counted by the k-mers themselves, summed inside tasks first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import packed as P
from ..storage import durable

#: Bytes of reads that are cut into super-k-mers at once.
SEGMENT = 1 << 20
#: A minimizer with fewer k-mers is never counted apart.
LEAST_HOT = 1 << 20
CODES = np.full(256, 4, np.uint8)
CODES[list(b"ACGT")] = np.arange(4)
SCHEMA = "bucket int, hi long, lo long, n int, times int"


def minimizer_size(k: int) -> int:
    """About half of k: runs stay long, and there are many minimizers."""
    return max(1, min(13, max(5, (k + 1) // 2), k))


def pieces(col: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool, bool]]:
    """Codes of the bases of consecutive reads, with the end of each base's read, and whether a piece is the first and the
    last of its reads: a long read comes in parts that overlap by k - 1 bases."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return
    _, off, data = col.buffers()
    if data is None:
        return
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8)
    row = 0
    while row < len(col):
        to = max(row + 1, int(np.searchsorted(off, off[row] + SEGMENT, "right")) - 1)
        ends = np.repeat(off[row + 1 : to + 1], np.diff(off[row : to + 1]))
        begin, stop = int(off[row]), int(off[to])
        for lo in range(begin, max(begin + 1, stop - k + 1), SEGMENT):
            hi = min(stop, lo + SEGMENT + k - 1)
            yield CODES[data[lo:hi]], np.minimum(ends[lo - begin : hi - begin], hi) - lo, lo == begin, hi == stop
        row = to


def reversed_codes(x: np.ndarray, k: int) -> np.ndarray:
    y = ~x
    for step, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        y = ((y >> np.uint64(step)) & np.uint64(mask)) | ((y & np.uint64(mask)) << np.uint64(step))
    return ((y >> np.uint64(32)) | (y << np.uint64(32))) >> np.uint64(64 - 2 * k)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows32(codes: np.ndarray) -> np.ndarray:
    """At every place the 32 bases from there on, packed; bases that are none of the four, and those beyond the end, are 0."""
    p = np.where(codes == 4, 0, codes).astype(np.uint64)
    for s in (1, 2, 4, 8, 16):
        q = np.zeros_like(p)
        q[:-s] = p[s:]
        p = (p << np.uint64(2 * s)) | q
    return p


def whole_windows(codes: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Places from which ``k`` bases lie inside one read and are all one of the four."""
    n = len(codes) - k + 1
    bad = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(codes == 4, out=bad[1:])
    return np.flatnonzero((bad[k:] == bad[:n]) & (np.arange(n) + k <= ends[:n]))


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbouring values."""
    have = 1
    while 2 * have <= w:
        h, have = np.minimum(h[:-have], h[have:]), 2 * have
    return np.minimum(h[: len(h) - (w - have)], h[w - have :]) if w > have else h


def cut(codes: np.ndarray, ends: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...] | None:
    """(bucket, hi, lo, n, times) of the super-k-mers of a piece."""
    if len(codes) < k:
        return None
    at = whole_windows(codes, ends, k)
    if not len(at):
        return None
    p = windows32(codes)
    short = p[: len(codes) - m + 1] >> np.uint64(64 - 2 * m)
    hash_ = (_mix(np.minimum(short, reversed_codes(short, m))) >> np.uint64(32)).astype(np.uint32)
    bucket = _least(hash_, k - m + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (bucket[1:] != bucket[:-1])
    first = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    new |= inside % (65 - k) == 0
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start, size = at[first], n + k - 1
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    hi = p[start] & (ones << (2 * np.maximum(32 - size, 0)).astype(np.uint64))
    rest = np.append(p, np.zeros(32, np.uint64))[start + 32]
    lo = np.where(size > 32, rest & (ones << (2 * np.minimum(64 - size, 31)).astype(np.uint64)), np.uint64(0))
    order = np.lexsort((n, lo, hi))
    hi, lo, n, bucket = hi[order], lo[order], n[order], bucket[first][order]
    head = np.ones(len(n), bool)
    head[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (n[1:] != n[:-1])
    head = np.flatnonzero(head)
    return bucket[head].view(np.int32), hi[head].view(np.int64), lo[head].view(np.int64), n[head].astype(np.int32), np.diff(np.append(head, len(n))).astype(np.int32)


def super_kmers(reads: DataFrame, k: int) -> DataFrame:
    """(bucket, hi, lo, n, times): runs of ``n`` k-mers with one minimizer, in bases packed into two longs."""
    m = minimizer_size(k)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for codes, ends, _, _ in pieces(b.column(0), k):
                found = cut(codes, ends, k, m)
                if found is not None:
                    yield pa.record_batch([pa.array(x) for x in found], ["bucket", "hi", "lo", "n", "times"])

    return reads.select("seq").mapInArrow(each, SCHEMA)


def row_kmers(col: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, packed k-mer) of all places of a column of reads, for some whole reads at a time; k-mers with other letters than
    the four bases are left out."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col) or col.buffers()[2] is None:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)
    row = 0
    while row < len(col):
        to = max(row + 1, int(np.searchsorted(off, off[row] + SEGMENT, "right")) - 1)
        codes = CODES[data[off[row] : off[to]]]
        ends = np.repeat(off[row + 1 : to + 1], np.diff(off[row : to + 1])) - off[row]
        at = whole_windows(codes, ends, k) if len(codes) >= k else ()
        if len(at):
            yield row + np.searchsorted(off[row : to + 1] - off[row], at, "right") - 1, windows32(codes)[at] >> np.uint64(64 - 2 * k)
        row = to


def forward_counts(reads: DataFrame, k: int, *by: str) -> DataFrame:
    """(by, code, m): occurrences on the forward strand, summed inside tasks for some reads at a time first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = np.zeros(b.num_rows, np.int64)
            for c in b.columns[1:]:
                one = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                group = np.unique(group * (int(one.max(initial=0)) + 1) + one, return_inverse=True)[1]
            for row, x in row_kmers(b.column(0), k):
                order = np.lexsort((x, group[row]))
                row, x = row[order], x[order]
                first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (group[row[1:]] != group[row[:-1]])))
                at = pa.array(row[first])
                yield pa.record_batch([*(c.take(at) for c in b.columns[1:]), pa.array(x[first].view(np.int64)), pa.array(np.diff(np.append(first, len(x))))], [*by, "code", "m"])

    rows = reads.select("seq", *by)
    schema = Y.StructType([*(rows.schema[c] for c in by), Y.StructField("code", Y.LongType()), Y.StructField("m", Y.LongType())])
    return rows.mapInArrow(each, schema).groupBy(*by, "code").agg(F.sum("m").alias("m"))


def read_summary(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, n, n_distinct, least, most): a read's k-mers, how many are different, and the first and last of them as strings;
    reads with one read_id are one, and reads shorter than k give nothing."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            for i in range(b.num_rows) if pa.compute.any(pa.compute.greater(lists.value_lengths(), 1)).as_py() else [None]:
                # one read for each read_id: all of a batch at once
                seqs = lists.flatten() if i is None else pa.array(["N".join(x or "" for x in lists[i].as_py())], pa.large_string())
                for row, x in row_kmers(seqs, k):
                    order = np.lexsort((x, row))
                    row, x = row[order], x[order]
                    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    last = np.append(first[1:], len(row)) - 1
                    fresh = np.append(True, (x[1:] != x[:-1]) | (row[1:] != row[:-1])).astype(np.int64)
                    ids = b.column(0).take(pa.array(row[first] if i is None else [i]))
                    yield pa.record_batch([ids, pa.array(last - first + 1), pa.array(np.add.reduceat(fresh, first)), pa.array(x[first].view(np.int64)), pa.array(x[last].view(np.int64))], ["read_id", "n", "n_distinct", "least", "most"])

    names = Y.StructType([Y.StructField("read_id", reads.schema["read_id"].dataType), *(Y.StructField(c, Y.LongType()) for c in ("n", "n_distinct", "least", "most"))])
    held = reads.groupBy("read_id").agg(F.collect_list(F.coalesce("seq", F.lit(""))).alias("seqs"))
    return held.mapInArrow(each, names).select("read_id", "n", "n_distinct", P.spelled("least", k).alias("least"), P.spelled("most", k).alias("most"))


def _expanded(runs: DataFrame, k: int) -> DataFrame:
    """(bucket, times, x): the k-mers of super-k-mers."""
    end = f"(i + {k})"
    x = f"""case when {end} <= 32 then shiftrightunsigned(hi, 64 - 2 * {end}) when {end} = 64 then lo
      else shiftrightunsigned(lo, 128 - 2 * {end}) | shiftleft(hi, 2 * {end} - 64) end & {P.bits(k)}"""
    return runs.select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("i")).select("bucket", F.col("times").cast("long").alias("times"), F.expr(x).alias("x"))


def _summed(each: DataFrame, k: int, *by: str) -> DataFrame:
    both = P.with_reverse(each, "x", k, "y").select(*by, F.least("x", "y").alias("code"), F.expr("if(x <= y, times, 0L)").alias("f"), F.expr("if(x > y, times, 0L)").alias("r"))
    return both.groupBy(*by, "code").agg(F.sum("f").alias("f"), F.sum("r").alias("r")).select("code", "f", "r")


def canonical_counts(reads: DataFrame, k: int) -> DataFrame:
    """(code, f, r): each k-mer modulo reverse complement as the lesser of both numbers, with its occurrences on the forward
    strand as it stands (f) and reversed (r).  Its abundance on both strands is f + r, that of a palindrome 2 f."""
    if not 1 <= k <= P.MOST_K:
        raise ValueError(f"packed k-mers have 1 to {P.MOST_K} bases")
    runs = durable(super_kmers(reads, k), "super-kmers")
    sizes = durable(runs.groupBy("bucket").agg(F.sum(F.col("n") * F.col("times")).alias("kmers")), "minimizers")
    tasks = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(LEAST_HOT, (sizes.agg(F.sum("kmers")).first()[0] or 0) // (4 * tasks))
    hot = [r["bucket"] for r in sizes.where(F.col("kmers") > limit).select("bucket").collect()]  # 4 * tasks at most
    if not hot:
        return _summed(_expanded(runs.repartition("bucket"), k), k, "bucket")
    mark = F.broadcast(reads.sparkSession.createDataFrame([(b,) for b in hot], "bucket int"))
    cold = runs.join(mark, "bucket", "left_anti").repartition("bucket")
    apart = runs.join(mark, "bucket", "left_semi")
    return _summed(_expanded(cold, k), k, "bucket").unionAll(_summed(_expanded(apart, k), k))


def both_strands(counts: DataFrame, k: int) -> DataFrame:
    """(x, n, m) from :func:`canonical_counts`: each k-mer and its reverse complement with the abundance on both strands, and
    m, the occurrences of x itself on the forward strand, null where there are none."""
    rows = P.with_reverse(counts, "code", k, "back").withColumn("n", F.expr("if(code = back, 2 * f, f + r)"))
    each = rows.select("n", F.explode(F.expr("if(code = back, array(struct(code as x, f as m)), array(struct(code as x, f as m), struct(back as x, r as m)))")).alias("e"))
    return each.select("e.x", "n", F.expr("nullif(e.m, 0)").alias("m"))


def counted_strings(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, n, m): :func:`both_strands` with the k-mers as strings."""
    return both_strands(canonical_counts(reads, k), k).select(P.spelled("x", k).alias("kmer"), "n", "m")
