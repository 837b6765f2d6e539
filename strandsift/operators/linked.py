"""Nodes with their neighbours from one shuffle of the reads' super-k-mers.

Two k-mers are neighbours where they share an overlap of k - 1 bases.  So bases are dealt by the minimizers of overlaps: a
k-mer goes to the task of its first overlap and to that of its last one, which is mostly the same, since neighbouring overlaps
mostly share their minimizer.  A task then has every k-mer of its overlaps with all its occurrences, counts them and reads
their neighbours off without another shuffle; only a k-mer between two minimizers is put together from its two halves.
Runs are two longs of bases and a tag: the minimizer's hash, how often the run occurs, whether it begins or ends between two
minimizers, and its k-mers.  The overlaps of a minimizer with too many k-mers for a task to hold are dealt by longer minimizers, so that they are still runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.packed import CAP, MOST_K
from ..storage import durable
from . import superkmers as M

#: k-mers that a task counts on average, and that it counts at once (more where one minimizer has more).
TASK, AT_ONCE = 4 << 20, 1 << 18
#: Runs that are packed together by their tasks, and rows in a batch.
PACKED, BATCH = 1 << 20, 1 << 17
BLOBS = "task int, size int, runs binary"
#: Bases by which the minimizers are longer that overlaps of a minimizer with too many k-mers are dealt by.
LONGER = 3
#: One of so many reads tells how large minimizers are; results don't depend on it.
ONE_OF = 8
RUNS = "hi long, lo long, tag long"
HALVES = "code long, n long, f long, r long, right long, left long"
SUMS = "a int, dr int, dl int, nodes long, same long, share double, forward double, reverse double"
PARTS = "code long, n long, f long, r long, right long, left long, ends int"
ALIVE = "code long, n long, sides int, ends int"


def cut(codes: np.ndarray, ends: np.ndarray, k: int, m: int, hot: np.ndarray, drawn: np.ndarray | None = None) -> tuple[np.ndarray, ...] | None:
    """(hi, lo, tag) of the runs of a piece; ``hot`` are the minimizers whose overlaps are dealt by longer ones.  Where ``drawn``
    tells which places are a sample, a last column has a bit for each k-mer of a run that is."""
    at = M.whole_windows(codes, ends, k) if len(codes) >= k else ()
    if not len(at):
        return None
    p = M.windows32(codes)
    short = p[: len(codes) - m + 1] >> np.uint64(64 - 2 * m)
    bucket = M._least((M._mix(np.minimum(short, M.reversed_codes(short, m))) >> np.uint64(32)).astype(np.uint32), k - m)
    one, two = bucket[at], bucket[at + 1]
    if len(hot):
        hot_one, hot_two = np.isin(one, hot), np.isin(two, hot)
        m = min(k - 1, m + LONGER)
        long_ = p[: len(codes) - m + 1] >> np.uint64(64 - 2 * m)
        longer = M._least((M._mix(np.minimum(long_, M.reversed_codes(long_, m)) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32), k - m)
        one, two = np.where(hot_one, longer[at], one), np.where(hot_two, longer[at + 1], two)
    twice = one != two
    # a k-mer between two minimizers stands twice, by its first overlap (1) and by its last one (2), others once (3)
    place = np.repeat(at, 1 + twice)
    second = np.append(False, place[1:] == place[:-1])
    by = np.repeat(one, 1 + twice)
    by[second] = two[twice]
    flag = np.repeat(np.where(twice, 1, 3), 1 + twice)
    flag[second] = 2
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place) != 1) | (by[1:] != by[:-1])
    new[1:] |= (flag[1:] == 2) | (flag[:-1] == 1)
    first = np.flatnonzero(new)
    inside = np.arange(len(place)) - np.repeat(first, np.diff(np.append(first, len(place))))
    new |= inside % (65 - k) == 0
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(place)))
    edge = (flag[first] == 2) | ((flag[first + n - 1] == 1).astype(np.int64) << 1)
    start, size = place[first], n + k - 1
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    hi = p[start] & (ones << (2 * np.maximum(32 - size, 0)).astype(np.uint64))
    rest = np.append(p, np.zeros(32, np.uint64))[start + 32]
    lo = np.where(size > 32, rest & (ones << (2 * np.minimum(64 - size, 31)).astype(np.uint64)), np.uint64(0))
    tag = by[first].astype(np.uint64) << np.uint64(32) | (edge << 6 | (n - 1)).astype(np.uint64)
    keys = [tag, lo, hi]
    if drawn is not None:
        keys.insert(0, np.add.reduceat(drawn[place].astype(np.int64) << (np.arange(len(place)) - np.repeat(first, n)), first))
    order = np.lexsort(keys)
    keys = [c[order] for c in keys]
    head = np.ones(len(n), bool)
    head[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in keys])
    head = np.flatnonzero(head)
    times = np.diff(np.append(head, len(n))).astype(np.uint64)  # no more than the bases of a piece
    *mask, tag, lo, hi = (c[head] for c in keys)
    return hi.view(np.int64), lo.view(np.int64), (tag | times << np.uint64(8)).view(np.int64), *mask


def _unpacked(tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mers, edge, times) of runs."""
    return (tag & 63) + 1, (tag >> 6) & 3, (tag >> 8) & 0xFFFFFF


def runs(reads: DataFrame, k: int, hot: list[int], drawn: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, tasks: int = 0) -> DataFrame:
    """The runs of all reads; ``drawn`` tells from read_ids and places in their reads which places are a sample.  With ``tasks``
    they are packed by the task that they go to, as (task, size, runs); see :func:`packed`."""
    m, most = M.minimizer_size(k - 1), np.array(sorted(hot), np.uint32)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            col = b.column(0).fill_null("").cast(pa.large_string())
            off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
            start = int(off[0])
            for codes, ends, _, last in M.pieces(col, k):
                sample = None
                if drawn is not None:
                    place = start + np.arange(len(codes))
                    row = np.searchsorted(off, place, "right") - 1
                    ids = b.column(1)
                    sample = drawn(ids.fill_null(0).to_numpy(zero_copy_only=False)[row], place - off[row]) & ids.is_valid().to_numpy(zero_copy_only=False)[row]
                start += len(codes) - (0 if last else k - 1)
                if (rows := cut(codes, ends, k, m, most, sample)) is not None:
                    yield rows

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in found(batches):
            yield pa.record_batch([pa.array(x) for x in rows], ["hi", "lo", "tag", "mask"][: len(rows)])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for rows in found(batches):
            held.append(rows)
            size += len(rows[0])
            if size >= PACKED:
                yield packed([np.concatenate(c) for c in zip(*held, strict=True)], tasks)
                held, size = [], 0
        if size:
            yield packed([np.concatenate(c) for c in zip(*held, strict=True)], tasks)

    some = reads.select("seq", *(["read_id"] if drawn else []))
    return some.mapInArrow(together, BLOBS) if tasks else some.mapInArrow(each, RUNS + ", mask long" * (drawn is not None))


def packed(rows: list[np.ndarray], tasks: int) -> pa.RecordBatch:
    """Runs as one row of BLOBS for each task: in the order of their minimizers, whose hashes are told by their differences, each
    column by its bytes, the highest ones together, and compressed."""
    bucket = rows[2].view(np.uint64) >> np.uint64(32)
    task = (bucket % np.uint64(tasks)).astype(np.int64)
    order = np.argsort(task.astype(np.uint64) << np.uint64(32) | bucket)
    task, bucket, rows = task[order], bucket[order], [c[order] for c in rows]
    step = _steps(bucket, task)
    rows[2] = (step << np.uint64(32) | rows[2].view(np.uint64) & np.uint64(0xFFFFFFFF)).view(np.int64)
    return _blobs(task, rows)


def _steps(key: np.ndarray, task: np.ndarray) -> np.ndarray:
    """Differences of keys in the order of (task, key)."""
    return np.where(np.append(True, task[1:] != task[:-1]), key, np.diff(key, prepend=key[:1]))


def _blobs(task: np.ndarray, rows: list[np.ndarray]) -> pa.RecordBatch:
    there, first = np.unique(task, return_index=True)
    cuts = np.append(first, len(task)).tolist()
    blobs = [pa.compress(b"".join(c[i:j].view(np.uint8).reshape(-1, 8).T.tobytes() for c in rows), "zstd", asbytes=True) for i, j in zip(cuts, cuts[1:])]
    return pa.record_batch([pa.array(there.astype(np.int32)), pa.array(np.diff(cuts).astype(np.int32)), pa.array(blobs, pa.binary())], names=["task", "size", "runs"])


def _opened(size: int, blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, 8 * size * columns, "zstd", asbytes=True), np.uint8).reshape(columns, 8, size)
    return [np.ascontiguousarray(c.T).view(np.int64)[:, 0] for c in raw]


def unpacked(size: int, blob: bytes, columns: int) -> list[np.ndarray]:
    """The runs of one row of :func:`packed`."""
    rows = _opened(size, blob, columns)
    tag = rows[2].view(np.uint64)
    rows[2] = (np.cumsum(tag >> np.uint64(32), dtype=np.uint64) << np.uint64(32) | tag & np.uint64(0xFFFFFFFF)).view(np.int64)
    return rows


def packed_halves(rows: list[np.ndarray], k: int, tasks: int) -> pa.RecordBatch:
    """Columns of HALVES as one row of BLOBS for each task, in the order of their codes, which are told by their differences."""
    order, _ = _groups(rows[0].view(np.uint64), 2 * k)
    task = (M._mix(rows[0][order].view(np.uint64)) % np.uint64(tasks)).astype(np.uint16 if tasks < 1 << 16 else np.int64)
    again = np.argsort(task, kind="stable")
    task, order = task[again], order[again]
    rows = [c[order] for c in rows]
    return _blobs(task, [_steps(rows[0], task), *rows[1:]])


def _met(halves: DataFrame, k: int, make: Callable[[list[np.ndarray]], list[np.ndarray]], schema: str) -> DataFrame:
    """What ``make`` gives for nodes whose two halves are rows of a written table of HALVES; these are packed by the task where
    they meet."""
    tasks = max(int(halves.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-halves.count() // PACKED))
    names = [c.split()[0] for c in schema.split(", ")]

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
            if size >= PACKED:
                yield packed_halves([np.concatenate(c) for c in zip(*held, strict=True)], k, tasks)
                held, size = [], 0
        if size:
            yield packed_halves([np.concatenate(c) for c in zip(*held, strict=True)], k, tasks)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_opened(n, blob, 6) for b in batches for n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if not held:
            return
        for rows in held:
            rows[0] = np.cumsum(rows[0])
        rows = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        order, first = _groups(rows[0].view(np.uint64), 2 * k)
        one = order[first]
        sides = [np.maximum.reduceat(c[order].view(np.uint64), first).view(np.int64) for c in rows[4:]]  # each half has one
        found = make([*(c[one] for c in rows[:4]), *sides])
        for i in range(0, len(found[0]), BATCH):
            yield pa.record_batch([pa.array(c[i : i + BATCH]) for c in found], names)

    columns = halves.select("code", "n", "f", "r", "right", "left")
    return columns.mapInArrow(together, BLOBS).repartitionById(tasks, "task").select("size", "runs").mapInArrow(each, schema)


def _expanded(hi: np.ndarray, lo: np.ndarray, tag: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer, flag, times) of the k-mers of runs."""
    n, edge, times = _unpacked(tag)
    row = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    end = i + k
    hi, lo = hi.view(np.uint64)[row], lo.view(np.uint64)[row]
    short = hi >> (64 - 2 * np.minimum(end, 32)).astype(np.uint64)
    long_ = lo >> (128 - 2 * np.maximum(end, 33)).astype(np.uint64) | np.where(end < 64, hi << np.clip(2 * end - 64, 0, 62).astype(np.uint64), np.uint64(0))
    x = np.where(end <= 32, short, long_) & np.uint64((1 << 2 * k) - 1)
    flag = np.full(len(row), 3)
    flag[(i == 0) & (edge[row] & 1 == 1)] = 2
    flag[(i == n[row] - 1) & (edge[row] & 2 == 2)] = 1
    return x, flag, times[row]


def _groups(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``key``, numbers of so many bits, and where its different values begin in that order."""
    below = np.uint64(max(1, len(key)).bit_length())
    if bits + int(below) <= 64:  # a place fits below its number, and numbers alone are sorted much faster
        both = np.sort(key << below | np.arange(len(key), dtype=np.uint64))
        key, order = both >> below, (both & ((np.uint64(1) << below) - np.uint64(1))).view(np.int64)
    else:
        order = np.argsort(key)
        key = key[order]
    return order, np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order


def parts(hi: np.ndarray, lo: np.ndarray, tag: np.ndarray, k: int, a_min: int, mask: np.ndarray | None = None) -> list[np.ndarray] | None:
    """The columns of PARTS from all runs of some minimizers: nodes, and halves of nodes with the end (1 or 2) that they know.
    With the runs' ``mask`` a last column has a node's places in the sample, on both strands."""
    x, flag, times = _expanded(hi, lo, tag, k)
    y = M.reversed_codes(x, k)
    ahead = x <= y
    flag = np.where(ahead, flag, (flag >> 1) | ((flag & 1) << 1))
    key = np.minimum(x, y) << np.uint64(2) | flag.astype(np.uint64)
    order, first = _groups(key, 2 * k + 2)
    if not len(first):
        return None
    f = np.add.reduceat(np.where(ahead, times, 0)[order], first)
    r = np.add.reduceat(times[order], first) - f
    key = key[order[first]]
    code, flag = key >> np.uint64(2), (key & np.uint64(3)).astype(np.int64)
    own = np.zeros(len(code), bool) if k % 2 else code == M.reversed_codes(code, k)  # none is its own reverse for odd k
    n = np.where(own, 2 * f, f + r)
    keep = n >= a_min
    draws = []
    if mask is not None:
        size = _unpacked(tag)[0]
        i = np.arange(len(times)) - np.repeat(np.cumsum(size) - size, size)
        draws = [np.add.reduceat(((np.repeat(mask, size) >> i & 1) * times)[order], first)[keep]]
    code, own, flag, n, f, r = code[keep], own[keep], flag[keep], n[keep], f[keep], r[keep]
    right, left = np.flatnonzero(flag & 2), np.flatnonzero((flag & 1 > 0) & ~own)
    sides = [np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)]
    z = np.concatenate([code[right], M.reversed_codes(code[left], k)])
    if len(z):
        o = z & np.uint64((1 << 2 * (k - 1)) - 1)
        p = M.reversed_codes(o, k - 1)
        lane = np.minimum(np.concatenate([n[right], n[left]]), CAP).astype(np.uint64) << (np.uint64(16) * (z >> np.uint64(2 * (k - 1))))
        order, first = _groups(np.minimum(o, p), 2 * k - 2)
        one = np.add.reduceat(np.where(o <= p, lane, np.uint64(0))[order], first)
        two = np.add.reduceat(np.where(o >= p, lane, np.uint64(0))[order], first)
        group = np.empty(len(z), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(z))))
        met = np.where(o <= p, two[group], one[group]).view(np.int64)
        sides[0][right], sides[1][left] = met[: len(right)], met[len(right) :]
    sides[1] = np.where(own, sides[0], sides[1])
    return [code.view(np.int64), n, f, r, *sides, flag.astype(np.int32), *draws]


def _large(reads: DataFrame, k: int) -> tuple[list[int], int]:
    """Minimizers with too many k-mers for a task, and the number of tasks, both from one of ONE_OF reads."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tag = b.column(0).to_numpy(zero_copy_only=False)
            n, _, times = _unpacked(tag)
            bucket, at = np.unique(tag >> 32, return_inverse=True)
            yield pa.record_batch([pa.array(bucket), pa.array(np.bincount(at, n * times).astype(np.int64))], ["bucket", "kmers"])

    # a filter goes below what makes reads of texts, so only texts that are looked at are coded
    # the filter goes below what makes reads of texts, so only texts that are looked at are coded
    some = runs(reads.where(F.rand(1) < 1 / ONE_OF), k, []).select("tag").mapInArrow(each, "bucket long, kmers long")
    sizes = durable(some.groupBy("bucket").agg(F.sum("kmers").alias("kmers")), "minimizers")
    tasks = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = (sizes.agg(F.sum("kmers")).first()[0] or 0) * ONE_OF
    limit = 4 * M.LEAST_HOT // ONE_OF  # what a task holds at once, whatever the number of tasks
    hot = [r["bucket"] & 0xFFFFFFFF for r in sizes.where(F.col("kmers") > limit).select("bucket").collect()]  # one for each 4 * LEAST_HOT k-mers at most
    return hot, max(tasks, -(-total // TASK))


def _in_tasks(reads: DataFrame, k: int, make: Callable[[list[np.ndarray]], list[np.ndarray] | None], schema: str, drawn: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """What ``make`` gives for all runs of some minimizers at a time, in the tasks that they are dealt to."""
    if not 2 <= k <= MOST_K:
        raise ValueError(f"packed nodes have 2 to {MOST_K} bases")
    hot, tasks = _large(reads, k)
    dealt = runs(reads, k, hot, drawn, tasks).repartitionById(tasks, "task").select("size", "runs")
    names = [c.split()[0] for c in schema.split(", ")]
    width = 3 + (drawn is not None)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpacked(n, blob, width) for b in batches for n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if not held:
            return
        rows = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        order, first = _groups(rows[2].view(np.uint64) >> np.uint64(32), 32)
        ends = np.append(first[1:], len(order))  # of minimizers, whose runs stay together
        kmers = np.cumsum(_unpacked(rows[2])[0][order])[ends - 1]
        done, at = 0, 0
        while at < len(ends):
            at = max(at + 1, int(np.searchsorted(kmers, (kmers[at - 1] if at else 0) + AT_ONCE, "right")))
            here = order[done : ends[at - 1]]
            done = int(ends[at - 1])
            found = make([c[here] for c in rows])
            if found is not None and len(found[0]):
                for i in range(0, len(found[0]), BATCH):
                    yield pa.record_batch([pa.array(c[i : i + BATCH]) for c in found], names)

    return dealt.mapInArrow(each, schema)


def nodes(reads: DataFrame, k: int, a_min: int) -> DataFrame:
    """(code, n, f, r, right, left) as :func:`strandsift.operators.bidirected.bidirected` has them, written once."""
    found = durable(_in_tasks(reads, k, lambda rows: parts(*rows, k, a_min), PARTS), "graph", "zstd")
    halves = _met(found.where("ends <> 3"), k, lambda rows: rows, HALVES)
    return found.where("ends = 3").drop("ends").unionAll(durable(halves, "halves", "zstd"))


def branching(reads: DataFrame, k: int, a: int) -> DataFrame:
    """(code, right, left): the nodes for one minimum abundance that aren't unary, with the degrees of their ends, in the form
    of a node's code and one number a side.  Unary nodes that are whole where they are counted don't leave their task, and a
    half is its code and one degree."""

    def each(rows: list[np.ndarray]) -> list[np.ndarray] | None:
        found = parts(*rows, k, a)
        if found is None:
            return None
        right, left = (sum((((v >> 16 * b) & 0xFFFF) >= a).astype(np.int8) for b in range(4)) for v in found[4:6])
        keep = (found[6] != 3) | (right != 1) | (left != 1)
        return [c[keep] for c in (found[0], right, left, found[6] == 3)]

    found = durable(_in_tasks(reads, k, each, "code long, right byte, left byte, whole boolean"), "branching", "zstd")
    halves = found.where("not whole").groupBy("code").agg(F.sum(F.expr("8S * right + left")).alias("both"))
    halves = halves.select("code", F.expr("cast(both div 8 as byte)").alias("right"), F.expr("cast(both % 8 as byte)").alias("left")).where("right <> 1 or left <> 1")
    return found.where("whole").drop("whole").unionAll(halves)


def alive(reads: DataFrame, k: int, a: int) -> DataFrame:
    """(code, n, sides) of the nodes for one minimum abundance, written once.  Bits 4 to 7 of sides tell which of the right
    end's lanes are nodes too, bits 0 to 3 those of the left end."""

    def each(rows: list[np.ndarray]) -> list[np.ndarray] | None:
        found = parts(*rows, k, a)
        return None if found is None else [found[0], found[1], _masks(found[4], found[5], a), found[6]]

    found = durable(_in_tasks(reads, k, each, ALIVE), "graph", "zstd")
    halves = found.where("ends <> 3").groupBy("code").agg(F.max("n").alias("n"), F.sum("sides").cast("int").alias("sides"))
    return found.where("ends = 3").drop("ends").unionAll(durable(halves, "halves", "zstd"))


def _masks(right: np.ndarray, left: np.ndarray, a: int) -> np.ndarray:
    """The sides of :func:`alive`; of the two halves of a node each has the bits of its own side."""
    return sum((((v >> 16 * b) & 0xFFFF) >= a).astype(np.int32) << (b + first) for v, first in ((right, 4), (left, 0)) for b in range(4))


def summed(code: np.ndarray, n: np.ndarray, f: np.ndarray, r: np.ndarray, right: np.ndarray, left: np.ndarray, k: int, a_min: int, a_max: int) -> list[np.ndarray]:
    """The columns of SUMS of whole nodes."""
    x = code.view(np.uint64)
    same = x == M.reversed_codes(x, k)
    forward, reverse = f / n, r / n
    lanes = [[(v >> 16 * b) & 0xFFFF for b in range(4)] for v in (right, left)]
    rows = []
    for a in range(a_min, a_max + 1):
        alive = np.flatnonzero(n >= a)
        dr, dl = (sum((lane[alive] >= a).astype(np.int64) for lane in side) for side in lanes)
        kind = 5 * dr + dl
        count = np.bincount(kind, minlength=25)
        here = np.flatnonzero(count)
        total = lambda w: np.bincount(kind, w[alive], 25)[here]
        rows.append((np.full(len(here), a), here // 5, here % 5, count[here], total(same).astype(np.int64), total((f + r) / n), total(forward), total(reverse)))
    return [np.concatenate(c).astype(np.float64 if i > 4 else np.int32 if i < 3 else np.int64) for i, c in enumerate(zip(*rows, strict=True))]


def degree_sums(reads: DataFrame, k: int, a_min: int, a_max: int) -> DataFrame:
    """(a, dr, dl, nodes, same, share, forward, reverse): by the degrees of their right and left ends, how many nodes there
    are for each minimum abundance, how many of them are their own reverse complement, and the sums of (f + r) / n, f / n and
    r / n over them.  Nodes are summed in the tasks that count them; only halves of nodes are written."""
    names = [c.split()[0] for c in SUMS.split(", ")]

    def each(rows: list[np.ndarray]) -> list[np.ndarray] | None:
        found = parts(*rows, k, a_min)
        if found is None:
            return None
        whole = found[6] == 3
        sums = summed(*(c[whole] for c in found[:6]), k, a_min, a_max)
        halves = [c[~whole] for c in found[:6]]
        for side in (4, 5):  # no more of a lane is told apart than the sums ask for
            halves[side] = sum(np.minimum((halves[side] >> 16 * b) & 0xFFFF, a_max) << 16 * b for b in range(4))
        zeros = lambda c, n: np.zeros(n, c.dtype)
        none = np.full(len(halves[0]), -1, np.int32)
        cols = [np.concatenate([h, zeros(h, len(sums[0]))]) for h in halves]
        return cols + [np.concatenate([none if i == 0 else zeros(s, len(none)), s]) for i, s in enumerate(sums)]

    found = durable(_in_tasks(reads, k, each, f"{HALVES}, {SUMS}"), "sums", "zstd")
    rest = _met(found.where("a = -1"), k, lambda rows: summed(*rows, k, a_min, a_max), SUMS)
    every = found.where("a <> -1").select(*names).unionAll(rest)
    return every.groupBy("a", "dr", "dl").agg(*(F.sum(c).alias(c) for c in names[3:]))


def sampled_sums(reads: DataFrame, k: int, a_max: int, drawn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(a, draws, nodes, internal) for a from 1 to ``a_max``: the places of the sample (see :func:`runs`) whose k-mers are nodes,
    and the sums of one over the abundance over them and over those of unary nodes.

    Draws go along with the runs as bits, so no single k-mer is shuffled to meet the graph; halves of nodes that aren't drawn
    stay in their task, and of a side only for which a it has one neighbour is told.
    """

    def summed_draws(n: np.ndarray, draws: np.ndarray, right: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
        w, one = draws / n, right & left
        rows = [(a, draws[up].sum(), w[up].sum(), w[up & ((one >> a & 1) == 1)].sum()) for a in range(1, a_max + 1) for up in (n >= a,)]
        return [np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.int32, np.int64, np.float64, np.float64), strict=True)]

    def each(rows: list[np.ndarray]) -> list[np.ndarray] | None:
        found = parts(*rows[:3], k, 1, rows[3])
        if found is None:
            return None
        code, n, _, _, right, left, ends, draws = (c[found[7] > 0] for c in found)
        one = lambda v: sum((sum((((v >> 16 * b) & 0xFFFF) >= a).astype(np.int64) for b in range(4)) == 1).astype(np.int64) << a for a in range(1, a_max + 1))
        cols = [code, n, draws, one(right), one(left)]
        sums = summed_draws(*(c[ends == 3] for c in cols[1:]))
        halves = [c[ends != 3] for c in cols]
        count = len(halves[0])
        padded = [np.append(c, np.zeros(a_max, c.dtype)) for c in halves]
        return padded + [np.append(np.full(count, -1 if i == 0 else 0, s.dtype), s) for i, s in enumerate(sums)]

    names = "a int, draws long, nodes double, internal double"
    found = durable(_in_tasks(reads, k, each, f"code long, n long, times long, right long, left long, {names}", drawn), "sums", "zstd")
    halves = found.where("a = -1").groupBy("code").agg(*(F.max(c).alias(c) for c in ("n", "times", "right", "left"))).drop("code")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sums = summed_draws(*(c.to_numpy(zero_copy_only=False) for c in b.columns))
                yield pa.record_batch([pa.array(c) for c in sums], ["a", "draws", "nodes", "internal"])

    every = found.where("a <> -1").select("a", "draws", "nodes", "internal").unionAll(halves.mapInArrow(rest, names))
    return every.groupBy("a").agg(*(F.sum(c).alias(c) for c in ("draws", "nodes", "internal")))


def census(sums: DataFrame) -> DataFrame:
    """:func:`strandsift.operators.bidirected.census` from :func:`degree_sums`."""
    return sums.groupBy("a").agg(
        F.sum("share").alias("nodes"),
        F.expr("sum(if(dr = 1 and dl = 1, share, 0D))").alias("internal"),
        F.expr("sum(case when dr = 1 and dl = 1 then 0D when dr = 0 and dl = 0 then share else forward * dr + reverse * dl end)").alias("unitigs"),
    )


def exact_counts(sums: DataFrame) -> DataFrame:
    """:func:`strandsift.operators.bidirected.exact_counts` from :func:`degree_sums`."""
    return sums.groupBy("a").agg(F.sum("nodes").alias("nodes"), F.floor(F.sum(F.expr("nodes * (dr + dl)")) / 2).cast("long").alias("arcs"))


def degree_counts(sums: DataFrame) -> DataFrame:
    """(a, din, dout, nodes) of both orientations, a palindrome once, from :func:`degree_sums`."""
    both = F.explode(F.expr("array(struct(dl as din, dr as dout, nodes as nodes), struct(dr as din, dl as dout, nodes - same as nodes))"))
    return sums.select("a", both.alias("e")).select("a", "e.*").where("nodes > 0").groupBy("a", "din", "dout").agg(F.sum("nodes").alias("nodes"))


def distinct_kmers(reads: DataFrame, ks: list[int]) -> DataFrame:
    """(k, kmers): distinct k-mers on both strands for each k, counted inside tasks; nothing is written but the sums."""

    def number(k: int) -> DataFrame:
        def counted(rows: list[np.ndarray]) -> list[np.ndarray]:
            x, flag, _ = _expanded(*rows, k)
            y = M.reversed_codes(x, k)
            first = np.where(x <= y, flag & 1, flag >> 1) == 1  # of the two halves of a k-mer one counts
            x = np.unique(np.minimum(x, y)[first])
            return [np.array([2 * len(x) - int((x == M.reversed_codes(x, k)).sum())])]

        return _in_tasks(reads, k, counted, "kmers long")

    out = None
    for k in ks:
        one = number(k).agg(F.coalesce(F.sum("kmers"), F.lit(0)).cast("long").alias("kmers")).select(F.lit(k).alias("k"), "kmers")
        out = one if out is None else out.unionAll(one)
    return out
