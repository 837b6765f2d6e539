"""The path through every node of a graph of packed k-mers, for one minimum abundance.

The rows are those of :func:`strandsift.operators.unitigs.older_statistics`.  All nodes between two nodes that aren't unary
have the same path, so tasks join unary nodes to segments first, a row for each with its nodes as a list.  Pointers are
doubled over segments, whose lists stay where they are written until the sums of their paths are known, and a list stands for
both strands.  Neighbours of other nodes are read off their lanes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import packed as P
from ..storage import durable
from . import bidirected as D
from . import superkmers as M

#: Unary nodes that a task joins at once.
AT_ONCE = 1 << 20
#: Files of a table of few rows.
FILES = 2
SEGMENTS = "x long, id long, tip long, hops long, mass long, nodes array<long>, circle boolean"
UNARY = "bit_count(sides & 15) = 1 and bit_count(sides & 240) = 1"
ROWS = "x long, nodes long, total double"


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.view(np.int64)))


def segments(code: np.ndarray, n: np.ndarray, sides: np.ndarray, k: int) -> pa.RecordBatch:
    """The columns of SEGMENTS from some unary nodes, in both directions: a segment's first node, the lesser of that and the
    first one of its reverse complement, the node ahead of it, its size and sum of abundances, and its nodes where the first
    one is the lesser.  A circle that is whole here is a row with all its nodes."""
    code = code.view(np.uint64)
    back = M.reversed_codes(code, k)
    twice = code != back
    lane = np.zeros(256, np.uint64)
    lane[[1, 2, 4, 8]] = np.arange(4)
    x = np.concatenate([code, back[twice]])
    order = np.argsort(x)
    x, w = x[order], np.concatenate([n, n[twice]])[order]
    lanes = np.concatenate([lane[sides >> 4], lane[sides & 15][twice]])[order]
    ahead = (x & np.uint64((1 << 2 * (k - 1)) - 1)) << np.uint64(2) | (np.uint64(3) - lanes)
    at = np.minimum(np.searchsorted(x, ahead), len(x) - 1)
    linked = x[at] == ahead
    first = np.ones(len(x), bool)
    first[at[linked]] = False
    first = np.flatnonzero(first)
    to, hops, mass = np.where(linked, at, np.arange(len(x))), linked.astype(np.int64), np.where(linked, w, 0)
    while linked[to[first]].any():
        hops, mass = hops + hops[to], mass + mass[to]
        to = to[to]
    last = to[first]
    id_ = np.minimum(x[first], M.reversed_codes(x[last], k))
    own = id_ == x[first]
    # nodes of the listed segments, by segment and in its order
    row = np.full(len(x), -1)
    row[last[own]] = np.flatnonzero(own)
    i = np.flatnonzero(~linked[to])
    i = i[row[to[i]] >= 0]
    i = i[np.lexsort((-hops[i], row[to[i]]))]
    size = hops[first] + 1
    # circles: every node takes the least number on its way round
    c = np.flatnonzero(linked[to])
    label, step = np.arange(len(x)), at.copy()
    for _ in range(math.ceil(math.log2(len(c))) + 1 if len(c) else 0):
        label[c] = np.minimum(label[c], label[step[c]])
        step[c] = step[step[c]]
    c = c[np.argsort(label[c], kind="stable")]
    heads, begin, round_ = np.unique(label[c], return_index=True, return_counts=True)
    around = np.add.reduceat(w[c], begin) if len(c) else np.zeros(0, np.int64)
    both = lambda p, q: pa.array(np.concatenate([p, q]).astype(np.int64))
    cols = [
        both(x[first].view(np.int64), x[heads].view(np.int64)), both(id_.view(np.int64), x[heads].view(np.int64)), both(ahead[last].view(np.int64), ahead[heads].view(np.int64)), both(size, round_),
        both(mass[first] + w[last], around), _lists(np.concatenate([x[i], x[c]]), np.concatenate([np.where(own, size, 0), round_])), pa.array(np.arange(len(first) + len(heads)) >= len(first)),
    ]
    return pa.record_batch(cols, [f.split()[0] for f in SEGMENTS.split(", ")])


def joined(unary: DataFrame, k: int, tasks: int) -> DataFrame:
    """:func:`segments` of (code, n, sides), dealt by short minimizers, which neighbours mostly share."""
    m = min(k, D.SHORT)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(D.short_minimizers(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), k, m)), *b.columns], ["key", "code", "n", "sides"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
            size += b.num_rows
            if size >= AT_ONCE:  # a minimizer may go on: segments are cut there
                yield segments(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
                held, size = [], 0
        if size:
            yield segments(*(np.concatenate(c) for c in zip(*held, strict=True)), k)

    dealt = unary.select("code", "n", "sides").mapInArrow(keyed, "key int, code long, n long, sides int").repartition(tasks, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(each, SEGMENTS)


def ahead(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For written segments that aren't circles: (x, id, tip, hops, mass) with the first node ahead that isn't unary, the steps
    to it and the sum of the unary nodes before it; and (id, hops, mass) of the circles of several segments, in one direction."""

    def written(rows: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        table = durable(rows.observe(seen, F.count_if("open").alias("open")), "paths", "zstd")
        return table, seen.get["open"]

    every = made.where("not circle").drop("nodes", "circle")
    unary = every.select(F.col("x").alias("tip"), F.lit(True).alias("open"))
    state, left = written(every.join(unary, "tip", "left").select("x", "id", "tip", "hops", "mass", F.coalesce("open", F.lit(False)).alias("open"), F.col("x").alias("label")))
    found = state.where("not open")
    rounds, more, few = 0, 64, None
    while left and rounds < more:
        ask = state.where("open")
        if left <= D.FEW and few is None:  # from now on only these rows and those they point to are read
            few = durable(found.join(F.broadcast(ask.select(F.col("tip").alias("x")).distinct()), "x", "left_semi").select(*found.columns).coalesce(FILES), "few", "zstd")
        known = (found if few is None else few).unionAll(ask)
        look = known.select(F.col("x").alias("tip"), F.col("tip").alias("t"), F.col("hops").alias("h"), F.col("mass").alias("w"), F.col("open").alias("o"), F.col("label").alias("l"))
        met = (F.broadcast(ask) if few is not None else ask).drop("open").join(look, "tip")
        moved = met.select("x", "id", F.col("t").alias("tip"), F.expr("hops + h").alias("hops"), F.expr("mass + w").alias("mass"), F.col("o").alias("open"), F.least("label", "l").alias("label"))
        before = left
        state, left = written(moved if few is None else moved.coalesce(FILES))
        done = state.where("not open")
        found, few = found.unionAll(done), few if few is None else few.unionAll(done)
        rounds += 1
        if left == before and more == 64:  # only circles are left: a window must reach round the longest
            more = rounds + math.ceil(math.log2(max(2, left))) + 1
    found = found.drop("open", "label")
    if not left:
        return found, found.select("id", "hops", "mass").where("false")
    circles = state.where("open").select("x", "id", "label")
    sums = circles.join(every.select("x", "hops", "mass"), "x").groupBy("label").agg(F.sum("hops").alias("hops"), F.sum("mass").alias("mass"))
    return found, circles.where("x = id").join(sums, "label").select("id", "hops", "mass")


def _listed(rows: DataFrame, k: int) -> DataFrame:
    """ROWS for each node of the lists of (both, nodes, size, total), and for its reverse complement where ``both``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                both, nodes, size, total = b.slice(i, 1000).columns
                row = np.repeat(np.arange(len(nodes)), nodes.value_lengths().to_numpy(zero_copy_only=False))
                x = nodes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                twice = both.to_numpy(zero_copy_only=False)[row]
                x, row = np.append(x, M.reversed_codes(x[twice], k)), np.append(row, row[twice])
                at = pa.array(row)
                yield pa.record_batch([pa.array(x.view(np.int64)), size.take(at), total.take(at)], ["x", "nodes", "total"])

    return rows.select("both", "nodes", "size", "total").mapInArrow(run, ROWS)


def _branching(nodes: DataFrame, k: int, a: int) -> DataFrame:
    """(x, share, id, w0 .. w7) of nodes that are neither unary nor isolated, in both directions: their abundance over their
    number of edges, and their names and those of their neighbours, four after and four before, null where there is none."""
    names = [f"w{i}" for i in range(8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, n, sides = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            back = M.reversed_codes(code.view(np.uint64), k).view(np.int64)
            twice = code != back
            x, n = np.append(code, back[twice]), np.append(n, n[twice])
            outs, ins = np.append(sides >> 4, (sides & 15)[twice]), np.append(sides & 15, (sides >> 4)[twice])
            bits = [outs >> 3 - c & 1 for c in range(4)] + [ins >> c & 1 for c in range(4)]  # lanes after a node are numbered from the other strand
            there = [D.after(x, c, k) for c in range(4)] + [D.before(x, c, k) for c in range(4)]
            cols = [pa.array(x), pa.array(n / sum(bits)), named(x, k, a)]
            yield pa.record_batch(cols + [named(y, k, a, bit == 0) for y, bit in zip(there, bits, strict=True)], ["x", "share", "id", *names])

    return nodes.where(f"sides <> 0 and not ({UNARY})").select("code", "n", "sides").mapInArrow(run, f"x long, share double, id string, {', '.join(f'{c} string' for c in names)}")


def named(x: np.ndarray, k: int, a: int, none: np.ndarray | None = None) -> pa.Array:
    """The strings ``a:kmer``."""
    head = np.frombuffer(f"{a}:".encode(), np.uint8)
    letters = D.letters(x, k)
    whole = D.strings(np.concatenate([np.broadcast_to(head, (len(x), len(head))), letters], 1), np.full(len(x), k + len(head)))
    return whole if none is None else pa.compute.if_else(pa.array(none), pa.scalar(None, pa.string()), whole)


def statistics(nodes: DataFrame, k: int, a: int, seed: int = 1) -> DataFrame:
    """(a, kmer, nodes, total) for every node of :func:`strandsift.operators.linked.alive`, both directions."""
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // D.TASK))
    made = durable(joined(nodes.where(UNARY), k, tasks), "segments", "zstd")
    found, circles = ahead(made)
    # the node that ends each segment's path, and what nodes that aren't unary give to a path that they end
    names = [f"w{i}" for i in range(8)]
    least = F.least(*(F.when(F.col(c).isNotNull(), F.struct(F.xxhash64(F.lit(seed), "id", c, F.lit(i // 4)).alias("h"), F.lit(i).alias("i"))) for i, c in enumerate(names)))
    picked = _branching(nodes, k, a).withColumn("i", least["i"])
    to = f"if(i < 4, {P.suffix('x', k)} << 2 | i, cast(i - 4 as long) << {2 * (k - 1)} | x >> 2)"
    picked = P.with_reverse(picked.select("x", "share", "i", F.expr(to).alias("to")), "to", k, "back")
    rest = durable(picked.select("x", "share", F.expr("if(i < 4, to, back)").alias("y")), "branching", "zstd")
    share = rest.select(F.col("x").alias("tip"), F.col("share").alias("end"))
    reach = durable(found.join(share, "tip").drop("tip"), "reach", "zstd")
    side = lambda own, c: F.max(F.expr(f"if(x {'=' if own else '<>'} id, {c}, null)"))
    both = reach.groupBy("id").agg(
        side(True, "hops").alias("h1"), side(False, "hops").alias("h2"), side(True, "mass").alias("m1"), side(False, "mass").alias("m2"), side(True, "end").alias("e1"), side(False, "end").alias("e2")
    )
    # a segment that is its own reverse complement has one row
    sums = both.select("id", F.expr("h1 + coalesce(h2, h1)").alias("h"), F.expr("m1 + coalesce(m2, m1)").alias("m"), "e1", F.expr("coalesce(e2, e1)").alias("e2"), F.col("h2").isNotNull().alias("both"))
    lists = made.where("not circle and x = id")
    lists = lists.select("id", "nodes", F.col("hops").alias("size"), F.col("mass").alias("w"))
    paths = lists.join(sums, "id").select("both", "nodes", F.expr("h - size + 2").alias("size"), F.expr("m - w + e1 + e2").alias("total"))
    whole = made.where("circle").select(F.lit(False).alias("both"), "nodes", F.expr("if(x = tip, 2, hops)").cast("long").alias("size"), F.col("mass").cast("double").alias("total"))
    round_ = lists.drop("size").join(circles, "id").select(F.lit(True).alias("both"), "nodes", F.col("hops").alias("size"), F.col("mass").cast("double").alias("total"))
    unary = _listed(paths.unionAll(whole).unionAll(round_), k)
    ends = reach.select(F.col("x").alias("y"), "hops", (F.col("mass") + F.col("end")).alias("stop"))
    ends = ends.unionAll(rest.select(F.col("x").alias("y"), F.lit(0).cast("long").alias("hops"), F.col("share").alias("stop")))
    others = rest.join(ends, "y").select("x", (F.col("hops") + 2).alias("nodes"), (F.col("share") + F.col("stop")).alias("total"))
    alone = P.with_reverse(nodes.where("sides = 0"), "code", k, "back").select(F.explode(F.expr("if(code = back, array(code), array(code, back))")).alias("x"), F.lit(1).cast("long").alias("nodes"), F.col("n").cast("double").alias("total"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(np.full(len(x), a, np.int32)), D.strings(D.letters(x, k), np.full(len(x), k)), b.column(1), b.column(2)], ["a", "kmer", "nodes", "total"])

    return unary.unionAll(others).unionAll(alone).mapInArrow(spell, "a int, kmer string, nodes long, total double")
