"""Packed k-mers and bidirected graphs against plain Python and the graphs of strings."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandsift.functions import packed as P
from strandsift.operators import allk as A
from strandsift.operators import bidirected as D
from strandsift.operators import superkmers as S
from strandsift.operators import unitigs as U
from strandsift.plans import estimate as E

PAIR = dict(zip("ACGTN", "TGCAN", strict=True))


def rc(s):
    return "".join(PAIR[c] for c in reversed(s))


def reads(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


def some_reads(seed, n=40, size=120, letters="ACGT"):
    rng = random.Random(seed)
    base = "".join(rng.choice(letters) for _ in range(400))
    out = []
    for _ in range(n):
        i = rng.randrange(300)
        s = list(base[i : i + rng.randrange(1, size)])
        if s and rng.random() < 0.4:
            s[rng.randrange(len(s))] = rng.choice("ACGTN")
        s = "".join(s)
        out.append(rc(s) if rng.random() < 0.3 else s)
    return [*out, "", None, "ACGTACGTACGTACGTACGTACGTACGTACGTACGT", "A" * 200, "ANA"]


def counted(seqs, k):
    c = Counter(s[i : i + k] for s in seqs if s for i in range(len(s) - k + 1))
    return {x: n for x, n in c.items() if set(x) <= set("ACGT")}


@pytest.mark.parametrize("k", [1, 7, 31])
def test_expressions(spark, k):
    rng = random.Random(k)
    rows = [("".join(rng.choice("ACGT") for _ in range(k)),) for _ in range(60)] + [("A" * k,), ("T" * k,)]
    df = spark.createDataFrame(rows, "kmer string").withColumn("x", P.packed("kmer")).withColumn("size", F.lit(k))
    one, two = P.with_reverse(df, "x", k, "y"), P.with_reverse(df, "x", "size", "y")
    for found in (one, two):
        got = found.select("kmer", "x", P.spelled("x", k).alias("back"), P.spelled("y", k).alias("r"), P.last_base("x").alias("last")).collect()
        assert all(r["back"] == r["kmer"] and r["r"] == rc(r["kmer"]) and r["last"] == r["kmer"][-1] for r in got)
        assert [r["kmer"] for r in sorted(got, key=lambda r: r["x"])] == sorted(x for (x,) in rows)


def test_lanes(spark):
    lanes = [[0, 5, 2, 5], [P.CAP, 0, 0, P.CAP], [0, 0, 0, 0], [3, 1, 4, 2]]
    df = spark.createDataFrame([(sum(n << 16 * b for b, n in enumerate(x)), x) for x in lanes], "v long, x array<int>")
    got = df.select("x", F.expr(P.top("v")).alias("t"), F.expr(P.second("v")).alias("s"), F.expr(P.top_lane("v")).alias("b"), F.expr(P.degree("v", "2")).alias("d")).collect()
    for r in got:
        assert (r["t"], r["s"], r["b"], r["d"]) == (max(r["x"]), sorted(r["x"])[-2], r["x"].index(max(r["x"])), sum(n >= 2 for n in r["x"]))


@pytest.mark.parametrize("k", [1, 8, 15, 31])
def test_counts(spark, k):
    seqs = some_reads(k)
    want = counted(seqs, k)
    rows = S.canonical_counts(reads(spark, seqs).repartition(3), k).select(P.spelled("code", k).alias("x"), "f", "r").collect()
    assert len(rows) == len({min(x, rc(x)) for x in want})
    assert {(r["x"], r["f"], r["r"]) for r in rows} == {(c, want.get(c, 0), 0 if c == rc(c) else want.get(rc(c), 0)) for c in {min(x, rc(x)) for x in want}}


def test_counts_with_hot_minimizers_and_small_segments(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST_HOT", 50)
    seqs = some_reads(3) + ["ACGTTGCA" * 30] * 40
    want = counted(seqs, 13)
    rows = S.canonical_counts(reads(spark, seqs), 13).select(P.spelled("code", 13).alias("x"), "f", "r").collect()
    assert sum(r["f"] + r["r"] for r in rows) == sum(want.values()) and len(rows) == len({min(x, rc(x)) for x in want})


def test_super_kmers_are_few_and_whole(spark):
    """The k-mers of the runs, cut out in Python, are those of the reads, across the ends of segments too."""
    rng = random.Random(8)
    seq = "".join(rng.choice("ACGT") for _ in range(5000))
    codes = S.CODES[np.frombuffer(seq.encode(), np.uint8)]
    bucket, hi, lo, n, times = S.cut(codes, np.full(len(seq), len(seq)), 31, 13)
    found = Counter()
    for h, low, c, t in zip(hi, lo, n, times, strict=True):
        s = "".join("ACGT"[int(v) >> 2 * j & 3] for v in (h, low) for j in range(31, -1, -1))
        found.update({s[i : i + 31]: int(t) for i in range(c)})
    assert found == Counter(seq[i : i + 31] for i in range(len(seq) - 30))
    assert len(n) < len(seq) / 6
    S_SEG = 700
    old, S.SEGMENT = S.SEGMENT, S_SEG
    try:
        import pyarrow as pa

        pieces = list(S.pieces(pa.array([seq, None, "ACG", seq[:900]]), 31))
    finally:
        S.SEGMENT = old
    total = sum(len(S.whole_windows(c, e, 31)) for c, e, _, _ in pieces)
    assert total == len(seq) - 30 + 870


def shown(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("k, seed", [(2, 1), (5, 3), (12, 5)])
def test_graphs_equal_those_of_strings(spark, k, seed):
    r = reads(spark, some_reads(seed)).repartition(2)
    lo, hi = 1, 4
    old = E.graph(r, k, lo, hi)
    nodes = E.packed_graph(r, k, lo)
    new = D.degrees(nodes, k, lo, hi).select("a", P.spelled("x", k).alias("kmer"), "n", "m", "din", "dout")
    assert shown(new, "a", "kmer", "n", "m", "din", "dout") == shown(old.fillna(0, ["m"]), "a", "kmer", "n", "m", "din", "dout")
    found, ends = D.all_walks(nodes, k, lo, hi)
    strings = U.unitigs(old, k)
    assert shown(D.unitigs(found, ends, k), "a", "seq") == shown(strings, "a", "seq")
    sizes = strings.groupBy("a", F.length("seq").alias("size")).agg(F.count("*").alias("times"))
    assert shown(D.unitig_sizes(found, k), "a", "size", "times") == shown(sizes, "a", "size", "times")
    one = {x["a"]: (x["unitigs"], x["e_size"]) for x in U.e_size(U.census_lengths(old, k), k).collect()}
    two = {x["a"]: (x["unitigs"], x["e_size"]) for x in U.e_size(D.census_lengths(nodes, found, lo, hi), k).collect()}
    assert one.keys() == two.keys() and all(one[a] == pytest.approx(two[a]) for a in one)
    # a row of the pointers stands for a range of a
    assert ends.count() <= ends.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] if ends.count() else True


def test_edges(spark):
    from strandsift.operators import graph as G

    r = reads(spark, some_reads(9))
    old, nodes = E.graph(r, 7, 1, 2), E.packed_graph(r, 7, 1)
    for side, pair in (("outs", ("a", "src", "dst")), ("ins", ("a", "dst", "src"))):
        new = D.successors(nodes, 7, 1, 2, side).select("a", P.spelled("x", 7).alias("x"), P.spelled("y", 7).alias("y"))
        assert shown(new, "a", "x", "y") == shown(G.edges(old, 7), *pair)


def test_empty_reads(spark):
    r = spark.createDataFrame([], "read_id long, seq string")
    nodes = E.packed_graph(r, 15, 1)
    assert nodes.count() == 0
    found, ends = D.all_walks(nodes, 15, 1, 3)
    assert found.count() == 0 and D.unitigs(found, ends, 15).count() == 0


@pytest.mark.parametrize("lo, hi, segment", [(1, 6, 1 << 20), (3, 31, 1 << 20), (15, 20, 64), (9, 9, 100)])
def test_counts_for_all_k(spark, monkeypatch, lo, hi, segment):
    monkeypatch.setattr(S, "SEGMENT", segment)
    seqs = [*some_reads(lo), "".join(random.Random(4).choice("ACGT") for _ in range(900))]
    rows = A.all_k_counts(reads(spark, seqs), lo, hi).collect()
    want = set()
    for k in range(lo, hi + 1):
        c = counted(seqs, k)
        want |= {(k, x, c.get(x, 0), 0 if x == rc(x) else c.get(rc(x), 0)) for x in {min(x, rc(x)) for x in c}}
    assert len(rows) == len(want)
    assert {(r["k"], "".join("ACGT"[r["code"] >> 2 * j & 3] for j in range(r["k"] - 1, -1, -1)), r["f"], r["r"]) for r in rows} == want


def test_common_prefixes():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ACGT") for _ in range(rng.randrange(3, 32))) for _ in range(300)} | {"A" * 31, "A" * 30, "T" * 31}, key=lambda s: (s.ljust(31, "A"), len(s)))
    x = np.array([sum("ACGT".index(c) << 2 * (30 - i) for i, c in enumerate(s)) for s in words], np.uint64)
    got = A.common_prefixes(x, np.array([len(s) for s in words]), 31)
    want = [-1] + [next((i for i, (a, b) in enumerate(zip(s, t)) if a != b), min(len(s), len(t))) for s, t in zip(words, words[1:])]  # noqa: B905
    assert got.tolist() == want


def test_landscape_of_all_k_equals_that_of_each(spark):
    r = reads(spark, some_reads(12))
    cols = ("k", "a", "nr_nodes", "avg_internal_nodes", "avg_length_unitigs", "nr_unitigs")
    one = {x[:2]: x[2:] for x in shown(E.all_k_census(r, 4, 9, 1, 3), *cols)}
    two = {x[:2]: x[2:] for x in shown(E.census_landscape(r, list(range(4, 10)), 1, 3, with_e_size=False), *cols)}
    assert one.keys() == two.keys() and all(one[i] == pytest.approx(two[i]) for i in one)
