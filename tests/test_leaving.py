"""What leaves the tasks that count nodes: only what a query asks of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandsift.functions import packed as P
from strandsift.operators import bidirected as D
from strandsift.operators import linked as L
from strandsift.operators import superkmers as S
from strandsift.plans import estimate as E
from strandsift.storage import durable


@pytest.fixture
def written(monkeypatch):
    tables = {}

    def kept(df, name="table", codec=None):
        tables[name] = durable(df, name, codec)
        return tables[name]

    monkeypatch.setattr(L, "durable", kept)
    return tables


def some(spark, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(3000))
    seqs = [base[rng.randrange(2900) :][: rng.randrange(400)] for _ in range(30)] + ["A" * 70, "ACGT" * 12, "", base]
    ids = [None if i == 3 else i * 37 for i in range(len(seqs))]
    return spark.createDataFrame(list(zip(ids, seqs, strict=True)), "read_id long, seq string").repartition(3)


@pytest.mark.parametrize("k, least", [(6, 1 << 20), (15, 8)])
def test_unary_nodes_stay_in_their_task(spark, monkeypatch, written, k, least):
    monkeypatch.setattr(S, "LEAST_HOT", least)
    reads = some(spark, k)
    want = D.degrees(E.packed_graph(reads, k, 2), k, 2, 2).where("not (din = 1 and dout = 1)").select("a", P.spelled("x", k).alias("kmer"), "din", "dout").collect()
    got = D.spelled_degrees(L.branching(reads, k, 2), k, 2).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert written["branching"].where("whole and right = 1 and left = 1").count() == 0
    assert sum(len(r.dataType.simpleString()) > 7 for r in written["branching"].schema) == 0  # a code and small numbers


@pytest.mark.parametrize("k, least, segment, at_once", [(6, 1 << 20, 100, 50), (15, 8, 1 << 20, 1 << 20)])
def test_draws_go_with_the_runs(spark, monkeypatch, written, k, least, segment, at_once):
    monkeypatch.setattr(S, "LEAST_HOT", least)
    monkeypatch.setattr(S, "SEGMENT", segment)
    monkeypatch.setattr(L, "AT_ONCE", at_once)
    reads = some(spark, k)
    drawn = {}
    for r in reads.collect():
        for pos in range(len(r["seq"]) - k + 1):
            if r["read_id"] is not None and (r["read_id"] * 7 + pos * 3) % 10 < 2:
                drawn[r["seq"][pos : pos + k]] = drawn.get(r["seq"][pos : pos + k], 0) + 1
    nodes = D.degrees(E.packed_graph(reads, k, 1), k, 1, 3).select("a", P.spelled("x", k).alias("kmer"), "n", F.expr("din = 1 and dout = 1").alias("unary")).collect()
    want = {}
    for a, kmer, n, unary in nodes:
        if m := drawn.get(kmer):
            old = want.get(a, (0, 0.0, 0.0))
            want[a] = (old[0] + m, old[1] + m / n, old[2] + (m / n if unary else 0))
    got = {r["a"]: tuple(r)[1:] for r in L.sampled_sums(reads, k, 3, lambda i, pos: (i * 7 + pos * 3) % 10 < 2).collect()}
    assert set(want) == {1, 2, 3} and all(got[a] == pytest.approx(want[a]) for a in want)
    assert written["sums"].where("a = -1 and times = 0").count() == 0


def test_overlaps_of_hot_minimizers_are_still_runs():
    """There was a row for each of their k-mers before."""
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 4, 20_000).astype(np.uint8)
    m = S.minimizer_size(14)
    tag = L.cut(codes, np.full(len(codes), len(codes)), 15, m, np.array([], np.uint32))[2]
    every = L.cut(codes, np.full(len(codes), len(codes)), 15, m, np.unique(tag >> 32).astype(np.uint32))
    assert len(every[2]) < len(codes) / 2
    nodes = [{tuple(r) for r in zip(*(c[(p[6] & 2) > 0] for c in p[:4]), strict=True)} for p in (L.parts(*every, 15, 1),)]
    assert sum(r[2] + r[3] for r in nodes[0]) == len(codes) - 14
