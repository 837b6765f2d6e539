"""Graphs from one shuffle of runs against those of counted k-mers, with minimizers of any size."""

import random

import numpy as np
import pytest

from strandsift.functions import packed as P
from strandsift.operators import bidirected as D
from strandsift.operators import graph as G
from strandsift.operators import kmers as K
from strandsift.operators import linked as L
from strandsift.operators import superkmers as S
from strandsift.plans import estimate as E


def some(spark, seed, more=()):
    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    seqs = [base[rng.randrange(250) :][: rng.randrange(80)] for _ in range(60)] + ["A" * 70, "ACGT" * 12, "NNACGTNACGTTGCAACGTNN", "", None, *more]
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


@pytest.mark.parametrize("k, least, at_once, segment", [(2, 1 << 20, 1 << 20, 1 << 20), (6, 1 << 20, 50, 64), (15, 8, 200, 1 << 20), (16, 8, 1 << 20, 100), (31, 1 << 20, 1 << 20, 1 << 20)])
def test_nodes(spark, monkeypatch, k, least, at_once, segment):
    monkeypatch.setattr(S, "LEAST_HOT", least)
    monkeypatch.setattr(L, "AT_ONCE", at_once)
    monkeypatch.setattr(S, "SEGMENT", segment)
    monkeypatch.setattr(L, "ONE_OF", 1)
    reads = some(spark, k, ["ACGTTGCAAC" * 20] * 5).repartition(3)
    cols = ("code", "n", "f", "r", "right", "left")
    for a_min in (1, 3):
        want = D.bidirected(S.canonical_counts(reads, k), k, a_min).select(*cols).collect()
        assert want and sorted(map(tuple, L.nodes(reads, k, a_min).select(*cols).collect())) == sorted(map(tuple, want))


def test_single_kmers_are_not_shuffled(spark):
    """Most nodes are whole where they are counted; their neighbours took two more shuffles of every node before."""
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(20000))
    codes = S.CODES[np.frombuffer(seq.encode(), np.uint8)]
    hi, lo, tag = L.cut(codes, np.full(len(seq), len(seq)), 31, S.minimizer_size(30), np.array([], np.uint32))
    assert len(tag) < len(seq) / 6
    code, *_, ends = L.parts(hi, lo, tag, 31, 1)
    assert (ends == 3).sum() > 0.85 * len(np.unique(code)) and len(np.unique(code)) == len({min(seq[i : i + 31], seq[i : i + 31].translate(str.maketrans("ACGT", "TGCA"))[::-1]) for i in range(len(seq) - 30)})


def test_prototype_sums_from_lanes(spark):
    reads = some(spark, 4).where("seq is not null")
    want = G.prototype_sums(K.abundances(K.forward_counts(reads, 7)), 7, 1, 3)
    got = {r["a"]: r.asDict() for r in D.prototype_sums(E.packed_graph(reads, 7, 1), 7, 1, 3).collect()}
    assert got.keys() == {1, 2, 3} and all(got[r["a"]] == pytest.approx(r.asDict()) for r in want.collect())


def test_counts_by_group_and_read_summaries(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 100)
    rows = [(r["read_id"] % 20, None if r["read_id"] % 3 == 0 else "ab"[r["read_id"] % 2], r["seq"]) for r in some(spark, 5).collect()]
    reads = spark.createDataFrame(rows, "read_id long, lang string, seq string")
    want = K.forward_counts(reads, 5, "lang").collect()
    assert sorted(map(str, K.build_index(reads, [5], "lang").select("lang", "kmer", "m").collect())) == sorted(map(str, want))
    words = {}
    for i, _, s in rows:
        words.setdefault(i, []).extend(x for x in ((s or "")[j : j + 5] for j in range(len(s or "") - 4)) if "N" not in x)
    got = {r[0]: tuple(r)[1:] for r in S.read_summary(reads, 5).collect()}
    assert got == {i: (len(w), len(set(w)), min(w), max(w)) for i, w in words.items() if w}
    once = reads.dropDuplicates(["read_id"])
    assert {tuple(r) for r in S.read_summary(once, 5).collect()} <= {(r["read_id"], len(w := [r["seq"][j : j + 5] for j in range(len(r["seq"]) - 4) if "N" not in r["seq"][j : j + 5]]), len(set(w)), min(w), max(w)) for r in once.where("length(seq) > 4").collect()}


def test_bins_of_a_histogram(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 1, 2, 5, 41)], "n long")
    assert sorted(map(tuple, K.binned_histogram(rows, 4).collect())) == [(0, 1.0, 11.0, 4), (3, 31.0, 41.0, 1)]
    assert P.MOST_K == 31


def test_distinct_kmers_of_dealt_overlaps(spark, monkeypatch):
    """A k-mer between two minimizers, or with a minimizer that is dealt by its overlaps, counts once; nothing but the sizes of
    minimizers is written (super-k-mers were, for each k)."""
    written = []
    monkeypatch.setattr(L, "durable", lambda df, name="table", codec=None: written.append(name) or df.localCheckpoint())
    monkeypatch.setattr(S, "LEAST_HOT", 8)
    monkeypatch.setattr(L, "ONE_OF", 1)
    reads = some(spark, 6, ["ACGTTGCAAC" * 20] * 5).where("seq is not null")
    want = [K.abundances(K.forward_counts(reads, k)).count() for k in (2, 8, 15)]
    assert [r["kmers"] for r in L.distinct_kmers(reads, [2, 8, 15]).orderBy("k").collect()] == want
    assert set(written) == {"minimizers"}
