"""The paths through all nodes of a packed graph against those of a graph of strings."""

import random

import pytest

from strandsift import storage
from strandsift.operators import bidirected as D
from strandsift.operators import linked as L
from strandsift.operators import through as H
from strandsift.operators import unitigs as U
from strandsift.plans import estimate as E


def some_reads(spark, seed, more=()):
    rng = random.Random(seed)
    whole = "".join(rng.choice("ACGT") for _ in range(500))
    ring = "".join(rng.choice("ACGT") for _ in range(90))
    seqs = [whole[i : i + 120] for i in (rng.randrange(400) for _ in range(14))] + [ring + ring[:40], "A" * 60, "ACGTT" * 20, "AC" * 30, None, *more]
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string").repartition(2)


def shown(df):
    return sorted((r["a"], r["kmer"], r["nodes"], round(r["total"], 6)) for r in df.collect())


@pytest.mark.parametrize("k, a, at_once, few", [(4, 1, 7, 0), (5, 1, 1 << 20, 0), (6, 2, 3, 200_000), (9, 1, 1, 0), (12, 2, 20, 200_000), (17, 1, 5, 0), (17, 3, 1 << 20, 200_000)])
def test_paths_through_nodes(spark, monkeypatch, k, a, at_once, few):
    """Circles of one task and of several, loops, and segments that are their own reverse complement, cut anywhere."""
    monkeypatch.setattr(H, "AT_ONCE", at_once)
    monkeypatch.setattr(D, "FEW", few)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
    reads = some_reads(spark, k, ["ACGGTCATTGACCGATTA" + "TAATCGGTCAATGACCGT"] * 3)
    try:
        got = shown(H.statistics(L.alive(reads, k, a), k, a))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == shown(U.older_statistics(E.graph(reads, k, a, a), k)) and len({r[1] for r in got}) == len(got)


def test_segments_are_doubled_not_nodes(spark, monkeypatch):
    """A row for each node and direction, with strings, was written before pointers were doubled."""
    written = {}

    def durable(df, name="table", codec=None):
        out = storage.durable(df, name, codec)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(H, "durable", durable)
    rng = random.Random(2)
    reads = spark.createDataFrame([(0, "".join(rng.choice("ACGT") for _ in range(20_000)))], "read_id long, seq string")
    nodes = L.alive(reads, 17, 1)
    rows = H.statistics(nodes, 17, 1)
    assert rows.count() == 2 * nodes.count()
    assert written["paths"][0] < 2 * nodes.count() / 4
