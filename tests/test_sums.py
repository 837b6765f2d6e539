"""Degrees that are summed in the tasks that count k-mers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandsift.operators import bidirected as D
from strandsift.operators import linked as L
from strandsift.plans import estimate as E


def some_reads(seed):
    rng = random.Random(seed)
    whole = "".join(rng.choice("ACGT") for _ in range(900))
    return [whole[i : i + 200] for i in (rng.randrange(700) for _ in range(9))] + ["ACGTT" * 30, "A" * 90, "ACNNGT" * 9, "ACG", None]


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string").repartition(2)


@pytest.mark.parametrize("k, seed", [(4, 1), (7, 2), (12, 3), (21, 4)])
def test_degrees_are_summed_inside_tasks(spark, monkeypatch, k, seed):
    r = frame(spark, some_reads(seed))
    nodes = E.packed_graph(r, k, 1)
    written = []
    keep = L.durable
    monkeypatch.setattr(L, "durable", lambda df, name="table", codec=None: written.append((name, keep(df, name, codec))) or written[-1][1])
    sums = L.degree_sums(r, k, 1, 4).cache()
    old = D.degrees(nodes, k, 1, 4).groupBy("a", "din", "dout").agg(F.count("*").alias("nodes"))
    rows = lambda df, *c: sorted(tuple(x) for x in df.select(*c).collect())
    assert rows(L.degree_counts(sums), "a", "din", "dout", "nodes") == rows(old, "a", "din", "dout", "nodes")
    assert rows(L.exact_counts(sums), "a", "nodes", "arcs") == rows(D.exact_counts(nodes, k, 1, 4), "a", "nodes", "arcs")
    for x, y in zip(rows(L.census(sums), "a", "nodes", "internal", "unitigs"), rows(D.census(nodes, 1, 4), "a", "nodes", "internal", "unitigs"), strict=True):
        assert x == pytest.approx(y)
    # only halves of nodes are written, and the sums
    table = dict(written)["sums"]
    assert table.where("a = -1").select("code").distinct().count() < nodes.count()


@pytest.mark.parametrize("columns, tasks", [(3, 1), (4, 7)])
def test_runs_are_packed_by_their_task(columns, tasks):
    rng = np.random.default_rng(columns)
    rows = [rng.integers(-(2**63), 2**63 - 1, 3000) for _ in range(columns)]
    packed = L.packed([c.copy() for c in rows], tasks)
    assert packed.num_rows == tasks  # a row for each task, not for each run
    found = []
    for task, size, blob in zip(*(c.to_pylist() for c in packed.columns), strict=True):
        found.append(L.unpacked(size, blob, columns))
        bucket = found[-1][2].view(np.uint64) >> np.uint64(32)
        assert (bucket % np.uint64(tasks) == task).all() and (np.diff(bucket.astype(np.int64)) >= 0).all()
    assert sorted(zip(*(np.concatenate(c).tolist() for c in zip(*found, strict=True)))) == sorted(zip(*(c.tolist() for c in rows)))


def test_halves_are_packed_by_their_task():
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 1 << 30, 3000), *(rng.integers(0, 2**63 - 1, 3000) for _ in range(5))]
    rows[0][:1000] = rows[0][1000:2000]
    packed = L.packed_halves([c.copy() for c in rows], 15, 7)
    assert packed.num_rows == 7  # a row for each task, not for each half
    found = []
    for size, blob in zip(packed.column("size").to_pylist(), packed.column("runs").to_pylist(), strict=True):
        found.append(L._opened(size, blob, 6))
        found[-1][0] = np.cumsum(found[-1][0])
    assert sum(len(np.unique(f[0])) for f in found) == len(np.unique(rows[0]))  # both halves of a node are in one task
    assert sorted(zip(*(np.concatenate(c).tolist() for c in zip(*found, strict=True)))) == sorted(zip(*(c.tolist() for c in rows)))
