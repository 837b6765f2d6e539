"""Carried sums and extrema, merged ranges, greedy bins and intervals against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandsift.functions.statistics import is_accurate, ratio_interval
from strandsift.operators import text as T
from strandsift.operators.running import running, running_max, running_min
from strandsift.operators.unitigs import e_size_interval
from strandsift.sources.texts import greedy_bins


def test_carried_folds(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([None, *range(-5, 6)])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    got = running_max(df, F.col("v"), ["g"], [F.col("i")], "most")
    got = running_min(got, F.col("v"), ["g"], [F.col("i")], "least")
    got = running(got, F.coalesce("v", F.lit(0)), ["g"], [F.col("i")], "sum")
    for r in got.collect():
        before = [v for g, i, v in rows if g == r["g"] and i < r["i"]]
        known = [v for v in before if v is not None]
        assert (r["most"], r["least"], r["sum"]) == (max(known, default=None), min(known, default=None), sum(known))


def merged(ranges):
    out = []
    for first, last in sorted(ranges):
        if out and out[-1][1] + 1 >= first:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return {tuple(x) for x in out}


def test_merged_ranges(spark):
    rng = random.Random(5)
    rows = []
    for g in ("x", "y", None):
        for _ in range(200):
            first = rng.randrange(3000)
            rows.append((g, first, first + rng.choice([0, 1, 5, 400 if rng.random() < 0.05 else 9])))
    got = T.merge_ranges(spark.createDataFrame([*rows, rows[0]], "g string, first int, last int"), "g").collect()
    for g in ("x", "y", None):
        assert {(r["first"], r["last"]) for r in got if r["g"] == g} == merged([(a, b) for h, a, b in rows if h == g])


def test_merged_ranges_of_one_large_group_are_spread(spark):
    """One group of 200,000 ranges equals the window over the group, and several tasks hold its rows."""
    ranges = spark.range(200_000).select(F.lit(1).alias("g"), F.expr("id * 7 + cast(pmod(xxhash64(id), 5) as int)").alias("first")).withColumn("last", F.col("first") + F.expr("cast(pmod(xxhash64(first), 9) as int)"))
    w = Window.partitionBy("g").orderBy("first", "last")
    marked = ranges.withColumn("new", F.when(F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1 >= F.col("first"), 0).otherwise(1)).withColumn("n", F.sum("new").over(w))
    want = marked.groupBy("n").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last")
    got = T.merge_ranges(ranges, "g").select("first", "last")
    assert got.count() == want.count() and got.subtract(want).count() == 0
    dealt = ranges.repartitionByRange("g", "first", "last").groupBy(F.spark_partition_id()).count()
    assert dealt.count() > 1


def bins(sizes, capacity):
    out, held, number = [], 0, 0
    for s in sizes:
        if held + s > capacity and held > 0:
            held, number = 0, number + 1
        held += s
        out.append(number)
    return out


@pytest.mark.parametrize("capacity", [1, 10, 37, 10_000])
def test_greedy_bins(spark, capacity):
    rng = random.Random(capacity)
    rows, want = [], {}
    for g, n in (("a", 400), ("b", 1), (None, 60)):
        sizes = [rng.choice([0, 0, 1, 2, 3, 9, 12, 50, None]) for _ in range(n)]
        number = bins([s or 0 for s in sizes], capacity)
        for i in range(n):
            rows.append((g, i, sizes[i]))
            want[g, i] = number[i]
    got = greedy_bins(spark.createDataFrame(rows, "g string, i int, size int").repartition(3), "i", "size", capacity, "g").collect()
    assert {(r["g"], r["i"]): r["bin"] for r in got} == want


def test_greedy_bins_of_odd_tables(spark):
    none = spark.createDataFrame([], "i int, size int")
    assert greedy_bins(none, "i", "size", 5).count() == 0
    assert [r["bin"] for r in greedy_bins(spark.createDataFrame([(1, 9), (2, 9), (3, 0), (4, 9)], "i int, size int"), "i", "size", 5).sort("i").collect()] == [0, 1, 2, 2]


def test_intervals_cover_the_truth(spark):
    """Of 400 intervals from 300 draws each, about 95 in 100 hold the ratio of the true means."""
    rng = np.random.default_rng(7)
    size, weight = rng.integers(20, 400, (400, 300)), 1 / rng.integers(1, 6, (400, 300))
    truth_size, truth_weight = np.arange(20, 400), 1 / np.arange(1, 6)
    true = (truth_weight.mean() * (truth_size.astype(float) ** 2).mean()) / (truth_weight.mean() * truth_size.mean())
    rows = [(t, int(s) - 16, float(w)) for t in range(400) for s, w in zip(size[t], weight[t], strict=True)]
    got = e_size_interval(spark.createDataFrame(rows, "a int, nodes int, weight double"), 17).collect()
    inside = sum(r["low"] <= true <= r["high"] for r in got)
    assert 0.91 * 400 <= inside <= 0.985 * 400
    r = next(r for r in got if r["a"] == 0)
    u, v = weight[0] * size[0].astype(float) ** 2, weight[0] * size[0]
    c = np.cov(u, v, bias=True)
    y = u.mean() / v.mean()
    assert r["e_size"] == pytest.approx(y) and r["deviation"] == pytest.approx(np.sqrt((c[0, 0] - 2 * y * c[0, 1] + y * y * c[1, 1]) / 300) / v.mean())


def test_accuracy_and_empty_intervals(spark):
    df = spark.createDataFrame([(10.0, 2.0), (11.0, 2.0), (9.0, 2.0)], "u double, v double")
    r = df.agg(ratio_interval(F.col("u"), F.col("v")).alias("i")).select("i.*", is_accurate(F.col("i"), 0.1).alias("yes"), is_accurate(F.col("i"), 0.05).alias("no")).first()
    assert r["estimate"] == 5 and r["yes"] and not r["no"]
    assert df.where("u < 0").agg(ratio_interval(F.col("u"), F.col("v")).alias("i")).first()["i"]["estimate"] is None
