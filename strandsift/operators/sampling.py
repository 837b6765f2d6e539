"""Sampling of reads, k-mers and weighted positions; all draws are fixed by hashes of a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable
from .running import running


def bernoulli(reads: DataFrame, share: float = 0.5, seed: int = 1) -> DataFrame:
    """Each row with probability ``share``."""
    return reads.sample(False, share, seed)


def arithmetic_sample(df: DataFrame, number: Column, modulus: int, below: int) -> DataFrame:
    """The rows whose number, modulo ``modulus``, is less than ``below``: a sample that any SQL engine repeats."""
    return df.where(F.pmod(number, F.lit(modulus)) < below)


def _in_ranges(items: DataFrame, order: list[Column], numbers: DataFrame) -> DataFrame:
    """``items`` (with a long column ``w``) joined to the ``numbers`` (a column u from 0 below the sum of w) that fall into
    their ranges of the running sum of w, with ``at``, the place inside the range.

    Ranges and numbers meet in cells of the number line about as wide as a range is on average, so a join reads a few
    ranges for each number, however many there are.
    """
    ranges = durable(running(items.where("w > 0"), F.col("w"), [], order, "lo"), "weights")
    total, count = ranges.agg(F.sum("w"), F.count("*")).first()
    if not total:
        return numbers.where("false").crossJoin(ranges).withColumn("at", F.lit(0).cast("long"))
    width = max(1, -(-total // count))
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(lo + w - 1) div {width}"))))
    placed = numbers.withColumn("u", F.expr(f"u % {total}")).withColumn("cell", F.expr(f"u div {width}"))
    return placed.join(cells, "cell").where("u >= lo and u < lo + w").withColumn("at", F.col("u") - F.col("lo")).drop("cell")


def _numbers(df: DataFrame, draws: int, seed: int, first: int = 0) -> DataFrame:
    """(draw, u, v): two numbers of 62 bits for each draw."""
    number = lambda s: F.shiftrightunsigned(F.xxhash64(F.lit(s), "id"), 2)
    return df.sparkSession.range(first, first + draws).select(F.col("id").alias("draw"), number(seed).alias("u"), number(seed + 1).alias("v"))


def draw_kmers(reads: DataFrame, k: int, draws: int, seed: int = 1, uniform_over: str = "kmers", first: int = 0) -> DataFrame:
    """(draw, kmer): ``draws`` k-mers with replacement, numbered from ``first`` on.

    ``uniform_over`` "kmers" gives every k-mer position the same chance; "reads" first picks a read, then a position, which
    prefers short reads.
    """
    able = reads.where(F.length("seq") >= k).select("read_id", "seq", (F.length("seq") - k + 1).cast("long").alias("n"))
    weighted = able.withColumn("w", F.col("n") if uniform_over == "kmers" else F.lit(1).cast("long"))
    hit = _in_ranges(weighted, [F.col("read_id"), F.col("seq")], _numbers(reads, draws, seed, first))
    offset = F.col("at") if uniform_over == "kmers" else F.expr("v % n")
    return hit.select("draw", F.substring("seq", (offset + 1).cast("int"), F.lit(k)).alias("kmer"))


def draw_weighted(items: DataFrame, key: str, weight: str, draws: int, seed: int = 1) -> DataFrame:
    """(draw, key): draws with replacement, with chances in proportion to weight (a whole number)."""
    weighted = items.select(key, F.col(weight).cast("long").alias("w"))
    return _in_ranges(weighted, [F.col(key)], _numbers(items, draws, seed)).select("draw", key)


def semi_greedy_positions(weights: DataFrame, rate: int, greediness: float) -> DataFrame:
    """Regular positions every rate / (1 - greediness), then the heaviest of the rest (of equal ones the first), up to
    n / rate in all.

    ``weights`` is (pos, weight); positions count from 0.  A histogram of the weights gives the least weight that is
    taken whole; only positions with the weight below it are ordered.
    """
    step = max(1, round(rate / (1 - greediness)))
    regular = weights.where(F.pmod("pos", F.lit(step)) == 0).withColumn("kind", F.lit("regular"))
    n = weights.count()
    rest = max(0, n // rate - -(-n // step))
    others = weights.where((F.pmod("pos", F.lit(step)) != 0) & F.col("weight").isNotNull())
    counts = others.groupBy("weight").agg(F.count("*").alias("n"))
    above = running(counts, F.col("n"), [], [F.desc("weight")])
    cut = above.where((F.col("before") <= rest) & (F.col("before") + F.col("n") > rest)).first()  # the weight that is taken in part
    if cut is None:
        return regular.unionAll(others.withColumn("kind", F.lit("heavy")))
    heavy = others.where(F.col("weight") > cut["weight"])
    ties = running(others.where(F.col("weight") == cut["weight"]), F.lit(1), [], [F.col("pos")]).where(F.col("before") < rest - cut["before"]).drop("before")
    return regular.unionAll(heavy.unionAll(ties).withColumn("kind", F.lit("heavy")))
