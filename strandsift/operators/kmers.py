"""k-mer counts, abundances on both strands, and the index of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import positions, reverse_complement
from ..functions.packed import MOST_K, spelled
from ..storage import durable
from . import superkmers
from .superkmers import counted_strings


def read_stats(reads: DataFrame) -> DataFrame:
    """total_length, n_reads, max_length, min_length and the average length rounded down."""
    n = F.length("seq")
    stats = reads.agg(F.sum(n).alias("total_length"), F.count("*").alias("n_reads"), F.max(n).alias("max_length"), F.min(n).alias("min_length"))
    return stats.withColumn("avg_length", F.expr("cast(total_length div n_reads as long)"))


def kmers(reads: DataFrame, k: int, *keep: str) -> DataFrame:
    """(keep, pos, kmer) for every position; reads shorter than k give none."""
    return positions(reads, "seq", k, *keep, unit="kmer")


def forward_counts(reads: DataFrame, k: int, *by: str) -> DataFrame:
    """(by, kmer, m): occurrences on the forward strand of k-mers of A, C, G and T only."""
    found = kmers(reads, k, *by).where(~F.col("kmer").rlike("[^ACGT]"))
    return found.groupBy(*by, "kmer").agg(F.count("*").alias("m"))


def abundances(forward: DataFrame) -> DataFrame:
    """(kmer, n, m): occurrences on both strands; a palindrome counts twice.  m is null for k-mers that only occur
    reversed.  One shuffle: both strands of a forward count are emitted together."""
    both = forward.select(
        F.explode(F.array(F.struct(F.col("kmer"), F.col("m"), F.col("m").alias("f")), F.struct(reverse_complement(F.col("kmer")).alias("kmer"), F.col("m"), F.lit(None).cast("long").alias("f")))).alias("x")
    )
    return both.select("x.kmer", "x.m", "x.f").groupBy("kmer").agg(F.sum("m").alias("n"), F.max("f").alias("m"))


def total_kmers(reads: DataFrame, k: int) -> DataFrame:
    """Positions of all k-mers: the sum of max(length - k + 1, 0)."""
    return reads.agg(F.sum(F.greatest(F.length("seq") - k + 1, F.lit(0))).cast("long").alias("total_kmers"))


def abundance_histogram(abundance: DataFrame) -> DataFrame:
    return abundance.groupBy(F.col("n").alias("abundance")).agg(F.count("*").alias("kmers"))


def binned_histogram(abundance: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, low, high, kmers) over equal widths from the least to the largest abundance."""
    counts = durable(abundance_histogram(abundance).withColumnRenamed("abundance", "n"), "histogram")  # a row for each abundance
    ends = counts.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("n") - F.col("lo"), width)), F.lit(0))).cast("int")
    rows = counts.crossJoin(F.broadcast(ends)).select(at.alias("bin"), "lo", width.alias("w"), "kmers").groupBy("bin", "lo", "w").agg(F.sum("kmers").alias("kmers"))
    return rows.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), "kmers")


def distinct_kmers(reads: DataFrame, ks: list[int]) -> DataFrame:
    """(k, kmers): distinct k-mers on both strands for each k."""
    out = None
    for k in ks:
        one = abundances(forward_counts(reads, k)).agg(F.count("*").alias("kmers")).select(F.lit(k).alias("k"), "kmers")
        out = one if out is None else out.unionAll(one)
    return out


def build_index(reads: DataFrame, ks: list[int], *by: str) -> DataFrame:
    """(k, by, kmer, m): forward counts for all k, from which everything else follows; one index for each value of ``by``."""
    out = None
    for k in ks:
        if k > MOST_K:
            one = forward_counts(reads, k, *by)
        elif by:
            one = superkmers.forward_counts(reads, k, *by).select(*by, spelled("code", k).alias("kmer"), "m")
        else:
            one = counted_strings(reads, k).where("m is not null")
        one = one.select(F.lit(k).alias("k"), *by, "kmer", "m")
        out = one if out is None else out.unionAll(one)
    return out


def merge_indexes(*indexes: DataFrame) -> DataFrame:
    """The index of all reads of several indexes."""
    out = indexes[0].select("k", "kmer", "m")
    for other in indexes[1:]:
        out = out.unionAll(other.select("k", "kmer", "m"))
    return out.groupBy("k", "kmer").agg(F.sum("m").alias("m"))
