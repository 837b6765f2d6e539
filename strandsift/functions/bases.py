"""Column expressions on nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of one piece when long texts are exploded: substr() walks from the start of its string, so positions
#: are taken inside short pieces and not in the whole text.
PIECE = 256


LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"


def normalize(seq: Column) -> Column:
    """A, C, G and T in upper case; every other character becomes N."""
    return F.regexp_replace(F.translate(seq, "acgt", "ACGT"), "[^ACGT]", "N")


def complement(seq: Column) -> Column:
    """Each base's complement; other characters stay."""
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def canonical(seq: Column) -> Column:
    """The lesser of a string and its reverse complement."""
    return F.least(seq, reverse_complement(seq))


def is_palindrome(seq: Column) -> Column:
    return seq == reverse_complement(seq)


def prefix(kmer: Column, k: int) -> Column:
    """The overlap with predecessors: all but the last base."""
    return F.substring(kmer, 1, k - 1)


def suffix(kmer: Column, k: int) -> Column:
    """The overlap with successors: all but the first base."""
    return F.substring(kmer, 2, k - 1)


def append_last(seq: Column, kmer: Column) -> Column:
    return F.concat(seq, F.right(kmer, F.lit(1)))


def prepend_first(seq: Column, kmer: Column) -> Column:
    return F.concat(F.left(kmer, F.lit(1)), seq)


def out_neighbours(kmer: Column, k: int) -> Column:
    """The four strings that can follow a k-mer."""
    return F.array(*(F.concat(suffix(kmer, k), F.lit(b)) for b in "ACGT"))


def in_neighbours(kmer: Column, k: int) -> Column:
    """The four strings that can stand before a k-mer."""
    return F.array(*(F.concat(F.lit(b), prefix(kmer, k)) for b in "ACGT"))


def as_dna(text: Column, keep_others: bool = False) -> Column:
    """A nucleotide string from any text: letters a-z become A, C, G, T in turn; other characters go, or become N."""
    coded = F.translate(text, LETTERS + LETTERS.upper(), 2 * BASES)
    return F.regexp_replace(coded, "[^ACGT]", "N" if keep_others else "")


def positions(df: DataFrame, text: str, size: int, *keep: str, unit: str = "gram", pos: str = "pos") -> DataFrame:
    """A row for each window of ``size`` characters of a text: the columns ``keep``, ``pos`` (from 0) and ``unit``.

    Texts shorter than ``size`` give no row.  The text is cut into overlapping pieces first, so the cost is linear.
    """
    n = F.length(text)
    cut = df.where(n >= size).select(*keep, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), n - size, F.lit(PIECE))).alias("_b"))
    cut = cut.select(*keep, "_b", F.substring("_t", F.col("_b") + 1, F.lit(PIECE + size - 1)).alias("_p"))
    each = cut.select(*keep, "_b", "_p", F.explode(F.sequence(F.lit(0), F.length("_p") - size)).alias("_o"))
    return each.select(*keep, (F.col("_b") + F.col("_o")).alias(pos), F.substring("_p", F.col("_o") + 1, F.lit(size)).alias(unit))
