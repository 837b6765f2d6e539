"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def bounded_sample(rows: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """About ``most`` rows, chosen by a hash of ``key``: all rows where there are no more than that.

    The share comes from a count of the keys, so nothing is sorted or shuffled.  A hash range holds its expected
    number of rows but for a few per cent, so the bound is 1.1 * ``most`` with near certainty; rows that share one
    key go in or out together.
    """
    total = rows.select(key).count()
    if total <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(_STEPS)) < int(_STEPS * most / total))


def crc_mod(key: str, m: int):
    """crc32 of the id as text, modulo m: the folds of the registered queries."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % m
