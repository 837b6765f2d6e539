"""Running sums over tables of any size: inside ranges of the order first, then shifted by the sums of earlier ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable


def _carried(df: DataFrame, value: Column, group: list[str], order: list[Column], name: str, fold, join) -> DataFrame:
    """``df`` with ``fold`` of ``value`` over the rows of the same ``group`` before each row in ``order``: inside ranges of
    the order first, and ``join`` with the fold of all earlier ranges.

    Rows are dealt by ranges of group and order and written down with the number of their range, so no group, however
    large, is ordered in one task; folds of ranges are few (one for each range and the groups that reach into it).
    """
    keys = [F.col(c) for c in group]
    dealt = durable(df.withColumn("_value", value).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = lambda w: fold("_value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    inside = dealt.withColumn(name, before(Window.partitionBy("_range", *keys).orderBy(*order)))
    folds = dealt.groupBy("_range", *keys).agg(fold("_value").alias("_value"))
    base = folds.withColumn("_base", before(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range"))).drop("_value")
    same = inside["_range"] == base["_range"]
    for c in group:
        same = same & inside[c].eqNullSafe(base[c])
    joined = inside.join(base, same)
    return joined.select(*(inside[c] for c in df.columns), join(inside[name], base["_base"]).alias(name))


def running(df: DataFrame, value: Column, group: list[str], order: list[Column], name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same ``group`` that come before a row in ``order``, as a
    long.  ``order`` must tell all rows of a group apart."""
    zero = F.lit(0).cast("long")
    return _carried(df, value.cast("long"), group, order, name, F.sum, lambda here, base: F.coalesce(here, zero) + F.coalesce(base, zero))


def running_max(df: DataFrame, value: Column, group: list[str], order: list[Column], name: str = "before") -> DataFrame:
    """The same with the greatest ``value`` of the rows before, null where there is none."""
    return _carried(df, value, group, order, name, F.max, F.greatest)


def running_min(df: DataFrame, value: Column, group: list[str], order: list[Column], name: str = "before") -> DataFrame:
    """The same with the least ``value`` of the rows before, null where there is none."""
    return _carried(df, value, group, order, name, F.min, F.least)
