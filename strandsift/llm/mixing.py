"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of copies of its documents that gives it its share of the target size.  Each
document's copies are a Poisson number with that mean, by inverting the distribution at a number in [0, 1) that a
hash of seed and document fixes; so the result doesn't depend on partitions or on retries.  Copies are then sorted by
a hash of seed, document and copy, which is a global shuffle that can be repeated.

Scale: sources are counted with partial sums; their rates are broadcast up to a checked number of sources and joined
with a splittable join beyond it.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh

#: Larger rates are the sum of several draws with a rate of at most this.
RATE_EACH = 16.0
#: Steps of the distribution function; above RATE_EACH the chance of more is below 1e-28.
STEPS = 80
BROADCAST_SOURCES = 50_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts, joined by ':'."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """The distribution function of a Poisson number at 0, 1, ... STEPS - 1."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["steps"], F.array(F.element_at(acc["steps"], -1) + p)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS - 1)).cast("array<double>"), start, step)["steps"]


def mixing_rates(docs: DataFrame, source_col: str = "source", weights: dict[str | None, float] | None = None, size: float | None = None) -> DataFrame:
    """(source, rows, rate) of all sources: weights are relative (equal where not given), and ``size`` is the target
    number of documents (as many as there are).  A source that is missing in given weights has rate 0."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        weighted = counts.withColumn("weight", F.lit(1.0))
    else:
        case = F.lit(0.0)
        for name, w in weights.items():
            case = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(case)
        weighted = counts.withColumn("weight", case)
    total = weighted.agg(F.sum("weight").alias("all_weights"), F.sum("rows").alias("all_rows"))
    target = F.col("all_rows").cast("double") if size is None else F.lit(float(size))
    rate = F.try_divide(target * F.col("weight"), F.col("all_weights") * F.col("rows"))
    return weighted.crossJoin(F.broadcast(total)).select("source", "rows", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix_sources(
    docs: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: dict[str | None, float] | None = None,
    size: float | None = None,
    seed: int = 17,
) -> DataFrame:
    """``docs`` with all columns, each row as often as drawn, in shuffled order, with the columns copy (from 1) and
    shuffle_key (32 hexadecimal digits, ascending).  Columns of ``docs`` with these two names (in any case) are replaced;
    others may have any names.

    Defined cases: a null source is a source of its own; rows with a null doc_id are drawn by their text's md5; rows
    that repeat a doc_id get the same number of copies; an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    docs = docs.select(*names)
    of, steps, parts, key, times = fresh(docs, "of", "steps", "parts", "key", "times")
    rates = mixing_rates(docs, source_col, weights, size)
    n = F.greatest(F.lit(1.0), F.ceil(F.col("rate") / RATE_EACH)).cast("int")
    rates = rates.select(F.col("source").alias(of), n.alias(parts), poisson_steps(F.col("rate") / n).alias(steps))
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rates = F.broadcast(rates) if few else rates
    by = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    drawn = docs.withColumn(key, by).join(rates, F.col(source_col).eqNullSafe(F.col(of)))
    draws = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda i: uniform(F.lit(str(seed)), F.col(key), i.cast("string")))
    drawn = drawn.withColumn(times, F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(steps, lambda c: c <= u))))
    copies = drawn.where(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(times))))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.col(key), F.col("copy").cast("string")).cast("binary"))
    out = copies.select(*names, "copy", order.alias("shuffle_key"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = (F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") * n / F.lit(float(1 << 32))).cast("int")
    return out.repartitionById(n, place).sortWithinPartitions("shuffle_key")
