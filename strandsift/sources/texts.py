"""Readers and cutters of texts, patterns, parameters and metric tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import running, running_min
from ..storage import durable
from .blocked import file_system

METRICS = (
    "k int, a int, nr_nodes double, nr_edges long, avg_internal_nodes double, avg_length_unitigs double, est_sample_size long, nr_unitigs double, e_size double"
)


def read_rows(spark: SparkSession, path: str, skip_empty: bool = True) -> DataFrame:
    """Patterns, one per line."""
    rows = spark.read.text(path).select(F.col("value").alias("pattern"))
    return rows.where("pattern <> ''") if skip_empty else rows


def weighted_patterns(rows: DataFrame, digits: int | None = None) -> DataFrame:
    """(pattern, weight): the weight is the first ``digits`` characters of a row, or what stands before its first tab."""
    if digits:
        return rows.select(F.expr(f"substr(pattern, {digits + 1})").alias("pattern"), F.expr(f"try_cast(trim(left(pattern, {digits})) as int)").alias("weight"))
    cut = F.split("pattern", "\t", 2)
    has = F.size(cut) > 1
    return rows.select(F.when(has, cut[1]).otherwise(F.col("pattern")).alias("pattern"), F.when(has, cut[0].try_cast("int")).otherwise(F.lit(1)).alias("weight"))


def fixed_width(df: DataFrame, text: str, size: str, *keep: str) -> DataFrame:
    """Consecutive parts of ``size`` characters (an expression): (keep, part, value); the last one may be shorter."""
    n = F.length(text)
    each = df.where(n > 0).select(*keep, F.col(text).alias("_t"), F.expr(size).alias("_s"), F.posexplode(F.sequence(F.lit(0), n - 1, F.expr(size))).alias("part", "_b"))
    return each.select(*keep, "part", F.substring("_t", F.col("_b") + 1, F.col("_s")).alias("value"))


def read_counted_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Patterns of equal length after a header line ``# number=N length=L file=F forbidden=``."""
    whole = spark.read.text(path, wholetext=True)
    cut = whole.select(
        F.regexp_extract("value", r"number=(\d+)", 1).cast("int").alias("n"), F.regexp_extract("value", r"length=(\d+)", 1).cast("int").alias("l"), F.regexp_replace("value", r"^[^\n]*\n", "").alias("body")
    )
    rows = cut.select("body", "l", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pattern_id"))
    return rows.select(F.col("pattern_id").cast("long").alias("pattern_id"), F.substring("body", F.col("pattern_id") * F.col("l") + 1, F.col("l")).alias("pattern"))


def read_parameters(spark: SparkSession, path: str) -> dict[str, int]:
    """``KEY = value`` lines as a dictionary; other lines are skipped."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S+)\s*=\s*(\d+)\s*$", 1).alias("k"), F.regexp_extract("value", r"=\s*(\d+)\s*$", 1).alias("v")).where("k <> ''")
    return {r["k"]: int(r["v"]) for r in rows.toLocalIterator()}


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric tables as :func:`~strandsift.sources.sinks.write_metrics` writes them; '.' is null."""
    return spark.read.csv(path, header=True, schema=METRICS, nullValue=".")


def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """A suffix table as :func:`~strandsift.sources.sinks.write_suffixes` writes it."""
    return spark.read.parquet(path)


def read_weights(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """(pos, weight) from a file of unsigned 32-bit little-endian numbers, one for each position; a task reads a range of
    the file, in parts of a million numbers.  Bytes after the last whole number don't count."""
    system, name = file_system(path)
    step = max(1, range_bytes // 4)
    numbers = system.get_file_info(name).size // 4
    schema = pa.schema([("pos", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = file_system(path)
        for b in batches:
            for block in b.column(0).to_pylist():
                with system.open_input_file(name) as f:
                    for lo in range(block * step, min(numbers, (block + 1) * step), 1 << 20):
                        n = min(numbers, (block + 1) * step, lo + (1 << 20)) - lo
                        f.seek(4 * lo)
                        part = np.frombuffer(f.read(4 * n), "<u4").astype(np.int64)
                        yield pa.record_batch([pa.array(np.arange(lo, lo + n)), pa.array(part)], schema=schema)

    n = max(1, -(-numbers // step))
    return spark.range(0, n, 1, min(n, 100_000)).mapInArrow(run, "pos long, weight long")


def tagged_documents(df: DataFrame, text: str, tag: str, *keep: str) -> DataFrame:
    """What stands between ``<tag>`` and ``</tag>``: (keep, part, value)."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return df.select(*keep, F.posexplode(found).alias("part", "value"))


def bins_by_size(df: DataFrame, order: str, size: str, capacity: int, *partition: str) -> DataFrame:
    """Numbers for rows in ``order`` so that a bin begins whenever the running size passes a multiple of ``capacity``.

    ``partition`` names the groups that are binned on their own; ``order`` tells the rows of a group apart.
    """
    before = running(df, F.coalesce(F.col(size), F.lit(0)), list(partition), [F.col(order)], "bin")
    return before.withColumn("bin", F.floor(F.col("bin") / capacity).cast("long"))


def greedy_bins(df: DataFrame, order: str, size: str, capacity: int, *partition: str) -> DataFrame:
    """Numbers for rows in ``order``, from 0 in each group of ``partition``: a row begins a new bin if it would take a bin
    that holds something beyond ``capacity``, and the bin then counts from this row on.

    Where a bin that begins at a row ends doesn't depend on the bins before it, so each row points to the first row of the
    next bin, found in one running minimum over the ends of all rows.  From the first row of a group on, pointers are
    doubled until no new beginning is found, about log2(bins) rounds; no group is walked through in one task.  Sizes of
    null count as 0; ``order`` tells the rows of a group apart.
    """
    keys = list(partition)
    rows = running(df, F.coalesce(F.col(size), F.lit(0)), keys, [F.col(order)], "_from")
    rows = running(rows, F.lit(1), keys, [F.col(order)], "_row").withColumn("_to", F.col("_from") + F.coalesce(F.col(size), F.lit(0)))
    rows = durable(rows, "rows")
    # the first row that ends beyond the capacity of a bin from here: the least number among the greater ends
    ends = rows.select(*keys, F.col("_to").alias("_v"), F.lit(1).alias("_kind"), "_row", "_from", F.col("_row").alias("_end"))
    asks = rows.select(*keys, (F.col("_from") + capacity).alias("_v"), F.lit(0).alias("_kind"), "_row", "_from", F.lit(None).cast("long").alias("_end"))
    found = running_min(asks.unionAll(ends), F.col("_end"), keys, [F.desc("_v"), F.col("_kind"), F.desc("_row")], "_next").where("_kind = 0 and _next is not null")
    start = rows.select(*keys, F.col("_row").alias("_at"), F.col("_from").alias("_begin"))
    # a row that is too large by itself stays where it is when the bin is empty, and the one after it begins the next bin
    met = _meet(found, start, keys, "_next", "_at").withColumn("_to", F.col("_next") + F.when(F.col("_begin") > F.col("_from"), 0).otherwise(1))
    step = durable(met.select(*keys, "_row", "_to"), "steps")
    bins = durable(rows.where("_row = 0").select(*keys, "_row"), "bins")
    seen = bins.count()
    while True:
        ahead = _meet(bins, step.withColumnRenamed("_row", "_at"), keys, "_row", "_at", "left")
        bins, before = durable(ahead.select(*keys, F.explode(F.array("_row", "_to")).alias("_row")).where("_row is not null").distinct(), "bins"), seen
        seen = bins.count()
        if seen == before:
            break
        on = step.withColumnsRenamed({"_row": "_at", "_to": "_far"})
        step = durable(_meet(step, on, keys, "_to", "_at").select(*keys, "_row", F.col("_far").alias("_to")), "steps")
    marked = _meet(rows, bins.select(*keys, F.col("_row").alias("_at")), keys, "_row", "_at", "left").withColumn("_first", F.when(F.col("_at").isNull(), 0).otherwise(1))
    counted = running(marked.select(*df.columns, "_first"), F.col("_first"), keys, [F.col(order)], "bin")
    return counted.select(*df.columns, (F.col("bin") + F.col("_first") - 1).alias("bin"))


def _meet(a: DataFrame, b: DataFrame, keys: list[str], left: str, right: str, how: str = "inner") -> DataFrame:
    """Rows of the same group, a null group included, with ``left`` equal to ``right``."""
    names = {c: f"_group{i}" for i, c in enumerate(keys)}
    same = F.col(left) == F.col(right)
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    return a.join(b.withColumnsRenamed(names), same, how).drop(*names.values())


def alignment_column(lines: DataFrame, row: str, value: str, number: int) -> DataFrame:
    """The text of one aligned sequence: the characters at column 2 * number of all lines but headers, without gaps."""
    chars = lines.where(~F.col(value).startswith(">")).select(row, F.substring(value, 2 * number + 1, 1).alias("c")).where("c <> '' and c not in (' ', '=', '-', '_')")
    return chars.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(row, "c"))), lambda x: x["c"]), "").alias("text"))
