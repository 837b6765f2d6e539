"""Writers of metrics, unitigs, patterns and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running
from ..operators.text import rank_patterns, weighted_positions


def write_metrics(metrics: DataFrame, path: str) -> None:
    """CSV files with a header, one folder for each minimum abundance; null is '.'."""
    metrics.withColumn("abundance", F.col("a")).repartitionByRange("abundance", "k").sortWithinPartitions("k").write.partitionBy("abundance").csv(path, header=True, nullValue=".", mode="overwrite")


def write_metrics_by_k(metrics: DataFrame, path: str) -> None:
    """The same with one folder for each k and minimum abundance."""
    rows = metrics.withColumn("size", F.col("k")).withColumn("abundance", F.col("a"))
    rows.repartition("size", "abundance").write.partitionBy("size", "abundance").csv(path, header=True, nullValue=".", mode="overwrite")


def unitig_fasta(unitigs: DataFrame) -> DataFrame:
    """(value) with a FASTA record for each (unitig_id, seq)."""
    return unitigs.select(F.concat(F.lit(">UNITIG"), F.col("unitig_id").cast("string"), F.lit("\n"), F.col("seq")).alias("value"))


def write_unitigs(unitigs: DataFrame, path: str) -> None:
    unitig_fasta(unitigs).write.mode("overwrite").text(path)


def counted_patterns(patterns: DataFrame, name: str = "patterns") -> DataFrame:
    """One text of all patterns of one length, in the order of pattern_id, after a header with number and length."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pattern_id", "pattern"))), lambda x: x["pattern"]), "")
    head = F.concat(F.lit("# number="), F.count("*").cast("string"), F.lit(" length="), F.max(F.length("pattern")).cast("string"), F.lit(f" file={name} forbidden=\n"))
    return patterns.agg(F.concat(head, joined).alias("value"))


def counted_parts(patterns: DataFrame, name: str = "patterns", size: int = 65536) -> DataFrame:
    """(part, value): the text of :func:`counted_patterns` in parts, the header as part 0 and then ``size`` patterns each, so
    that no task holds all of them.  pattern_id tells patterns apart."""
    numbered = running(patterns.select("pattern_id", "pattern"), F.lit(1), [], [F.col("pattern_id")], "n")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "pattern"))), lambda x: x["pattern"]), "")
    body = numbered.groupBy(F.expr(f"n div {size} + 1").alias("part")).agg(joined.alias("value"))
    head = F.concat(F.lit("# number="), F.count("*").cast("string"), F.lit(" length="), F.coalesce(F.max(F.length("pattern")), F.lit(0)).cast("string"), F.lit(f" file={name} forbidden=\n"))
    return patterns.agg(head.alias("value")).select(F.lit(0).cast("long").alias("part"), "value").unionAll(body)


def write_index(abundance: DataFrame, path: str) -> None:
    """A k-mer table, one folder for each k."""
    abundance.write.mode("overwrite").partitionBy("k").parquet(path)


def write_sequence(docs: DataFrame, number: int, path: str) -> None:
    docs.where(F.col("doc_id") == number).select("text").write.mode("overwrite").text(path)


def write_pattern_results(found: DataFrame, summary: DataFrame, patterns: DataFrame, path: str) -> None:
    """What pattern queries give: the summed weights by position in ``found``, the patterns that occur in ``selected``, and
    all patterns by occurrences for each document, those not found last, in ``sorted``."""
    weighted_positions(found, patterns).write.mode("overwrite").parquet(f"{path}/found")
    rows = patterns.join(summary, "pattern_id")
    rows.where("occ > 0").select("pattern").write.mode("overwrite").text(f"{path}/selected")
    rank_patterns(summary).join(F.broadcast(patterns) if patterns.count() <= 100_000 else patterns, "pattern_id").select("pattern_id", "pattern", "occ", "docc", "ratio").orderBy(
        F.desc_nulls_last("ratio"), "pattern_id"
    ).write.mode("overwrite").csv(f"{path}/sorted", sep="\t", header=True)


def write_suffixes(table: DataFrame, path: str) -> None:
    """A suffix table (rank, doc_id, pos, and lcp and bwt where it has them), in ranges of rank."""
    table.repartitionByRange("rank").sortWithinPartitions("rank").write.mode("overwrite").parquet(path)
