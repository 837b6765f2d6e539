"""Incremental k-mer indexes: reads that arrive are counted and merged, batch by batch.

An index is a folder with parts and manifests.  A micro-batch adds a part of tier 0; as soon as a tier has FANOUT parts they
are summed into one of the tier above, so an index of n batches has about FANOUT log(n) parts and each count is written log(n)
times.  A manifest is a folder of its own, numbered, whole once Spark has marked it: it lists the parts that count and the last
batch in them.  A batch that is run again is left out if the manifest has it, and overwrites its own part if it doesn't, so
each batch counts once wherever a run was stopped.  Readers take the parts of the last whole manifest; the parts that it has
replaced stay until the manifest after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.kmers import build_index
from ..storage import children, delete, exists

#: Parts of a tier that are merged into one.
FANOUT = 4
MANIFEST = "part string, tier int, batch long"
INDEX = "k int, kmer string, m long"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole manifests."""
    names = [x for x in children(spark, f"{path}/manifests") if x.startswith("v=")]
    return sorted(int(x[2:]) for x in names if exists(spark, f"{path}/manifests/{x}/_SUCCESS"))


def parts(spark: SparkSession, path: str, version: int | None = None) -> list[tuple[str, int, int]]:
    """(part, tier, last batch) of the last whole manifest, or of a given one: a few rows for each tier."""
    known = _versions(spark, path)
    if not known:
        return []
    rows = spark.read.schema(MANIFEST).json(f"{path}/manifests/v={version if version is not None else known[-1]}").collect()
    return sorted((r["part"], r["tier"], r["batch"]) for r in rows)


def _sum(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    rows = spark.read.schema(INDEX).parquet(*(f"{path}/parts/{x}" for x in names))
    return rows.groupBy("k", "kmer").agg(F.sum("m").alias("m"))


def add_batch(counts: DataFrame, path: str, number: int) -> None:
    """Add the counts (k, kmer, m) of batch ``number`` to the index, and merge full tiers."""
    spark = counts.sparkSession
    known = _versions(spark, path)
    live = parts(spark, path)
    if any(batch >= number for _, _, batch in live):
        return
    name = f"batch-{number:012d}"
    counts.write.mode("overwrite").parquet(f"{path}/parts/{name}")
    live = [*live, (name, 0, number)]
    tier = 0
    while len(full := [p for p in live if p[1] == tier]) >= FANOUT:
        name = f"tier-{tier + 1}-{number:012d}"
        _sum(spark, path, [p[0] for p in full]).write.mode("overwrite").parquet(f"{path}/parts/{name}")
        live = [p for p in live if p[1] != tier] + [(name, tier + 1, number)]
        tier += 1
    version = known[-1] + 1 if known else 0
    spark.createDataFrame(live, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifests/v={version}")
    used = {p[0] for p in live} | ({p[0] for p in parts(spark, path, known[-1])} if known else set())
    for x in children(spark, f"{path}/parts"):
        if x not in used:
            delete(spark, f"{path}/parts/{x}")
    for v in known[:-1]:
        delete(spark, f"{path}/manifests/v={v}")


def grow_index(reads: DataFrame, ks: list[int], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Add the counts of each micro-batch of a streaming (seq) table to the index at ``path``."""

    def add(batch: DataFrame, number: int) -> None:
        add_batch(build_index(batch, ks), path, number)

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The sum of all parts: (k, kmer, m)."""
    live = parts(spark, path)
    return _sum(spark, path, [p[0] for p in live]) if live else spark.createDataFrame([], INDEX)


def compact(spark: SparkSession, path: str) -> None:
    """Merge all parts into one, of the tier above the highest."""
    live, known = parts(spark, path), _versions(spark, path)
    if len(live) < 2:
        return
    tier, batch = max(p[1] for p in live) + 1, max(p[2] for p in live)
    name = f"tier-{tier}-{batch:012d}"
    _sum(spark, path, [p[0] for p in live]).write.mode("overwrite").parquet(f"{path}/parts/{name}")
    spark.createDataFrame([(name, tier, batch)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifests/v={known[-1] + 1}")


def windowed_counts(events: DataFrame, time: str, key: str, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts of a key in tumbling windows of a stream or table, with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
