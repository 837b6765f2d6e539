"""Reads from FASTA and FASTQ files, plain or gzip, and lists of such files."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import durable
from .blocked import RANGE, is_blocked, range_lines, read_blocked_lines

READS = "path string, read_id long, header string, seq string"


def parse_records(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(header, sequence) of each record.

    The header ends at the first white space; sequence lines go on to a line that begins with '>', '+' or '@'.  After
    '+' quality lines are read until they are as long as the sequence, so a quality line may begin with any character.
    """
    header, parts, quality = None, [], -1
    for line in lines:
        line = line.rstrip("\r\n")
        if quality >= 0:
            if quality < sum(map(len, parts)):
                quality += len(line)
                continue
            quality = -1
        if line[:1] in (">", "@"):
            if header is not None:
                yield header, "".join(parts)
            header, parts = (line[1:].split(None, 1) or [""])[0], []
        elif line[:1] == "+" and header is not None:
            quality = 0
        elif header is not None:
            parts.append(line)
    if header is not None:
        yield header, "".join(parts)


def _paths(spark: SparkSession, list_path: str) -> list[str]:
    """The files named by a list: one per line, up to the first space; empty lines are skipped."""
    rows = spark.read.text(list_path).select(F.regexp_replace(F.regexp_extract("value", r"^([^ \r\n]*)", 1), r"\r", "").alias("p")).where("p <> ''")
    return [r["p"] for r in rows.toLocalIterator()]


def read_sequences(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, read_id, header, seq) of FASTA/FASTQ files of any size; read_id tells the reads of a file apart.

    Plain FASTA, plain FASTQ of four lines a record, and blocked gzip files of both are cut into records by many tasks; other
    gzip files, which can't be cut, are read as streams, one task each, as is FASTQ with sequences over several lines.
    Qualities are dropped.
    """
    kinds: dict[str, list[str]] = {"fasta": [], "fastq": [], "stream": [], "blocked": []}
    for path in paths:
        kinds[_kind(spark, path)].append(path)
    out = None
    if kinds["fasta"]:
        records = read_fasta_lines(spark, *kinds["fasta"])
        out = records.select("path", F.monotonically_increasing_id().alias("read_id"), "header", "seq")
    for more, read in (("fastq", read_fastq_lines), ("stream", _read_streams)):
        if kinds[more]:
            one = read(spark, *kinds[more])
            out = one if out is None else out.unionByName(one)
    for path in kinds["blocked"]:
        one = read_blocked(spark, path)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], READS)


def _kind(spark: SparkSession, path: str) -> str:
    """How a file can be read: by its name and first lines."""
    if path.endswith((".gz", ".bgz", ".bgzf")):
        return "blocked" if is_blocked(path) and _shape(_head(path)) != "stream" else "stream"
    return _shape([r["value"] for r in spark.read.text(path).limit(8).collect()])


def _shape(head: list[str]) -> str:
    """fasta, fastq (four lines a record), or stream for all else."""
    if head and head[0][:1] == ">":
        return "fasta"
    lines = [x for i, x in enumerate(head) if i % 4 == 2]
    return "fastq" if head and head[0][:1] == "@" and lines and all(x[:1] == "+" for x in lines) and all(x[:1] == "@" for x in head[::4]) else "stream"


def _read_streams(spark: SparkSession, *paths: str) -> DataFrame:
    """Each file as one stream of lines in one task, whatever its size: a file that can't be cut, or is read whole."""
    out = None
    for path in paths:
        lines = spark.read.text(path)
        if not path.endswith(".gz"):
            lines = spark.read.format("binaryFile").load(path).select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("value"))

        def run(batches: Iterator[pd.DataFrame], path=path) -> Iterator[pd.DataFrame]:
            rows = []
            for i, (header, seq) in enumerate(parse_records(x for b in batches for x in b["value"])):
                rows.append((path, i, header, seq))
                if len(rows) == 10_000:
                    yield pd.DataFrame(rows, columns=["path", "read_id", "header", "seq"])
                    rows = []
            yield pd.DataFrame(rows, columns=["path", "read_id", "header", "seq"])

        one = lines.mapInPandas(run, READS)
        out = one if out is None else out.unionAll(one)
    return out


def read_fastq_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, read_id, header, seq) of plain FASTQ with four lines a record, by many tasks: lines are numbered inside the
    blocks that a file is cut into, then by the sums of earlier blocks, and four lines in a row are a record."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.regexp_replace("value", "\r$", "").alias("value"))
    return _four_line_records(durable(lines, "lines"))


def _numbered(lines: DataFrame, one) -> DataFrame:
    """``lines`` (path, block, i, value) with ``number``: the sum of ``one`` over the earlier lines of a file, this one included,
    from sums inside blocks and sums of blocks."""
    rows = lines.withColumn("one", one)
    sums = rows.groupBy("path", "block").agg(F.sum("one").alias("n"))
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a block
    inside = F.sum("one").over(Window.partitionBy("path", "block").orderBy("i"))
    return rows.withColumn("inside", inside).join(F.broadcast(base.select("path", "block", "base")), ["path", "block"]).select("path", "block", "i", "value", (F.col("base") + F.col("inside")).alias("number"))


def _four_line_records(lines: DataFrame) -> DataFrame:
    numbered = _numbered(lines, F.lit(1)).withColumn("number", F.col("number") - 1)
    of = F.expr("number % 4")
    found = numbered.where(of < 2).groupBy("path", F.expr("number div 4").alias("read_id")).agg(F.max(F.when(of == 0, F.col("value"))).alias("h"), F.max(F.when(of == 1, F.col("value"))).alias("seq"))
    return found.where("h like '@%'").select("path", "read_id", F.regexp_extract("h", r"^@(\S*)", 1).alias("header"), F.coalesce("seq", F.lit("")).alias("seq"))


def _fasta_records(lines: DataFrame) -> DataFrame:
    """Records of a header line and all lines up to the next one."""
    numbered = _numbered(lines, F.col("value").startswith(">").cast("int")).where("number > 0")
    parts = F.array_sort(F.collect_list(F.struct("block", "i", "value")))
    whole = numbered.groupBy("path", (F.col("number") - 1).alias("read_id")).agg(parts.alias("p"))
    seq = F.array_join(F.transform(F.slice("p", 2, F.size("p")), lambda x: x["value"]), "")
    return whole.select("path", "read_id", F.regexp_extract(F.col("p")[0]["value"], r"^>(\S*)", 1).alias("header"), seq.alias("seq"))


def read_blocked(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(path, read_id, header, seq) of a blocked gzip file (see :mod:`strandsift.sources.blocked`): FASTA, or FASTQ of four
    lines a record, by many tasks."""
    lines = durable(read_blocked_lines(spark, path, range_bytes), "lines")
    return _fasta_records(lines) if _shape(_head(path)) == "fasta" else _four_line_records(lines)


def _head(path: str) -> list[str]:
    """The first lines of a blocked file."""
    return list(islice(range_lines(path, 0, 1), 8))


def read_fasta_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, header, seq) of plain FASTA by splitting at record starts, so that one large file is read by many tasks."""
    records = spark.read.option("lineSep", "\n>").text(list(paths)).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"^>", "").alias("r")).where("trim(r) <> ''")
    first = F.regexp_extract("r", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"[\r\n]", "")
    return records.select("path", F.regexp_extract(first, r"^(\S*)", 1).alias("header"), body.alias("seq"))


def load_reads(spark: SparkSession, path: str) -> DataFrame:
    """A FASTA/FASTQ file, or all files that a list names: told apart by the first character."""
    head = spark.read.text(path).limit(1).collect()
    if head and head[0]["value"][:1] not in (">", "@"):
        return read_sequences(spark, *_paths(spark, path))
    return read_sequences(spark, path)
