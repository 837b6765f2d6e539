"""Command line: landscapes of graph metrics, unitigs, and pattern queries."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bases import normalize
from .operators import text as T
from .operators.kmers import build_index
from .operators.unitigs import numbered, unitigs
from .plans import estimate
from .sources import sinks
from .sources.reads import load_reads
from .sources.texts import read_rows, weighted_patterns
from .storage import durable


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandsift", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, about in (("landscape", "metrics for every k and minimum abundance"), ("exact", "the same from the unitigs themselves"), ("unitigs", "unitig strings"), ("index", "a k-mer index")):
        s = sub.add_parser(name, help=about)
        s.add_argument("-r", "--readfile", required=name != "landscape")
        s.add_argument("-o", "--outputfile", required=True)
        s.add_argument("-a", "--minabundance", type=int, default=3 if name == "unitigs" else 1)
        s.add_argument("-A", "--maxabundance", type=int, default=5)
        s.add_argument("-k", "--mink", type=int, default=31 if name == "unitigs" else 15)
        s.add_argument("-K", "--maxk", type=int, default=0, help="0: the average read length less 10")
        s.add_argument("-e", "--relerr", type=float, default=0.1)
        s.add_argument("--share", type=float, default=0.5, help="of reads that k-mers are drawn from")
        s.add_argument("--census", action="store_true", help="use all k-mers instead of a sample")
        if name == "landscape":
            s.add_argument("-l", "--loadindex", help="a k-mer index that 'index' has written, in place of reads: a census of all k-mers")
        s.add_argument("--seed", type=int, default=1)
    g = sub.add_parser("grep", help="texts that hold a pattern")
    g.add_argument("pattern")
    g.add_argument("texts")
    g.add_argument("-c", "--count", action="store_true")
    g.add_argument("-C", "--context", type=int)
    g.add_argument("-o", "--outputfile", help="write all lines there as text instead of printing them")
    q = sub.add_parser("patterns", help="occurrences and documents of many patterns")
    q.add_argument("patterns")
    q.add_argument("texts")
    q.add_argument("-i", "--weight", help="digits of the weight in front of a pattern, or t for one up to a tab")
    q.add_argument("-s", "--sort", action="store_true")
    q.add_argument("-o", "--outputfile", help="write found positions, selected and sorted patterns there instead of printing the summary")
    return p


def _put(lines: DataFrame, path: str | None) -> None:
    """All rows of a text column, to files or printed one by one."""
    if path:
        lines.write.mode("overwrite").text(path)
    else:
        for r in lines.toLocalIterator():
            print(r[0])


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strandsift").getOrCreate()
    if args.command in ("grep", "patterns"):
        docs = spark.read.text(args.texts).where("value <> ''").select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))
        if args.command == "grep":
            wanted = spark.createDataFrame([(0, args.pattern)], "pattern_id long, pattern string")
            if args.count:
                print(T.grep(docs, wanted).count())
            elif args.context is not None:
                _put(T.grep_context(T.locate(docs, wanted), docs, wanted, args.context).orderBy("doc_id", "pos").select("snippet"), args.outputfile)
            else:
                _put(docs.join(T.grep(docs, wanted), "doc_id", "left_semi").orderBy("doc_id").select("text"), args.outputfile)
            return
        rows = read_rows(spark, args.patterns)
        rows = weighted_patterns(rows, None if args.weight == "t" else int(args.weight)) if args.weight else rows.withColumn("weight", F.lit(1))
        rows = durable(rows.withColumn("pattern_id", F.monotonically_increasing_id()), "patterns")
        found = durable(T.locate(docs, rows), "found")
        summary = durable(T.pattern_summary(found, rows), "summary")
        if args.outputfile:
            sinks.write_pattern_results(found, summary, rows, args.outputfile)
            return
        both = T.rank_patterns(summary.join(rows, "pattern_id")) if args.sort else summary.join(rows, "pattern_id").orderBy("pattern_id")
        _put(both.select(F.concat_ws("\t", "pattern", "weight", "occ", "docc")), None)
        return
    if args.command == "landscape" and args.loadindex:
        index = spark.read.parquet(args.loadindex)
        there = [r["k"] for r in index.select("k").distinct().orderBy("k").collect()]  # as many as the index was built for
        ks = [k for k in there if args.mink <= k <= (args.maxk or k)]
        sinks.write_metrics(estimate.index_landscape(index, ks, args.minabundance, args.maxabundance), args.outputfile)
        return
    reads = load_reads(spark, args.readfile).withColumn("seq", normalize(F.col("seq"))).withColumn("read_id", F.xxhash64("path", "read_id"))
    ks = list(range(args.mink, (args.maxk or estimate.default_max_k(reads)) + 1))
    if args.command == "index":
        sinks.write_index(build_index(reads, ks), args.outputfile)
    elif args.command == "unitigs":
        nodes = estimate.graph(reads, args.mink, args.minabundance, args.minabundance)
        sinks.write_unitigs(numbered(unitigs(nodes, args.mink)), args.outputfile)
    elif args.command == "exact":
        sinks.write_metrics(estimate.exact_landscape(reads, ks, args.minabundance, args.maxabundance), args.outputfile)
    elif args.census:
        sinks.write_metrics(estimate.census_landscape(reads, ks, args.minabundance, args.maxabundance), args.outputfile)
    else:
        sinks.write_metrics(estimate.estimate_landscape(reads, ks, args.minabundance, args.maxabundance, args.relerr, args.share, args.seed), args.outputfile)


if __name__ == "__main__":
    main()
