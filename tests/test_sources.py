"""Readers, writers, the streaming index and the command line."""

import gzip

from strandsift import cli
from strandsift.operators import kmers as K
from strandsift.sources import reads as R
from strandsift.sources import sinks
from strandsift.sources import texts as I
from strandsift.streaming.index import grow_index, read_index

FASTQ = "@r1 first\nACGT\nAC\n+\n@III\nII\n@r2\nGG\n+r2\n>>\n"
FASTA = ">s1 x\r\nACG\r\nT\r\n>s2\nTTTT\n"


def test_parse_records():
    assert list(R.parse_records(iter(FASTQ.splitlines(True)))) == [("r1", "ACGTAC"), ("r2", "GG")]
    assert list(R.parse_records(iter(FASTA.splitlines(True)))) == [("s1", "ACGT"), ("s2", "TTTT")]
    assert list(R.parse_records(iter([]))) == []


def test_files_and_lists(spark, tmp_path):
    (tmp_path / "a.fq").write_text(FASTQ)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(FASTA)
    (tmp_path / "list.txt").write_text(f"{tmp_path}/a.fq extra\n\n{tmp_path}/b.fa.gz\r\n")
    got = sorted((r["header"], r["seq"]) for r in R.load_reads(spark, f"{tmp_path}/list.txt").collect())
    assert got == [("r1", "ACGTAC"), ("r2", "GG"), ("s1", "ACGT"), ("s2", "TTTT")]
    assert R.load_reads(spark, f"{tmp_path}/a.fq").count() == 2
    (tmp_path / "c.fa").write_text(FASTA)
    assert sorted((r["header"], r["seq"]) for r in R.read_fasta_lines(spark, f"{tmp_path}/c.fa").collect()) == [("s1", "ACGT"), ("s2", "TTTT")]


def test_large_files_are_cut(spark, tmp_path):
    """FASTQ with quality lines that look like headers, read in blocks of a few lines; gzip as a stream."""
    records = [(f"r{i}", "ACGTN"[: 1 + i % 5] * (1 + i % 7)) for i in range(400)]
    text = "".join(f"@{h} x\n{s}\n+\n{('@' if i % 3 else '+') + 'I' * (len(s) - 1)}\n" for i, (h, s) in enumerate(records))
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(text)
    (tmp_path / "c.fasta").write_text("".join(f">{h} x\n{s[:3]}\n{s[3:]}\n" for h, s in records))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        for name in ("a.fastq", "b.fastq.gz", "c.fasta"):
            got = R.read_sequences(spark, f"{tmp_path}/{name}").collect()
            assert sorted((r["header"], r["seq"]) for r in got) == sorted(records), name
            assert len({r["read_id"] for r in got}) == 400
        lines = R.read_fastq_lines(spark, f"{tmp_path}/a.fastq").collect()
        assert [h for h, _ in records] == [r["header"] for r in sorted(lines, key=lambda r: r["read_id"])]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_weights_and_suffix_tables(spark, tmp_path):
    import struct

    (tmp_path / "w").write_bytes(struct.pack("<4I", 5, 0, 70000, 4294967295))
    assert sorted(map(tuple, I.read_weights(spark, f"{tmp_path}/w").collect())) == [(0, 5), (1, 0), (2, 70000), (3, 4294967295)]
    (tmp_path / "v").write_bytes(struct.pack("<5I", 9, 8, 7, 6, 5) + b"xyz")
    assert sorted(map(tuple, I.read_weights(spark, f"{tmp_path}/v", range_bytes=8).collect())) == [(0, 9), (1, 8), (2, 7), (3, 6), (4, 5)]
    (tmp_path / "u").write_bytes(b"")
    assert I.read_weights(spark, f"{tmp_path}/u").count() == 0
    rows = spark.createDataFrame([(1, 0, 0, "$"), (0, 0, 1, "a")], "rank long, doc_id long, pos int, bwt string")
    sinks.write_suffixes(rows, f"{tmp_path}/s")
    assert sorted(map(tuple, I.read_suffixes(spark, f"{tmp_path}/s").collect())) == sorted(map(tuple, rows.collect()))


def test_windows_of_a_stream(spark, tmp_path):
    """A stream gives each window once, when the watermark has passed it; rows that are too late count no more."""
    import datetime

    from strandsift.streaming.index import windowed_counts

    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, kind string"
    source = str(tmp_path / "in")

    def run():
        stream = windowed_counts(spark.readStream.schema(schema).parquet(source), "ts", "kind").select("window.start", "kind", "n")
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").format("parquet").trigger(availableNow=True).start().awaitTermination()

    for rows in ([(at(1), "a"), (at(1, 30), "a"), (at(2), "b")], [(at(9), "a")], [(at(1, 5), "a"), (at(15), "b")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        run()
    got = sorted((r["start"], r["kind"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(at(1), "a", 2), (at(2), "b", 1), (at(9), "a", 1)]


def test_patterns_and_parameters(spark, tmp_path):
    p = spark.createDataFrame([(0, "abc"), (1, "xyz")], "pattern_id long, pattern string")
    text = sinks.counted_patterns(p, "f").first()["value"]
    assert text == "# number=2 length=3 file=f forbidden=\nabcxyz"
    (tmp_path / "p").write_text(text)
    assert [tuple(r) for r in I.read_counted_patterns(spark, f"{tmp_path}/p").orderBy("pattern_id").collect()] == [(0, "abc"), (1, "xyz")]
    rows = spark.createDataFrame([("12\tab",), ("cd",)], "pattern string")
    assert sorted(map(tuple, I.weighted_patterns(rows).collect())) == [("ab", 12), ("cd", 1)]
    assert sorted(map(tuple, I.weighted_patterns(rows.limit(1), 2).collect())) == [("\tab", 12)]
    (tmp_path / "q").write_text("RATE = 32\njunk\nFLAGS = 1\n")
    assert I.read_parameters(spark, f"{tmp_path}/q") == {"RATE": 32, "FLAGS": 1}


def test_cutting(spark):
    t = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None)], "id int, text string")
    assert [tuple(r) for r in I.fixed_width(t, "text", "3", "id").orderBy("part").collect()] == [(1, 0, "abc"), (1, 1, "def"), (1, 2, "g")]
    lines = spark.createDataFrame([(0, ">h"), (1, "A C"), (2, "G -"), (3, "T G")], "n int, line string")
    assert I.alignment_column(lines, "n", "line", 1).first()["text"] == "CG"
    d = spark.createDataFrame([(1, "<t>a\nb</t>x<t>c</t>")], "id int, text string")
    assert [r["value"] for r in I.tagged_documents(d, "text", "t", "id").orderBy("part").collect()] == ["a\nb", "c"]


def test_metrics_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(15, 1, 4.5, None, 1.0, 17.0, 384, 2.0, None), (16, 2, 1.0, 3, None, None, None, 0.0, 7.5)], I.METRICS)
    sinks.write_metrics(rows, f"{tmp_path}/m")
    got = I.read_metrics(spark, f"{tmp_path}/m").select(*rows.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))


def test_streaming_index(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("ACGTAC",)], "seq string").write.parquet(str(source))
    run = lambda: grow_index(spark.readStream.schema("seq string").parquet(str(source)), [3], f"{tmp_path}/index", f"{tmp_path}/check").awaitTermination()
    run()
    spark.createDataFrame([("TACG",)], "seq string").write.mode("append").parquet(str(source))
    run()
    both = spark.createDataFrame([("ACGTAC",), ("TACG",)], "seq string")
    key = lambda df: sorted(map(tuple, df.select("k", "kmer", "m").collect()))
    assert key(read_index(spark, f"{tmp_path}/index")) == key(K.build_index(both, [3]))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "r.fa").write_text(">a\nAGTCATC\n>b\nTCATA\n")
    cli.main(["exact", "-r", f"{tmp_path}/r.fa", "-o", f"{tmp_path}/m", "-k", "5", "-K", "5", "-A", "1"])
    row = I.read_metrics(spark, f"{tmp_path}/m").first()
    assert (row["nr_nodes"], row["nr_edges"], row["nr_unitigs"], row["e_size"]) == (4, 3, 3, 6)
    cli.main(["unitigs", "-r", f"{tmp_path}/r.fa", "-o", f"{tmp_path}/u", "-k", "5", "-a", "1"])
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/u").collect()]
    assert sorted(x for x in lines if x[0] != ">") == ["AGTCAT", "GATGAC", "GTCATA"]
    cli.main(["index", "-r", f"{tmp_path}/r.fa", "-o", f"{tmp_path}/i", "-k", "4", "-K", "5"])
    cli.main(["landscape", "-l", f"{tmp_path}/i", "-o", f"{tmp_path}/n", "-k", "5", "-A", "1"])
    cli.main(["landscape", "-r", f"{tmp_path}/r.fa", "-o", f"{tmp_path}/o", "-k", "5", "-K", "5", "-A", "1", "--census"])
    key = lambda path: sorted(map(str, I.read_metrics(spark, path).collect()))
    assert key(f"{tmp_path}/n") == key(f"{tmp_path}/o") != []
    many = "\n".join(f"line {i} two" for i in range(1500))
    (tmp_path / "many.txt").write_text(many)
    capsys.readouterr()
    cli.main(["grep", "two", f"{tmp_path}/many.txt"])
    assert capsys.readouterr().out.strip() == many
    cli.main(["grep", "two", f"{tmp_path}/many.txt", "-C", "1", "-o", f"{tmp_path}/snippets"])
    assert spark.read.text(f"{tmp_path}/snippets").count() == 1500
    (tmp_path / "p.txt").write_text("two\nline 7\nnone\n")
    cli.main(["patterns", f"{tmp_path}/p.txt", f"{tmp_path}/many.txt", "-s"])
    assert capsys.readouterr().out.split("\n")[:3] == ["two\t1\t1500\t1500", "line 7\t1\t111\t111", "none\t1\t0\t0"]
    cli.main(["patterns", f"{tmp_path}/p.txt", f"{tmp_path}/many.txt", "-o", f"{tmp_path}/res"])
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/res/selected").collect()) == ["line 7", "two"]
    assert spark.read.parquet(f"{tmp_path}/res/found").count() == 1611
    (tmp_path / "t.txt").write_text("one two\nthree\ntwo\n")
    capsys.readouterr()
    cli.main(["grep", "two", f"{tmp_path}/t.txt", "-c"])
    assert capsys.readouterr().out.strip() == "2"


def test_counted_patterns_in_parts(spark):
    """The parts, one after another, are the text of the whole file."""
    patterns = spark.createDataFrame([(i * 3, f"p{i:03d}") for i in range(57)], "pattern_id long, pattern string").repartition(4)
    rows = sinks.counted_parts(patterns, "some", 10).sort("part").collect()
    assert len(rows) == 7
    assert "".join(r["value"] for r in rows) == sinks.counted_patterns(patterns, "some").first()["value"]
    assert sinks.counted_parts(patterns.where("pattern_id < 0"), "none", 10).count() == 1
