"""Blocked gzip files read by many tasks against the plain text."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandsift.sources import blocked as B
from strandsift.sources.reads import load_reads, read_blocked, read_sequences


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def write(path, data: bytes, size: int, level: int = 6):
    with open(path, "wb") as f:
        for lo in range(0, len(data), size):
            f.write(member(data[lo : lo + size], level))
        f.write(member(b""))


def fastq(n, rng, most=90):
    seqs = ["".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, most))) for _ in range(n)]
    return seqs, "".join(f"@r{i} x\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(seqs))


@pytest.mark.parametrize("size, ranges", [(300, 700), (1000, 1000), (64, 97), (60000, 1 << 20), (7, 40)])
def test_ranges_give_every_line_once(tmp_path, size, ranges):
    rng = random.Random(size)
    text = fastq(60, rng)[1] + "last line without end"
    path = str(tmp_path / "x.gz")
    write(path, text.encode(), size)
    total = (tmp_path / "x.gz").stat().st_size
    lines = [x for lo in range(0, total, ranges) for x in B.range_lines(path, lo, lo + ranges)]
    assert lines == text.split("\n")


def test_stored_members_with_headers_inside(tmp_path):
    """Data that look like headers, uncompressed in their members, are no beginnings."""
    text = ("x" * 10 + "\n") * 20
    data = b"".join(member(text.encode(), 0)[:18] + b"\n" for _ in range(50))
    path = str(tmp_path / "x.gz")
    write(path, data, 500, 0)
    total = (tmp_path / "x.gz").stat().st_size
    with open(path, "rb") as f:
        starts, at, whole = [], 0, f.read()
    while at < len(whole):
        starts.append(at)
        at += B.member_size(whole[at:])
    system, name = B.file_system(path)
    with system.open_input_file(name) as f:
        for at in range(0, total, 13):
            assert B._first_member(f, total, at, total) == next((s for s in starts if s >= at), None)


def test_reads_of_blocked_files(spark, tmp_path):
    rng = random.Random(1)
    seqs, text = fastq(3000, rng)
    path = str(tmp_path / "r.fq.gz")
    write(path, text.encode(), 5000)
    got = read_blocked(spark, path, range_bytes=20_000)
    assert [r["seq"] for r in got.sort("read_id").collect()] == seqs
    assert B.read_blocked_lines(spark, path, 20_000).groupBy(F.spark_partition_id()).count().count() > 3
    whole = load_reads(spark, path).sort("read_id").collect()
    assert [(r["header"], r["seq"]) for r in whole] == [(f"r{i}", s) for i, s in enumerate(seqs)]


def test_fasta_in_blocks_and_plain_gzip(spark, tmp_path):
    text = "".join(f">s{i} about\r\n" + "".join(f"ACGT{'T' * (j % 5)}\n" for j in range(i % 7)) for i in range(200))
    want = [(f"s{i}", "".join(f"ACGT{'T' * (j % 5)}" for j in range(i % 7))) for i in range(200)]
    write(tmp_path / "b.fa.gz", text.encode(), 900)
    with gzip.open(tmp_path / "p.fa.gz", "wt") as f:
        f.write(text.replace("\r", ""))
    assert not B.is_blocked(str(tmp_path / "p.fa.gz")) and B.is_blocked(f"file://{tmp_path}/b.fa.gz")
    for name in ("b.fa.gz", "p.fa.gz"):
        assert [(r["header"], r["seq"]) for r in read_sequences(spark, str(tmp_path / name)).sort("read_id").collect()] == want


def test_damaged_and_empty_files(spark, tmp_path):
    write(tmp_path / "e.fq.gz", b"", 100)
    assert read_blocked(spark, str(tmp_path / "e.fq.gz")).count() == 0
    data = bytearray(member(b"@a\nACGT\n+\n@@@@\n") + member(b"@b\nAC\n+\n@@\n"))
    data[-12] ^= 0xFF
    (tmp_path / "d.fq.gz").write_bytes(data)
    with pytest.raises(ValueError, match="no member"):
        list(B.range_lines(str(tmp_path / "d.fq.gz"), 0, 1 << 20))
