"""Lines and reads of blocked gzip files (BGZF) by many tasks.

Such a file is a row of gzip members of at most 64 kB each, and every member's header tells its size.  A task takes a range
of bytes, looks for the first header in it, and goes from member to member; it leaves out the line that it comes into the
middle of, and reads the line at its end to the end.  Members are checked by their own checksums as they are opened.  Files are
opened by pyarrow's file systems in the tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

RANGE = 32 << 20
MAGIC = b"\x1f\x8b\x08\x04"
#: The most bytes of a member, and of its header up to the size.
MEMBER = 1 << 16
LINES = "path string, block long, i long, value string"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def member_size(head: bytes) -> int | None:
    """The size of the member that begins with ``head``, None if it isn't one of a blocked file."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    extra = head[12 : 12 + struct.unpack("<H", head[10:12])[0]]
    at = 0
    while at + 4 <= len(extra):
        kind, size = extra[at : at + 2], struct.unpack("<H", extra[at + 2 : at + 4])[0]
        if kind == b"BC" and size == 2 and at + 6 <= len(extra):
            return struct.unpack("<H", extra[at + 4 : at + 6])[0] + 1
        at += 4 + size
    return None


def is_blocked(path: str) -> bool:
    """Whether a file begins as a blocked one; False where pyarrow can't open it."""
    try:
        system, name = file_system(path)
        with system.open_input_file(name) as f:
            return member_size(f.read(MEMBER)) is not None
    except (OSError, ValueError, pa.ArrowException):
        return False


def _first_member(f, size: int, start: int, end: int) -> int | None:
    """Where the first member from ``start`` on begins, if that is before ``end``: a header whose size leads to another one
    or to the end of the file, and whose data can be opened."""
    at, data = start, b""
    while at < end:
        if len(data) < 2 * MEMBER:
            f.seek(at)
            data = f.read(4 * MEMBER)
            if not data:
                return None
        hit = data.find(MAGIC)
        if hit < 0:
            at, data = at + max(1, len(data) - 3), b""
            continue
        at, data = at + hit, data[hit:]
        if at >= end:
            return None
        n = member_size(data)
        if n is not None and len(data) < n + 18 and at + len(data) < size:
            data = b""  # read on from here
            continue
        if n is not None and (at + n == size or member_size(data[n:]) is not None or data[n : n + 4] == MAGIC) and _opened(data[:n]) is not None:
            return at
        at, data = at + 1, data[1:]
    return None


def _opened(member: bytes) -> bytes | None:
    try:
        return zlib.decompress(member, 31)
    except zlib.error:
        return None


def range_lines(path: str, start: int, end: int) -> Iterator[str]:
    """The lines of the members that begin in a range of bytes, from the first line that begins in them on, and the line at
    their end as far as it goes."""
    system, name = file_system(path)
    with system.open_input_file(name) as f:
        size = f.size()
        at = _first_member(f, size, start, min(end, size))
        if at is None:
            return
        rest, skip = b"", start > 0
        while at < size:
            f.seek(at)
            head = f.read(MEMBER)
            n = member_size(head)
            data = None if n is None or len(head) < n else _opened(head[:n])
            if data is None:
                raise ValueError(f"{path}: no member of a blocked gzip file at {at}")
            inside = at < end
            at += n
            if skip:
                first = data.find(b"\n")
                if first < 0:
                    if inside or at < end:
                        continue
                    return
                data, skip = data[first + 1 :], False
                if not inside:
                    return  # all of the range was one line, which began before it
            if inside:
                *lines, rest = (rest + data).split(b"\n")
                for x in lines:
                    yield x.decode()
            else:
                first = data.find(b"\n")
                if first >= 0:
                    yield (rest + data[:first]).decode()
                    return
                rest += data
        if rest:
            yield rest.decode()


def read_blocked_lines(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(path, block, i, value) of all lines: block is the number of the range that a line was read in, i its number there."""
    system, name = file_system(path)
    n = max(1, -(-system.get_file_info(name).size // range_bytes))
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("i", pa.int64()), ("value", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column(0).to_pylist():
                held, first = [], 0
                for line in range_lines(path, block * range_bytes, (block + 1) * range_bytes):
                    held.append(line.removesuffix("\r"))
                    if len(held) == 10_000:
                        yield _batch(path, block, first, held, schema)
                        held, first = [], first + 10_000
                yield _batch(path, block, first, held, schema)

    return spark.range(0, n, 1, min(n, 100_000)).mapInArrow(each, LINES)


def _batch(path: str, block: int, first: int, lines: list[str], schema: pa.Schema) -> pa.RecordBatch:
    n = len(lines)
    return pa.record_batch([pa.array([path] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())], schema=schema)
