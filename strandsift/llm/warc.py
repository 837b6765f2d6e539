"""A deterministic sharded writer and a reader of WARC archives.

Writing, in four steps, each of which survives lost executors:

1. Digests: one pass leaves (page_id, digest, bytes) of every page.  Sums over digests tell which pages are copies of a
   smaller page_id; the digests with many pages are broadcast, the others joined.
2. Shards: running sums of bytes in the order of page_id cut the pages into ranges of ``shard_bytes`` payload.  The cuts
   follow from the data alone, so the same pages give the same shards on any cluster.
3. Records: pages go to the task of their shard, sorted by page_id, and meet their row of step 1 in the sort; each task
   writes gzip members to files under temporary names, and begins a new file when one has ``roll_bytes`` compressed
   bytes.  Headers, record ids and digests are made anew from the page; nothing depends on time or place.
4. Commit: the rows of the files that successful tasks have written are the manifest.  Files take their final names,
   then the manifest is written; a reader takes only files that it lists, so what other attempts have left is not read.

A record is held in memory, a file or a shard is not.  Files are opened by pyarrow's file systems in the tasks, so the
archive's folder must be one that all machines reach (by default it lies in ``spark.checkpoint.dir``).

Defined cases: a null html is an empty payload; a null url gives a record without a target; a null page_id is greater
than all others and never the first of its copies, so that copies with null ids only are all responses; rows that repeat
a page_id are written one by one, and those with the smallest page_id of a payload are all responses; an empty table
gives an archive without files.  page_id may be a number or a string.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.running import running
from .durable import durable, folder

DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of a shard: a 64th of all, as a power of two between these bounds.
LEAST_SHARD, MOST_SHARD = 4 << 20, 1 << 30
ROLL = 256 << 20
#: A digest with more than a thousandth of all pages is hot; there are a thousand of them at most.
HOT = 1000
CHUNK = 1 << 20
#: Columns of the rows that writing tasks leave.
MANIFEST = "temp string, name string, shard int, roll int, records long, bytes long, sha256 string"
ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: str, digest: str, ordinal: int) -> str:
    """A record's URI, from the page, its payload and its number among equal ones."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page}|{digest}|{ordinal}'.encode()).digest()[:16], version=5)}"


def _field(value: str) -> str:
    """A value without line breaks, as a header holds it."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, page: str, url: str | None, payload: bytes, digest: str, ordinal: int, refers_to: str | None) -> bytes:
    """A WARC record: an HTTP response with its payload, or a revisit with the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id(page, digest, ordinal)}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _field(url)))
        if _field(url) != url:
            head.append(("X-Target", json.dumps(url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("X-Page-ID", page)]
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{record_id(refers_to, digest, 0)}>"), ("X-Refers-To-Page-ID", refers_to)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The record that a file begins with."""
    block = b"software: strandsift\r\nformat: WARC File Format 1.1\r\n"
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id(name, '', 0)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Files:
    """Files of a task: each record goes to the open file of its shard, and a full file is followed by the next one."""

    def __init__(self, top: str, roll_bytes: int) -> None:
        self.fs, self.top = file_system(top)
        self.roll_bytes, self.shard, self.roll, self.out, self.done = roll_bytes, None, 0, None, []

    def put(self, shard: int, data: bytes) -> None:
        if self.out is not None and (shard != self.shard or self.bytes >= self.roll_bytes):
            self.close()
        if self.out is None:
            self.roll = self.roll + 1 if shard == self.shard else 0
            self.shard, self.records, self.bytes, self.sha = shard, 0, 0, hashlib.sha256()
            self.name, self.temp = f"part-{shard:06d}-{self.roll:04d}.warc.gz", f"{uuid.uuid4().hex}.tmp"
            self.out = self.fs.open_output_stream(f"{self.top}/_temporary/{self.temp}", compression=None)
            self._write(member(info(self.name)))
        self._write(member(data))
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.temp, self.name, self.shard, self.roll, self.records, self.bytes, self.sha.hexdigest()))
            self.out = None


def _payload(html: str | None) -> bytes:
    return (html or "").encode("utf-8", "surrogatepass")


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, digest, bytes) of every page."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_payload(x.as_py()) for x in b.column("html")]
            yield pa.record_batch([b.column("page_id"), pa.array([base32_sha1(x) for x in found], pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "digest", "bytes"])

    schema = T.StructType([pages.schema["page_id"], T.StructField("digest", T.StringType()), T.StructField("bytes", T.LongType())])
    return pages.select("page_id", "html").mapInArrow(each, schema)


def record_types(found: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to), a row for each pair of both: refers_to is the smallest page_id with the payload,
    null for that one itself and for payloads of less than ``least_bytes`` bytes."""
    pairs = found.groupBy("page_id", "digest").agg(F.max("bytes").alias("bytes"), F.count("*").alias("n"))
    sums = durable(found.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"), "copies")
    total = max(1, found.count() // HOT)
    hot, rest = sums.where(F.col("n") > total).select("digest", "first"), sums.where(F.col("n") <= total).select("digest", "first")
    met = pairs.join(F.broadcast(hot.withColumnRenamed("first", "hot")), "digest", "left")
    plain = met.where("hot is null").drop("hot").join(rest, "digest", "left")
    both = plain.select("page_id", "digest", "first").unionAll(met.where("hot is not null").select("page_id", "digest", "hot"))
    return both.select("page_id", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def cuts(found: DataFrame, shard_bytes: int | None) -> list:
    """The first page_id of each shard but the first: one for each ``shard_bytes`` of payload."""
    sizes = found.where("page_id is not null").groupBy("page_id").agg((F.sum("bytes") + 512 * F.count("*")).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    if shard_bytes is None:
        shard_bytes = min(MOST_SHARD, max(LEAST_SHARD, 1 << (total // 64).bit_length()))
    if total <= shard_bytes:
        return []
    shards = running(sizes, F.col("bytes"), [], [F.col("page_id")]).groupBy(F.floor(F.col("before") / shard_bytes)).agg(F.min("page_id").alias("first"))
    return sorted(r["first"] for r in shards.collect())[1:]


def write_archive(pages: DataFrame, path: str, shard_bytes: int | None = None, roll_bytes: int = ROLL, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as an archive at ``path``, which must not hold one, and return its manifest
    (name, shard, roll, records, bytes, sha256)."""
    spark = pages.sparkSession
    found = durable(digests(pages), "digests")
    types = record_types(found, least_bytes)
    bounds = spark.sparkContext.broadcast(cuts(found, shard_bytes))
    n = len(bounds.value) + 1

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``batches`` with the shard, and the digest where the payload is at hand."""
        for b in batches:
            ids = b.column("page_id").to_pylist()
            shard = [n - 1 if i is None else bisect_right(bounds.value, i) for i in ids]
            cols = {name: b.column(name) for name in b.schema.names}
            if "digest" not in cols:
                cols["digest"] = pa.array([base32_sha1(_payload(x.as_py())) for x in b.column("html")], pa.string())
            cols["shard"] = pa.array(shard, pa.int32())
            yield pa.RecordBatch.from_pydict({c: cols[c] for c in names if c in cols})

    id_ = pages.schema["page_id"].dataType
    names = ["shard", "page_id", "digest", "url", "html", "refers_to"]
    kinds = {"shard": T.IntegerType(), "page_id": id_, "digest": T.StringType(), "url": T.StringType(), "html": T.StringType(), "refers_to": id_}
    schema = lambda *drop: T.StructType([T.StructField(c, kinds[c]) for c in names if c not in drop])
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(placed, schema("refers_to"))
    known = types.mapInArrow(placed, schema("url", "html"))
    nulls = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    both = known.select("shard", "page_id", "digest", nulls("url"), nulls("html"), "refers_to", F.lit(0).alias("kind")).unionAll(
        rows.select("shard", "page_id", "digest", "url", "html", nulls("refers_to"), F.lit(1).alias("kind"))
    )
    order = [F.col("shard"), F.asc_nulls_last("page_id"), F.col("digest"), F.col("kind"), F.col("url")]
    dealt = both.repartitionById(n, F.col("shard")).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, first, ordinal = Files(path, roll_bytes), None, 0
        for b in batches:
            for shard, page, digest, url, html, refers_to, kind in (tuple(c[i].as_py() for c in b.columns) for i in range(b.num_rows)):
                if kind == 0:
                    first, ordinal = refers_to, 0
                    continue
                page = json.dumps(page)
                what = "response" if first is None else "revisit"
                files.put(shard, record(what, page, url, _payload(html), digest, ordinal, None if first is None else json.dumps(first)))
                ordinal += 1
        files.close()
        if files.done:
            yield pa.RecordBatch.from_pylist([dict(zip(written_as.names, row, strict=True)) for row in files.done], schema=written_as)

    written_as = pa.schema([(c, ARROW[kind]) for c, kind in (x.split() for x in MANIFEST.split(", "))])
    system, top = file_system(path)
    if system.get_file_info(f"{top}/manifest").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{path} holds an archive")
    system.create_dir(f"{top}/_temporary", recursive=True)
    system.create_dir(f"{top}/data", recursive=True)
    written = durable(dealt.mapInArrow(write, MANIFEST), "written")
    return commit(spark, written, path)


def commit(spark: SparkSession, written: DataFrame, path: str) -> DataFrame:
    """Give the files that ``written`` lists their names, and write the manifest.  May be run again after a failure."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(path)
        for b in batches:
            for row in b.to_pylist():
                temp, final = f"{top}/_temporary/{row['temp']}", f"{top}/data/{row['name']}"
                if system.get_file_info(temp).type == pafs.FileType.File:
                    system.move(temp, final)
                elif system.get_file_info(final).size != row["bytes"]:  # an earlier attempt has moved it, or it is lost
                    raise FileNotFoundError(final)
            yield b

    kept = ["name", "shard", "roll", "records", "bytes", "sha256"]
    written.repartition(max(1, min(written.count(), 10_000))).mapInArrow(name, MANIFEST).select(*kept).sort("name").write.parquet(f"{path}/manifest")
    system, top = file_system(path)
    system.delete_dir(f"{top}/_temporary")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, shard, roll, records, bytes, sha256) of a committed archive."""
    return spark.read.parquet(f"{path}/manifest")


def members(stream) -> Iterable[tuple[int, bytes]]:
    """(offset, data) of the gzip members of a stream, one in memory at a time."""
    at, z, data, begin, rest = 0, zlib.decompressobj(31), [], 0, b""
    while True:
        block = rest or stream.read(CHUNK)
        rest = b""
        if not block:
            if data or at > begin:
                raise EOFError(f"a gzip member that begins at {begin} is cut off")
            return
        data.append(z.decompress(block))
        used = len(block) - len(z.unused_data)
        at += used
        if z.eof:
            yield begin, b"".join(data)
            rest, z, data, begin = z.unused_data, zlib.decompressobj(31), [], at


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, in lower case, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4:
        raise ValueError(f"a block of {len(rest) - 4} bytes where {size} are told")
    return fields, rest[:size]


def read_archive(spark: SparkSession, path: str, id_type: str = "long", payload: bool = False) -> DataFrame:
    """(file, offset, page_id, url, record_type, payload_bytes, payload_digest, refers_to, and payload where asked for) of
    all records of a committed archive.  Digests of responses are computed anew, and a record whose digests differ from
    its headers fails the read; the size of a revisit's payload is that of its HTTP headers."""
    files = manifest(spark, path).select("name")
    schema = T.StructType.fromDDL(f"file string, offset long, page_id {id_type}, url string, record_type string, payload_bytes long, payload_digest string, refers_to {id_type}, payload binary")
    if not payload:
        schema = T.StructType(schema.fields[:-1])
    arrow = pa.schema([(f.name, ARROW[f.dataType.simpleString()]) for f in schema.fields])

    def rows(system: pafs.FileSystem, where: str, name: str) -> Iterator[dict]:
        with system.open_input_stream(where, compression=None) as stream:
            for offset, data in members(stream):
                fields, block = parse(data)
                if fields["warc-type"] == "warcinfo":
                    continue
                if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
                    raise ValueError(f"{name} at {offset}: the block's digest differs")
                http, _, body = block.partition(b"\r\n\r\n")
                size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and (len(body) != size or base32_sha1(body) != digest):
                    raise ValueError(f"{name} at {offset}: the payload's digest differs")
                refers_to = fields.get("x-refers-to-page-id")
                yield {
                    "file": name, "offset": offset, "page_id": json.loads(fields["x-page-id"]),
                    "url": json.loads(fields["x-target"]) if "x-target" in fields else fields.get("warc-target-uri"),
                    "record_type": fields["warc-type"], "payload_bytes": size, "payload_digest": digest, "refers_to": None if refers_to is None else json.loads(refers_to),
                    **({"payload": body if fields["warc-type"] == "response" else None} if payload else {}),
                }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(path)
        for b in batches:
            for name in b.column("name").to_pylist():
                held, size = [], 0
                for row in rows(system, f"{top}/data/{name}", name):
                    held.append(row)
                    size += 256 + (row["payload_bytes"] if payload else 0)
                    if size > CHUNK:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    n = max(1, min(files.count(), 10_000))
    return files.repartition(n).mapInArrow(read, schema)


def round_trip(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) as read back from the archive that ``pages``
    are written to, at ``path`` or in the shared folder."""
    spark = pages.sparkSession
    path = path or f"{folder(spark)}/warc-{uuid.uuid4().hex[:12]}"
    write_archive(pages.select("page_id", "url", "html"), path, least_bytes=least_bytes)
    rows = read_archive(spark, path, pages.schema["page_id"].dataType.simpleString())
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
