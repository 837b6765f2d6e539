"""Whitening of embeddings by a two-pass covariance.

Entries become integers, x = floor(256 c).  The fit list holds each distinct x once: vectors are packed into as few bytes
as hold them, and a sum over packed vectors makes them distinct, so what is shuffled is a quarter to a half of the input,
and a common vector is one row of each task.  Over the fit list, the first pass sums integers exactly, which gives the
mean; the second sums products of centred rows, a matrix product in numpy for each block of rows.  Both are merged by
treeAggregate, so the driver gets one matrix of d x d numbers whatever the number of rows.  LAPACK's symmetric solver
gives the components, and the projection on the first ones, d x 4 numbers, goes to every task with its closure.

Defined cases: rows go whose vector is null, empty or holds a null or a non-finite entry, and rows whose vector hasn't
the length that most of the others have (of equally common lengths, the greatest).  Entries beyond the range of a long
saturate.  Repeated rows stay in the result and are one row of the fit list.  A component without variance has null in
whitened; explained is null where there is no variance at all, and identity_error is over the components that have some,
null if there are none.  A deviation beyond the range of a long is null.  Equal eigenvalues give some orthogonal
directions of their space.  An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import durable

SCALE = 256
BLOCK = 4096
WIDTHS = (np.int8, np.int16, np.int32, np.int64)
OUTPUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the rows with ``dim`` finite entries, and these rows' integers."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    values = col.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
    good = np.isfinite(values).all(axis=1)
    scaled = np.floor(values[good] * SCALE)
    # a float cannot hold 2 ** 63 - 1, so saturated entries are set after the cast
    high, low = scaled >= 2.0**63, scaled < -(2.0**63)
    x = np.where(high | low, 0.0, scaled).astype(np.int64)
    x[high], x[low] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    return rows[good], x


def pack(x: np.ndarray) -> list[bytes]:
    """Each row in as few bytes an entry as hold it, after a byte that tells how many."""
    out: list[bytes] = [b""] * len(x)
    most, least = x.max(axis=1), x.min(axis=1)
    width = np.full(len(x), 3)
    for i in (2, 1, 0):
        limits = np.iinfo(WIDTHS[i])
        width[(least >= limits.min) & (most <= limits.max)] = i
    for i, kind in enumerate(WIDTHS):
        for row in np.flatnonzero(width == i):
            out[row] = bytes([i]) + x[row].astype(kind).tobytes()
    return out


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    x = np.empty((len(rows), dim), np.int64)
    for i, row in enumerate(rows):
        x[i] = np.frombuffer(row, WIDTHS[row[0]], dim, 1)
    return x


def blocks(batches: Iterator[pa.RecordBatch], dim: int, column: int = 0) -> Iterator[np.ndarray]:
    """Packed rows as matrices of at most BLOCK rows."""
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            yield unpack(b.column(column).slice(lo, BLOCK).to_pylist(), dim)


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Column sums as Python's integers where longs could overflow."""
    if len(x) and max(-int(x.min()), int(x.max())) >= 2**62 // BLOCK:
        return x.astype(object).sum(axis=0)
    return x.sum(axis=0).astype(object)


def tree_sum(df: DataFrame, part: Callable, zero, depth: int = 2):
    """The sum, over all tasks, of what ``part`` makes of a task's batches (a tuple of numbers or arrays): each task
    leaves one row, and treeAggregate merges them in ``depth`` levels."""
    import pickle

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([pickle.dumps(part(batches))], pa.binary())], ["sums"])

    add = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
    return df.mapInArrow(each, "sums binary").rdd.map(lambda r: pickle.loads(r["sums"])).treeAggregate(zero, add, add, depth)


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and the unit eigenvectors of the first ``most``; the largest entry of each is positive."""
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1][:, :most]
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return e, v * sign


def whiten(rows: DataFrame, vector: str, keep: str, most: int = 4) -> DataFrame:
    """(keep, component, n, deviation, whitened, explained, identity_error) for each row and component up to ``most``; see
    the module's text."""
    vectors = rows.select(F.col(keep), F.col(vector).cast("array<double>").alias("_v"))
    dim = vectors.where("size(_v) > 0").groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = T.StructType([rows.schema[keep], *T.StructType.fromDDL(OUTPUT).fields])
    spark = rows.sparkSession
    if dim is None:
        return spark.createDataFrame([], schema)
    d = int(dim["d"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, x = matrix(b.column(0), d)
            if len(found):
                yield pa.record_batch([pa.array(pack(x), pa.binary())], ["x"])

    fit = durable(vectors.select("_v").mapInArrow(packed, "x binary").distinct(), "fit")

    def sums(batches):
        n, s = 0, np.zeros(d, object)
        for x in blocks(batches, d):
            n, s = n + len(x), s + exact_sum(x)
        return n, s

    n, total = tree_sum(fit, sums, (0, np.zeros(d, object)))
    if not n:
        return spark.createDataFrame([], schema)
    whole = np.array([int(s) // n for s in total], np.int64)  # the mean is this and a fraction, told apart for exact differences
    part = np.array([int(s) % n / n for s in total])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole).astype(np.float64) - part

    def products(batches):
        v = np.zeros((d, d))
        for x in blocks(batches, d):
            c = centred(x)
            v += c.T @ c
        return (v,)

    cov = tree_sum(fit, products, (np.zeros((d, d)),))[0] / n
    e, v = components((cov + cov.T) / 2, most)
    k, trace = v.shape[1], float(np.trace(cov))
    has = e[:k] > max(float(e[0]), 0.0) * d * np.finfo(float).eps
    project = np.where(has, v / np.sqrt(np.where(has, e[:k], 1.0)), 0.0)

    def check(batches):
        s, p = np.zeros(k), np.zeros((k, k))
        for x in blocks(batches, d):
            w = centred(x) @ project
            s, p = s + w.sum(axis=0), p + w.T @ w
        return s, p

    error = None
    if has.any():
        s, p = tree_sum(fit, check, (np.zeros(k), np.zeros((k, k))))
        off = p / n - np.outer(s / n, s / n) - np.eye(k)  # s is 0 but for rounding
        error = float(np.abs(off[np.ix_(has, has)]).max())
    explained = [float(x) / trace if trace > 0 else None for x in e[:k]]
    small = n * (max(-int(min(total)), int(max(total)), 1) // n + 1)

    def deviations(x: np.ndarray) -> list[int | None]:
        """Exact sums of squares of n x - S: longs where they suffice, Python's integers elsewhere."""
        bound = n * max(-int(x.min()), int(x.max())) + small
        if bound < 2**31 and d * bound * bound < 2**63:
            y = n * x - total.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        y = n * x.astype(object) - total
        return [None if t >= 2**63 else int(t) for t in (y * y).sum(axis=1)]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                piece = b.slice(lo, BLOCK)
                found, x = matrix(piece.column(1), d)
                if not len(found):
                    continue
                m = len(found)
                each = np.repeat(np.arange(m), k)
                dev = pa.array(deviations(x), pa.int64()).take(pa.array(each))
                whitened = pa.array((centred(x) @ project).ravel(), mask=np.tile(~has, m))
                yield pa.record_batch(
                    [
                        piece.column(0).take(pa.array(found[each])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)),
                        dev,
                        whitened,
                        pa.array(explained * m, pa.float64()),
                        pa.array([error] * (m * k), pa.float64()),
                    ],
                    schema.names,
                )

    return vectors.mapInArrow(projected, schema)
