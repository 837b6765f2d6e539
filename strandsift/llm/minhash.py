"""MinHash near-dedup with HyperMinHash signatures.

A signature has 128 buckets; a bucket keeps, of the least hash that falls into it, the number of leading zeros
(6 bits) and the 10 bits after the first one.  Bands of five registers give candidates.  The collision-corrected
Jaccard estimate of the registers removes candidates far below the threshold, full shingle sets confirm the rest.

Scale: documents with equal shingle sets are one node, so groups of copies cost one row each.  Within a band
bucket, members are compared with a centre (the member with most support over all its buckets); members that
stay in other components are compared with further centres, and only what is left after that is paired among
different components.  So no link is lost, and a large group of near copies costs a few comparisons a member.
Documents that merely share a passage also meet in buckets: bucket rows carry the set size, one bit of each register
and a few bits of each of 128 parts of the set, and a pair leaves the join only if these allow the threshold.  What is
summed by bucket is written down before it is joined, so that each join has a bare exchange on either side, which Spark
splits where a bucket is hot.  Texts are read where they lie, and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .components import components
from .durable import drop, durable
from .names import fresh
from .words import FACTORS, FOLDED, Words, binaries, grams, mix, scan, signed, slices, whole

SHINGLE = 5
BUCKETS = 128
ROWS = 5
BANDS = BUCKETS // ROWS
MANTISSA = 10
#: Chance that the bit sketch drops a pair at the threshold: far below that of meeting in no band.
MISS = 1e-9
#: The ids whose sets are needed are told by a bitmap with 16 bits for each id, at most 2 ** MAX_BITS in all (32 MB): where
#: there are more ids than that serves, more sets are written than needed, and no other.
MAX_BITS = 28
EMPTY = 0xFFFF


def shingle_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents in a row, and each document's number of them.

    A document with fewer than ``k`` words has its whole sequence as one shingle, one without words has none.
    """
    h, at = grams(words, k)
    first = np.searchsorted(at, words.first)
    parts, sizes = [], np.zeros(len(words.first) - 1, np.int64)
    for d, n in enumerate(words.counts()):
        if n >= k:
            one = np.sort(h[first[d] : first[d + 1]])
            keep = np.empty(len(one), bool)
            keep[0] = True
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            one = one[keep]
        elif n:
            one = np.array([whole(words.hash[words.first[d] : words.first[d + 1]])], np.uint64)
        else:
            continue
        parts.append(one)
        sizes[d] = len(one)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), sizes


def registers(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers, a row of 128 uint16 for each document."""
    regs = np.full(len(sizes) * BUCKETS, EMPTY, np.uint16)
    if len(sets):
        cell = np.repeat(np.arange(len(sizes)) * BUCKETS, sizes) + (sets >> np.uint64(57)).astype(np.int64)
        head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])  # sets are sorted: the first of a bucket is its least
        rest = sets[head] << np.uint64(7)
        zeros = (53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)
        bits = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
        regs[cell[head]] = (zeros << np.uint64(MANTISSA) | bits).astype(np.uint16)
    return regs.reshape(len(sizes), BUCKETS)


def bands(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all bands that have a register in use, in a row, and their number for each document."""
    cut = regs[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS)
    h = mix((cut.astype(np.uint64) * FACTORS[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * FACTORS[8])
    used = (cut != EMPTY).any(axis=2)
    return h[used], used.sum(axis=1)


def jaccard_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Collision-corrected estimates for rows of registers.

    Two different minima of sets of n and m elements agree in leading zeros and mantissa with a probability of
    about 0.7213 / 2**10 * n m / (n + m)**2 (the mean relative width of a register's cell, over the density of
    two exponential minima); that share is taken out of the matches.
    """
    either = (a != EMPTY) | (b != EMPTY)
    match = ((a == b) & either).sum(axis=1) / np.maximum(1, either.sum(axis=1))
    na, nb = na.astype(float), nb.astype(float)
    chance = 0.7213 / (1 << MANTISSA) * na * nb / (na + nb) ** 2
    return np.clip((match - chance) / (1 - chance), 0, 1)


def bit_sketch(regs: np.ndarray) -> np.ndarray:
    """The last mantissa bit of each register in two 64-bit numbers for each document."""
    return np.packbits(np.where(regs == EMPTY, 0, regs & 1).astype(np.uint8), axis=1).view(np.int64)


def most_bits(percent: int) -> int:
    """Sketch bits that may differ: the least number that a pair at the threshold exceeds with a chance below MISS."""
    p = (1 - percent / 100) / 2
    chance, most = 1.0, -1
    while chance >= MISS:
        most += 1
        chance -= math.comb(BUCKETS, most) * p**most * (1 - p) ** (BUCKETS - most)
    return most


def part_sketch(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Four hash bits of each of 128 parts of a set (by the last bits of its members), in eight 64-bit numbers.

    Each part that differs holds a shingle that only one of two documents has, so the number of different parts bounds
    the size of the symmetric difference from below, without error.
    """
    cell = np.repeat(np.arange(len(sizes)) * BUCKETS, sizes) + (sets & np.uint64(BUCKETS - 1)).astype(np.int64)
    sums = np.bincount(cell, (mix(sets) >> np.uint64(60)).astype(np.float64), len(sizes) * BUCKETS).astype(np.int64) & 15
    nibbles = sums.reshape(len(sizes), BUCKETS).astype(np.uint8)
    return np.ascontiguousarray(nibbles[:, 0::2] | nibbles[:, 1::2] << 4).view(np.int64)


SKETCH = ["bits_a", "bits_b", *(f"parts_{i}" for i in range(8))]
_FIELDS = ["doc_id", "n_shingles", "set_a", "set_b", "registers", *SKETCH]


def pair_condition(percent: int) -> str:
    """What two rows (n and SKETCH; the second's names end in 2) must meet for the threshold to be possible: sizes, bits
    of the registers, and the number of parts that differ."""
    bits = " + ".join(f"bit_count({c} ^ {c}2)" for c in SKETCH[:2])
    nibbles = []
    for c in SKETCH[2:]:
        x = f"({c} ^ {c}2)"
        nibbles.append(f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & 1229782938247303441L)")
    return (
        f"100 * least(n, n2) >= {percent} * greatest(n, n2) and {bits} <= {most_bits(percent)} "
        f"and {100 + percent} * ({' + '.join(nibbles)}) <= {100 - percent} * (n + n2)"
    )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, registers, SKETCH) for every row; set_a and set_b identify the shingle set
    (null for an empty one).  Null texts count as empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets, sizes = shingle_sets(scan(b.column("text"), FOLDED))
            regs = registers(sets, sizes)
            some = sizes > 0
            at = (np.cumsum(sizes) - sizes)[some]
            key = np.zeros((2, len(sizes)), np.uint64)
            if some.any():
                key[0, some] = np.add.reduceat(sets * FACTORS[10], at)
                key[1, some] = np.add.reduceat(mix(sets ^ FACTORS[11]), at)
            ids = [pa.array(signed(mix(k)), mask=~some) for k in key]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes), *ids, binaries(list(regs)), *(pa.array(x.copy()) for x in (*bit_sketch(regs).T, *part_sketch(sets, sizes).T))],
                _FIELDS,
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        sign, f"doc_id {kind}, n_shingles long, set_a long, set_b long, registers binary, " + ", ".join(f"{c} long" for c in SKETCH)
    )


def _buckets(nodes: DataFrame) -> DataFrame:
    """(id, bucket) for every band in use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys, n = bands(np.frombuffer(b"".join(b.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(np.repeat(np.arange(b.num_rows), n))), pa.array(signed(keys))], ["id", "bucket"])

    return nodes.select("id", "registers").mapInArrow(run, "id long, bucket long")


def _with_main(rows: DataFrame) -> DataFrame:
    """``rows`` with the largest component of their bucket, the rows outside it, and all rows (of mixed buckets only)."""
    each = rows.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    main = each.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("members"))
    main = main.select("bucket", F.col("top.component").alias("main"), (F.col("members") - F.col("top.c")).alias("others"), "members").where("others > 0")
    return rows.join(durable(main, "mixed"), "bucket")


def _bitmap(ids: DataFrame) -> tuple[int, np.ndarray]:
    """A bit for each value of the first bits of an id's hash that occurs, packed: how far to shift a hash, and the bits.
    Ids may repeat.  The driver gets 32 MB at most (2 ** MAX_BITS bits), in one job."""
    about = ids.agg(F.approx_count_distinct("id")).first()[0]
    bits = min(MAX_BITS, max(16, math.ceil(math.log2(16 * max(1, about)))))
    place = F.shiftrightunsigned(F.xxhash64("id"), 64 - bits)
    rows = ids.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((((1 << bits) - 1) // 32768 + 2, 4096), np.uint8)
    for r in rows.collect():
        out[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return 64 - bits, out


def _marked(place: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which places have their bit set; bucket numbers count from 1, but for place 0."""
    bucket = np.where(place > 0, 1 + (place - 1) // 32768, 0)
    bit = np.where(place > 0, (place - 1) % 32768, 0)
    return (bitmap[bucket, bit // 8] >> (bit % 8)) & 1 > 0


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of all documents in ``ids`` (and few others): all shingle hashes, sorted, as bytes.  Texts are chosen
    where they are read, by a bitmap of the ids, and never shuffled."""
    shift, bitmap = _bitmap(ids)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            b = b.filter(pa.array(_marked(b.column("place").to_numpy(), sent.value)))
            all_, sizes = shingle_sets(scan(b.column("text"), FOLDED))
            yield pa.RecordBatch.from_arrays([b.column("id"), binaries(np.split(all_, np.cumsum(sizes)[:-1]) if b.num_rows else [])], ["id", "shingles"])

    known = docs.where("id is not null").select("id", F.shiftrightunsigned(F.xxhash64("id"), shift).alias("place"), "text")
    return known.mapInArrow(sets, "id long, shingles binary")


def _likely(pairs: DataFrame, least: float) -> DataFrame:
    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
                j = jaccard_estimate(ra, rb, *(b.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb")))
                yield b.select(["a", "b"]).filter(pa.array(j >= least))

    return pairs.mapInArrow(estimate, "a long, b long")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("sa"), b.column("sb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                    z = np.sort(np.concatenate((x, y)), kind="stable")
                    same = int(np.count_nonzero(z[1:] == z[:-1]))
                    keep[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(confirm, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, rounds: int = 2, slack: float = 0.25
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of distinct 5-word shingles
    (A-Z lower-cased); component_id is the smallest doc_id in the connected component.  ``rounds`` star rounds come
    before the rest is paired: in each bucket, the members outside its largest component with the
    others.  Candidates whose estimate is more than ``slack`` below the threshold (over five standard errors) are not verified.

    Defined cases: a null or empty text has n_shingles 0 and stands alone; a null doc_id gets a null component_id and
    is kept, since no other row can name it, and links nothing; rows that repeat a doc_id are each returned, with
    the component of their text; an empty table gives an empty result; other columns are not read.  Ids are whole
    numbers; ids of another type raise a ValueError.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be a whole number: components are named by their smallest id")
    sig = durable(signatures(docs, id_col, text_col), "signatures")
    known = sig.where("doc_id is not null and n_shingles > 0")
    # equal sets have equal signatures: grouped by all of them, a row for a set is one hash aggregate, summed inside tasks first
    nodes = durable(known.groupBy("set_a", "set_b", "n_shingles", "registers", *SKETCH).agg(F.min("doc_id").alias("rep")), "nodes")
    reps = nodes.select(F.col("rep").cast("long").alias("id"), F.col("n_shingles").alias("n"), "registers", *SKETCH)
    classes = nodes.select("set_a", "set_b", "rep")
    rows = _buckets(reps)
    shared = durable(rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    hits = durable(rows.join(shared, "bucket"), "buckets")
    support = durable(hits.groupBy("id").agg(F.sum("members").alias("support")).join(reps.select("id", "n", *SKETCH), "id"), "support")
    left = hits.select("id", "bucket").join(support, "id")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    regs = reps.select("id", "n", "registers")
    side = lambda x: regs.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    near = F.expr(pair_condition(int(percent)))
    links = spark.createDataFrame([], "a long, b long")
    labels = None
    least = percent / 100 - slack
    last = False
    fields = ("n", *SKETCH, "component")
    for turn in range(rounds + 1):
        if labels is None:
            now = left.withColumn("component", F.col("id"))
        else:
            now = left.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
            now = durable(_with_main(now), "left")
            size, pairs = now.agg(F.count("*"), F.sum("others")).first()
            if not size:
                break
            last = turn == rounds or pairs <= 8 * size
        if last:
            base = now.select("bucket", "id", *fields, "main")
            base = base.withColumn("size", F.floor(F.log("n") / F.lit(-math.log(percent / 100))).cast("int"))
            minor = base.where("component <> main").withColumn("size", F.explode(F.array(*(F.col("size") + x for x in (-1, 0, 1)))))
            other = base.select("bucket", "size", "id", *fields).withColumnsRenamed({c: f"{c}2" for c in ("id", *fields)})
            edges = minor.join(other, ["bucket", "size"]).where("component <> component2 and (component2 = main or id < id2)").where(near)
        else:
            top = F.max(F.struct("support", (-F.col("id")).alias("minus"), *fields)).alias("top")
            centre = now.groupBy("bucket").agg(top).select("bucket", (-F.col("top.minus")).alias("id2"), *(F.col(f"top.{c}").alias(f"{c}2") for c in fields))
            star = now.join(durable(centre, "centres"), "bucket").where("id <> id2")
            edges = star.where("component <> component2").where(near)
            left = star.select("id", "bucket", "support", "n", *SKETCH)
        edges = edges.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
        likely = durable(_likely(edges.join(side("a"), "a").join(side("b"), "b"), least), "likely")
        sets = durable(_full_sets(texts, likely.select(F.explode(F.array("a", "b")).alias("id"))), "sets")
        full = likely.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        new = durable(_confirmed(full, percent).distinct(), "links")
        drop(sets)
        links = links.unionAll(new)
        if turn == 0 or not new.isEmpty():
            labels = components(links, labels)
        if last:
            break
    drop(hits, support)
    place = sig.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    place = place.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    whose = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return place.select("doc_id", "n_shingles", whose.alias("component_id"), F.coalesce(F.col("doc_id") == whose, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, **options) -> DataFrame:
    """``docs``, with all columns, without the rows that :func:`near_duplicates` doesn't keep.

    Rows with a null doc_id all stay; of rows that repeat both a doc_id and its text one stays; rows without words all
    stay; an empty table gives an empty one; other columns may have any names.
    """
    gone = durable(near_duplicates(docs, id_col, text_col, percent, **options).where("not kept").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    rest = docs.join(gone, id_col, "left_anti")
    (n,) = fresh(docs, "n")
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(id_col)
    if not twice.isEmpty():
        rest = rest.join(twice, id_col, "left_anti").unionByName(rest.join(twice, id_col, "left_semi").dropDuplicates([id_col, text_col]))
    return rest.select(*docs.columns)
