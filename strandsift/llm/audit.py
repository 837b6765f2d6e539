"""Interaction audit of document filters: what each filter removes in every order of applying them.

The flags of all documents (which filters a document fails) are crossed with all orders of the filters, which are
broadcast: n! rows for n filters, 120 here.  Each pair of document and order gives the place of the first filter that
the document fails, its steps are exploded, and counts are summed by (part, order, step), inside tasks first.

Defined cases: a null text is an empty one; a null source is the part ''; rows that repeat a doc_id are documents of
their own, and none of them is a copy of another one with the same doc_id; a null doc_id is no smaller than any other,
has no smaller one and no label; of several labels of a document each that says 1 holds.  An empty table gives no row.
Texts of any length are read once, and leave the scan as a digest of 32 bytes and flags.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one task crosses with the orders.
ROWS = 200_000


def text_filters(text: Column) -> dict[str, Column]:
    """The filters A to D of a text: true where it fails.  E, identical texts, needs the whole table."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, points = F.size(words).cast("long"), F.length(text).cast("long")
    bare = F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n,
        "C": 100 * (points - bare) > 5 * points,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, filters: Mapping[str, Column], copies: str) -> DataFrame:
    """(doc_id, part, mask): bit i of ``mask`` is set where a document fails the i-th filter in the order of letters.

    ``filters`` are conditions on a document's own columns; the letter ``copies`` stands for texts that a smaller doc_id
    has too.  The smallest doc_id of a text is found by a sum over digests, and given back to its own row by a join on
    digest and doc_id, which spreads the rows of a text with many copies.
    """
    letters = sorted([*filters, copies])
    bit = {x: 1 << i for i, x in enumerate(letters)}
    own = F.lit(0)
    for x, fails in filters.items():
        own = own + F.when(fails, bit[x]).otherwise(0)
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")
    rows = durable(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), digest, own.cast("int").alias("mask")), "flags")
    known = rows.where("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = known.join(first, ["digest", "doc_id"], "left")
    judged = marked.select("doc_id", "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(bit[copies])).alias("mask"))
    return judged.unionAll(rows.where("doc_id is null").select("doc_id", "part", "mask"))


def with_labels(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``failed`` with good (quality 1) and toxic (toxic 1)."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = failed.where("doc_id is not null").join(marks, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return known.unionAll(failed.where("doc_id is null").select("part", "mask", F.lit(False), F.lit(False)))


def replay(flags: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of
    ``flags`` (part, mask, good, toxic) for every order of ``letters``."""
    spark, n = flags.sparkSession, len(letters)
    orders = [(i, "".join(p), [1 << letters.index(x) for x in p]) for i, p in enumerate(permutations(letters))]
    table = spark.createDataFrame(orders, "number int, filter_order string, bits array<int>")
    first = F.lit(n + 1)
    for i in reversed(range(n)):
        first = F.when(F.col("mask").bitwiseAND(F.col("bits")[i]) != 0, i + 1).otherwise(first)
    crossed = flags.crossJoin(F.broadcast(table.select("number", "bits"))).withColumn("first", first)
    steps = crossed.select("part", "number", "first", "mask", "good", "toxic", F.posexplode("bits").alias("i", "bit")).withColumn("step", F.col("i") + 1)
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("first") == F.col("step")
    counts = steps.groupBy("part", "number", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(gone).alias("removed"),
        F.count_if(fails & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("mask") == F.col("bit")).alias("unique_fails"),
        F.count_if(gone & F.col("good")).alias("good_lost"),
        F.count_if(gone & F.col("toxic")).alias("toxic_lost"),
    )
    rows = durable(counts.join(F.broadcast(table.select("number", "filter_order")), "number").drop("number"), "audit")
    letter = F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter")
    share = rows.groupBy("part", letter).agg(F.sum("removed").alias("shapley"))
    return rows.select("*", letter).join(share, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E (see :func:`text_filters`) over all documents, by source."""
    filters = text_filters(F.col("text"))
    flags = with_labels(failures(docs.select("doc_id", "text", "source"), filters, "E"), labels)
    n = max(2 * docs.sparkSession.sparkContext.defaultParallelism, docs.count() // ROWS + 1)
    return replay(flags.repartition(n), "".join(sorted([*filters, "E"])))
