"""A cleaning pipeline over ``documents``: quality rules, near-dedup, substring dedup, benchmark decontamination and
mixing of sources.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the documents it leaves, with the
columns of ``documents``; the last adds ``copy`` and ``shuffle_key``.  Every stage works on all that the one before
it has kept.

Defined cases, for all stages: an empty table gives an empty one; other columns go through as they are and may have any
names; repeated rows are judged alike.  What a stage makes of nulls and empty texts is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandsift.llm.decontaminate import drop_contaminated
from strandsift.llm.durable import durable
from strandsift.llm.minhash import drop_near_duplicates
from strandsift.llm.mixing import mix_sources
from strandsift.llm.quality_trees import keep_good
from strandsift.llm.substring import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the trees fitted on labels.quality reject go.

    Null and empty texts fail the base rule; a null doc_id is judged by its text; without labels of both kinds the base
    rule alone decides.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (a Jaccard similarity of 0.8 over five-word shingles) the smallest doc_id stays.

    Rows with a null doc_id, and texts without a word, all stay; of rows that repeat a doc_id and its text one stays.
    """
    return drop_near_duplicates(docs, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 50-word windows that a document with a smaller doc_id has are cut out; no document goes.

    Rows with a null doc_id, and null texts, stay as they are and take nothing from others; rows that repeat a doc_id
    count as one document.
    """
    return remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item, up to a fifth of its tokens changed, go.

    Null and empty texts hold no passage and stay; items without a token match nothing; a null doc_id makes no difference.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources get the same expected number of documents, in shuffled order.

    A null source is one of its own; a null doc_id is drawn by its text; rows that repeat a doc_id get equal numbers of
    copies.
    """
    return mix_sources(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The trees, the signatures and the edit distances have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves is written to the shared folder before the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
