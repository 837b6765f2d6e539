"""An index that grows by batches, with merged tiers, restarts and batches that run twice."""

import random

import pytest
from pyspark.sql import functions as F

from strandsift.operators import kmers as K
from strandsift.storage import children, delete
from strandsift.streaming import index as X


def key(df):
    return sorted(map(tuple, df.select("k", "kmer", "m").collect()))


def read_sets(n):
    rng = random.Random(n)
    return [[("".join(rng.choice("ACGT") for _ in range(rng.randrange(3, 30))),) for _ in range(4)] for _ in range(n)]


def test_batches_count_once(spark, tmp_path):
    sets, path = read_sets(11), str(tmp_path / "index")
    counts = [K.build_index(spark.createDataFrame(rows, "seq string"), [3, 5]) for rows in sets]
    for i, c in enumerate(counts):
        X.add_batch(c, path, i)
        if i % 3 == 0:
            X.add_batch(c, path, i)  # the batch again, after it was whole
        if i == 6:
            # a run that stopped after the part and before the manifest: the batch begins anew
            counts[7].write.parquet(f"{path}/parts/batch-{7:012d}")
            # and one that stopped inside the manifest, which isn't marked whole
            spark.createDataFrame([("nothing", 0, 99)], X.MANIFEST).write.json(f"{path}/manifests/v=7")
            delete(spark, f"{path}/manifests/v=7/_SUCCESS")
    everything = spark.createDataFrame([r for rows in sets for r in rows], "seq string")
    assert key(X.read_index(spark, path)) == key(K.build_index(everything, [3, 5]))
    tiers = [t for _, t, _ in X.parts(spark, path)]
    assert all(tiers.count(t) < X.FANOUT for t in tiers) and max(tiers) == 1
    assert len(children(spark, f"{path}/parts")) <= 2 * X.FANOUT + 2
    X.compact(spark, path)
    assert len(X.parts(spark, path)) == 1
    assert key(X.read_index(spark, path)) == key(K.build_index(everything, [3, 5]))
    X.add_batch(counts[0], path, 11)
    assert X.read_index(spark, path).agg(F.sum("m")).first()[0] > everything.count()


def test_a_stream_with_restarts_equals_one_build(spark, tmp_path):
    sets, source, path = read_sets(6), str(tmp_path / "in"), str(tmp_path / "index")
    stream = lambda: spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(source)
    real, fail = X.add_batch, {3}

    def unsafe(counts, where, number):
        real(counts, where, number)
        if number in fail:  # lost after the index had the batch, before the stream knew
            fail.discard(number)
            raise RuntimeError("lost")

    X.add_batch = unsafe
    try:
        for i in (0, 2, 4):
            for rows in sets[i : i + 2]:
                spark.createDataFrame(rows, "seq string").coalesce(1).write.mode("append").parquet(source)
            query = X.grow_index(stream(), [4], path, str(tmp_path / "check"))
            if 3 in fail and i == 2:
                with pytest.raises(Exception, match="lost"):
                    query.awaitTermination()
                query = X.grow_index(stream(), [4], path, str(tmp_path / "check"))
            query.awaitTermination()
    finally:
        X.add_batch = real
    everything = spark.createDataFrame([r for rows in sets for r in rows], "seq string")
    assert key(X.read_index(spark, path)) == key(K.build_index(everything, [4]))


def test_no_index_yet(spark, tmp_path):
    assert X.read_index(spark, str(tmp_path / "none")).count() == 0
    X.compact(spark, str(tmp_path / "none"))
