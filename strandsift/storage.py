"""Tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

Written tables cut the lineage: an executor that is lost later takes nothing with it.  Where the setting is
missing (tests on one machine) a folder under the warehouse directory is used.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of this application."""
    conf = spark.sparkContext.getConf()
    top = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not top:
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{top.rstrip('/')}/strandsift-{spark.sparkContext.applicationId}"


def _place(spark: SparkSession, path: str):
    """A path and its file system, as Spark has them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    system, where = _place(spark, path)
    system.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _place(spark, path)
    return system.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it isn't there."""
    system, where = _place(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(where)) if system.exists(where) else []


_registered: set[str] = set()


def durable(df: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back; ``codec`` is Spark's own if none is named."""
    spark = df.sparkSession
    top = folder(spark)
    if top not in _registered:
        _registered.add(top)
        atexit.register(_forget, spark, top)
    path = f"{top}/{name}-{uuid.uuid4().hex[:12]}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`durable` has written and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_durable_path", None):
            delete(t.sparkSession, path)


def _forget(spark: SparkSession, top: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete(spark, top)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, dealt to as many tasks as there are cores where the files are cut into fewer pieces; scans of
    more pieces stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
