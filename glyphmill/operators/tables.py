"""Tables that cut lineage: written once in the folder that all machines share, deleted when nothing reads them any more."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_standing: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local master without one gets a temporary folder; a cluster must name one."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share, or give a store")
        named = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that ``release`` deletes."""
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    _standing.append(path)
    return path


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """df written and read again, so that no later step computes it anew (or calls a model again). It stands until ``release``."""
    spark = df.sparkSession
    path, key = new_folder(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")  # the table takes the place of the shuffles that made it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that stand, once the results that read them are written; returns how many."""
    n = len(_standing)
    jvm = spark.sparkContext._jvm
    while _standing:
        at = jvm.org.apache.hadoop.fs.Path(_standing.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return n
