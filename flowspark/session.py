"""Shared scratch space, settled tables and bucket numbers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting falls back to a temporary folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="flowspark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared scratch folder."""
    return f"{scratch_root(spark)}/flowspark/{uuid.uuid4().hex}/{name}"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once."""
    sc = spark.sparkContext
    if getattr(sc, "_flowspark_shipped", False):
        return
    parent = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="flowspark-"), "flowspark")
    sc.addPyFile(shutil.make_archive(archive, "zip", parent, "flowspark"))
    sc._flowspark_shipped = True


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write ``df`` to shared scratch once and read it back.

    Cuts the lineage, so later stages neither recompute it nor lose it with an executor, and
    gives Catalyst the true size on disk: a join with the result is broadcast below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffled above it, with no hint in the code.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Spread a plain file scan of fewer splits than cores, before work that is heavy per row.

    A large table has more splits than cores and is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def default_buckets(spark: SparkSession) -> int:
    """Least number of order buckets: four per shuffle partition, so that hashing them to partitions
    evens out, and 16 at least."""
    return max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
