"""Session helpers: table reading, shared-folder materialisation and checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, as a lazily read DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset and the master is local (tests on one
    machine) is a temporary folder chosen and set, so that later calls see the same one; on a cluster that raises
    ValueError, as each executor would write to a disk of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="raylattice-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """``df`` as written to the shared folder: lineage ends here and a lost executor costs nothing."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, row_bytes: int, limit_bytes: int = 64 << 20) -> bool:
    """Whether ``df`` has a proven size below ``limit_bytes``; reads at most the rows that decide it."""
    most = max(1, limit_bytes // row_bytes)
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, row_bytes: int, limit_bytes: int = 64 << 20) -> DataFrame:
    """A broadcast hint on ``df`` where its counted size allows one; else ``df`` as it is (a shuffle join)."""
    return F.broadcast(df) if small_enough(df, row_bytes, limit_bytes) else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the session has cores, for stages that compute much per row.

    A scan of many files or blocks has more and stays as it is; only a few small files are shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def placed(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``df`` with ``name``, each row's place from 0 in the given order. Rows are split by range and sorted, then each
    part begins after the counts of those before; no part holds all rows. Ties of all of ``order`` take any place."""
    parts = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order))
    rows = parts.withColumns({"part_": F.spark_partition_id(), "row_": F.monotonically_increasing_id()})
    rows = rows.withColumn("row_", F.col("row_").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))  # a row per partition
    before = counts.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start_"))
    return rows.join(F.broadcast(before), "part_").withColumn(name, (F.col("start_") + F.col("row_")).cast("bigint")).drop("part_", "row_", "start_")
