"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session in one process may leave it unset and gets a temporary folder."""
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="plateview-")
    return _local_folder


def stored(table: DataFrame, name: str) -> DataFrame:
    """Write the table once and read it back.

    Cuts the lineage on storage that outlives executors, and gives the optimizer true
    sizes, so that later joins on it choose their strategy from measured bytes. The files stay
    until ``clear_stored``, for results are read from them.
    """
    spark = table.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stored-{spark.sparkContext.applicationId}"


def clear_stored(spark: SparkSession) -> None:
    """Delete the tables that this application has stored. Call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def measured_bytes(table: DataFrame) -> int:
    """The optimizer's size of a table: the bytes of its files if it is a stored one."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(table: DataFrame, key: str, part_bytes: int | None = None) -> DataFrame:
    """Give a table that sits in few files a partition per core; a table in many files stays as it is.

    Large tables already have far more partitions than cores, so this moves only data that is
    small for the cluster. Narrow rows from which much larger ones are derived name their ``part_bytes``: there is then a partition
    for as many bytes of the table. Hashing a unique key makes the partitions even, and the same on every attempt.
    """
    wanted = table.sparkSession.sparkContext.defaultParallelism
    if part_bytes is not None:
        wanted = max(wanted, -(-measured_bytes(table) // part_bytes))
    return table.repartition(wanted, key) if table.rdd.getNumPartitions() < wanted else table
