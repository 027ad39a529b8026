"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session may leave it unset, as in tests: a cluster's executors do not share local folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "/tmp/wareflow-checkpoints").rstrip("/")


def _file_system(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at the end of the application."""
    root = f"{shared_dir(spark)}/wareflow/{spark.sparkContext.applicationId}"
    where, files = _file_system(spark, root)
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of the application, when no query that reads them is left."""
    where, files = _file_system(spark, f"{shared_dir(spark)}/wareflow/{spark.sparkContext.applicationId}")
    files.delete(where, True)


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and survives lost executors. Options are the writer's."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._scratch_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more; everything made from them must have been written."""
    for table in tables:
        where, files = _file_system(table.sparkSession, table._scratch_path)
        files.delete(where, True)


def anew(key: str) -> Column:
    """An equal column (of a whole number) whose partitioning Spark does not carry over: a join of an aggregate on it shuffles both sides
    for the join alone, and then adaptive execution can split hot keys, which it cannot do below an aggregate."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("long"))
