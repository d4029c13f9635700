"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, one under /tmp on a single machine, as in tests; an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or "file:///tmp/checkpoints").rstrip("/")


def application_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the application ends."""
    top = f"{shared_dir(spark)}/branchlight/{spark.sparkContext.applicationId}"
    if top not in _FOLDERS:
        _FOLDERS.add(top)
        atexit.register(delete, spark, top)
    return top


def write_table(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read again; the folder is remembered for dropped()."""
    df.write.option("compression", "zstd").parquet(path)
    return read_table(df.sparkSession, path, df.schema)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    table = spark.read.schema(schema).parquet(path)
    table._branchlight_folder = path
    return table


def folder_of(table: DataFrame) -> str | None:
    return getattr(table, "_branchlight_folder", None)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and outlives executors. It goes when the application ends, unless dropped() sooner."""
    return write_table(df, f"{application_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}")


def delete(spark: SparkSession, path: str) -> None:
    """What can't be deleted, as when the JVM is gone already, is only disk."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:
        pass


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        if folder_of(t):
            delete(t.sparkSession, folder_of(t))
