"""Keeping a costly intermediate on shared storage."""

from __future__ import annotations

import uuid
import warnings

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors reach.

    A session without that setting gets a folder in its warehouse, the other place that all share; on a cluster
    a warehouse on plain files is told, as it may lie on the driver's disk alone.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if own is None and warehouse.startswith(("file:", "/")) and not context.master.startswith("local"):
            warnings.warn(f"spark.checkpoint.dir is not set; intermediates go to {warehouse}, which all executors must reach", stacklevel=2)
        context.setCheckpointDir(own or f"{warehouse}/_checkpoints")
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession) -> str:
    """A new place in the shared folder, deleted when the session's file system closes."""
    path = f"{shared_folder(spark)}/table-{uuid.uuid4()}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A folder as the Python side of a task opens it."""
    return pyarrow.fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and go on from the written table.

    Used where several branches read one costly intermediate. Lineage ends here, so a lost executor
    costs a re-read and not a recomputation; unlike a plain checkpoint the table still prunes
    columns, and equal branches over it share their exchanges. The table is deleted when the session's
    file system closes.
    """
    spark = df.sparkSession
    path = fresh_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
