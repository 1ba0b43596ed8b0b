"""Intermediate tables in the folder that driver and executors share, and files of any store that Arrow knows."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """That of ``spark.checkpoint.dir``, else ``loomtext-checkpoints`` in the warehouse; never a folder of one machine alone."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/loomtext-checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: what is read twice afterwards is the same both times, lost executors or not."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder: later readings take the columns that they need, compressed."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it: a URI that Arrow knows, else a local or mounted path."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
