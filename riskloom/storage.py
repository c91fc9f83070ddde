"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    A cluster must name one. A local session that names none, as in a test, gets a folder of its
    own that goes when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="riskloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a result that several steps use to the shared folder, and read it back."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _located(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever the session's file systems keep it."""
    system, path = _located(spark, folder)
    system.delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    system, path = _located(spark, folder)
    return system.exists(path)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies directly in a folder; for folders of few entries."""
    system, path = _located(spark, folder)
    return sorted(status.getPath().getName() for status in system.listStatus(path))


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later step reads."""
    for table in tables:
        shared = os.path.basename(shared_folder(table.sparkSession))
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if folder.split("/")[-2:-1] == [shared]:
                delete(table.sparkSession, folder)
