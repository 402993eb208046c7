"""Paths as Spark resolves them, and their file systems as tasks open them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as Spark itself would resolve it, with the scheme of its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def opened(folder: str):
    """The Arrow file system of a qualified folder (hdfs, s3, gs, file), and the path in it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)
