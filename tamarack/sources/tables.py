"""Parquet tables of a folder on any file system Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``: a file or a folder of part files."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def listing(spark: SparkSession, folder: str) -> list[tuple[str, str, int, int]]:
    """(table, path, bytes, time of change) of every Parquet table in ``folder``, by name; empty where there is no such folder.

    A table that is a folder counts the bytes of its files and the latest of their times.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    out = []
    for s in fs.listStatus(root):
        path = s.getPath()
        if path.getName().endswith(".parquet"):
            size, changed = s.getLen(), s.getModificationTime()
            if s.isDirectory():
                for inner in fs.listStatus(path):
                    size, changed = size + inner.getLen(), max(changed, inner.getModificationTime())
            out.append((path.getName().removesuffix(".parquet"), path.toString(), size, changed))
    return sorted(out)
