"""Where multi-step operators put intermediate tables.

Lineage is cut by writing a Parquet table into the folder that
``spark.checkpoint.dir`` names, which every executor shares, so a lost
executor never loses a step.  Only where that setting is absent (tests, a
single machine) a temporary folder of this process is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def root(spark: SparkSession) -> str:
    """The folder for intermediate tables of this session."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="tamarack-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return "file://" + _local[app]


def settle(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = f"{root(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application; returns their number.

    To be called once results are written: lazy results that read them fail
    afterwards.
    """
    jvm = spark.sparkContext._jvm
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
