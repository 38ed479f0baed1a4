"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset a local folder serves a local session, and on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe when executors are lost."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MADE: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` stores of the table at ``source``, the same for all who ask under ``name`` while the session and the table's time of change are the same."""
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    changed = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
    key = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), source, changed, name)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]
