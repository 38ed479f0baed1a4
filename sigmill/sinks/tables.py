"""Sinks for chunks, exported samples and audit logs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sigmill.functions.scalars import crc32_hex, float_bytes, whole_quotient
from sigmill.operators.envelope import fill_gaps
from sigmill.sources.logs import AUDIT_COLUMNS


#: A block's time as it reads in UTC, whatever the session's time zone.
_UTC = "timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(sample_time as decimal(18, 3)) / 1000)"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def new_run(spark: SparkSession, root: str, run: str) -> str:
    """``run``, or with _001, _002, ... the first name that no folder under ``root`` has."""
    name, n = run, 0
    while _exists(spark, f"{root}/run_id={name}"):
        n += 1
        name = f"{run}_{n:03d}"
    return name


def write_samples(samples: DataFrame, path: str, width: int) -> DataFrame:
    """Stores samples by device and bin of ``width`` positions, in order of channel and position, and returns the table (with ``bin``).

    Ranges of it are read by ``slice_range(..., width=width)``, which opens only
    the folders and row groups that they touch. A device's bin is dealt by
    channel, so that one device is no task of its own.
    """
    binned = samples.withColumn("bin", whole_quotient(F.col("sample_idx"), F.lit(width)))
    binned.repartition("device_id", "bin", "channel").sortWithinPartitions("device_id", "bin", "channel", "sample_idx").write.partitionBy("device_id", "bin").parquet(path)
    return samples.sparkSession.read.schema(binned.schema).parquet(path).select(*samples.columns, "bin")


def write_chunks(chunks: DataFrame, root: str, run: str, codec: str = "zstd") -> str:
    """Writes chunks (with segment) as Parquet under the run's folder, which is never reused; returns the run's name.

    A segment's chunks come together first, so that its folder has a file and not
    one of each task; a segment larger than a partition should be is split.
    """
    name = new_run(chunks.sparkSession, root, run)
    rows = chunks.withColumn("run_id", F.lit(name))
    if "payload" in chunks.columns:
        rows = rows.withColumn("payload_crc32", F.crc32("payload"))
    rows.hint("rebalance", "segment").write.mode("append").option("compression", codec).partitionBy("run_id", "segment").parquet(root)
    return name


#: So many channels are counted while they are written.
OBSERVED = 2000


def export_samples(samples: DataFrame, ranges: DataFrame, path: str, source: str | None = None, keys: tuple[str, ...] = ("device_id", "channel"), slice_samples: int = 1 << 20) -> DataFrame:
    """Writes every position of the ranges in the order of channels and positions, gaps as zero; returns (keys, written).

    The target must be new and not in the source's folder. A slice of a range
    without any sample is an error, and nothing is kept then. What was written
    of each channel is observed as it is written (``DataFrame.observe``), and not
    read again; of more channels than ``OBSERVED`` it is counted from the files.
    """
    spark = samples.sparkSession
    target = path.rstrip("/") + "/"
    if source and (target.startswith(source.rstrip("/") + "/") or (source.rstrip("/") + "/").startswith(target)):
        raise ValueError("the target is in the source's folder")
    if _exists(spark, path):
        raise FileExistsError(path)
    part = f"{target[:-1]}-{uuid.uuid4().hex}.part"  # takes its name when it is known to be whole
    filled = fill_gaps(samples, ranges, keys, slice_samples)
    want = ranges.filter("sample_count > 0").groupBy(*keys).agg(F.sum("sample_count").alias("wanted"))
    placed = filled.repartitionByRange(*keys, "sample_idx").sortWithinPartitions(*keys, "sample_idx")
    channels = want.limit(OBSERVED + 1).collect()
    if seen := len(channels) <= OBSERVED and bool(channels):
        progress = Observation(f"export {part}")
        same = lambda r: reduce(Column.__and__, (F.col(k).eqNullSafe(F.lit(r[k])) for k in keys))
        placed = placed.observe(progress, *(F.count_if(same(r)).alias(f"n{i}") for i, r in enumerate(channels)))
    placed.write.parquet(part)
    if seen:
        told = [(*(r[k] for k in keys), progress.get[f"n{i}"]) for i, r in enumerate(channels)]
        kinds = dict(want.dtypes)
        got = spark.createDataFrame([t for t in told if t[-1]], ", ".join([*(f"{k} {kinds[k]}" for k in keys), "written bigint"]))
    else:
        got = spark.read.schema(filled.schema).parquet(part).groupBy(*keys).agg(F.count("*").alias("written"))
    short = want.join(got, list(keys), "left").filter("coalesce(written, 0) <> wanted").head()
    made = spark._jvm.org.apache.hadoop.fs.Path(part)
    fs = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if short:
        fs.delete(made, True)
        raise ValueError(f"no samples in a slice of {short}")
    if not fs.rename(made, spark._jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"{part} could not be renamed")
    return got if seen else spark.read.schema(filled.schema).parquet(path).groupBy(*keys).agg(F.count("*").alias("written"))


def write_audit(blocks: DataFrame, path: str) -> None:
    """Writes a row with its checksum for each block: a CSV log with header."""
    rows = blocks.withColumns({"crc32": crc32_hex(float_bytes("payload")), "utc": F.date_format(F.expr(_UTC), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")})
    rows.select(*AUDIT_COLUMNS).write.option("header", True).option("escape", '"').csv(path)
