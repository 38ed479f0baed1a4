"""Audit logs, device rate files and block streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.functions.scalars import valid_rate
from sigmill.operators.blocks import CONTIGUOUS, INTERLEAVED

# The columns of an audit log, in order.
AUDIT_COLUMNS = ["utc", "block_index", "message_type", "group_id", "machine_id", "total_data_count", "data_count_per_channel", "buffer_count", "channel_count", "layout", "crc32", "group_info"]
_NUMBERS = {"block_index": "bigint", "group_id": "int", "machine_id": "int", "total_data_count": "bigint", "data_count_per_channel": "int", "buffer_count": "int", "channel_count": "int"}

BLOCK_SCHEMA = "sample_time bigint, group_info string, message_type int, group_id int, channel_style int, channel_id int, machine_id int, total_data_count bigint, data_count_per_channel int, buffer_count int, block_index bigint, layout string, payload array<float>"


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an audit log with their types; blank rows and rows of under eleven fields are passed over, an unknown layout is interleaved."""
    rows = spark.read.schema(", ".join(f"{c} string" for c in AUDIT_COLUMNS)).option("header", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    whole = rows.filter("utc is not null and crc32 is not null")
    layout = F.when(F.col("layout").isin(INTERLEAVED, CONTIGUOUS), F.col("layout")).otherwise(INTERLEAVED)
    return whole.withColumns({c: F.col(c).try_cast(t) for c, t in _NUMBERS.items()} | {"layout": layout, "crc32": F.trim("crc32")})


def _named_files(spark: SparkSession, glob: str) -> DataFrame:
    """(file, value): whole texts by name. The pattern of the name filters a listing of the folder, as a pattern would make each file a root that Spark lists by itself."""
    folder, _, name = glob.rpartition("/")
    texts = spark.read.option("wholetext", True)
    own = folder and any(c in name for c in "*?[{") and name.count("{") == name.count("}")
    found = texts.option("pathGlobFilter", name).text(folder) if own else texts.text(glob)
    return found.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")


def device_rate_config(spark: SparkSession, glob: str, devices: DataFrame) -> DataFrame:
    """(device_id, config_rate) from files Machine{ip}_{id}.xml: that of the device's address and id, else the first of its address.

    A device meets two rows at most, however many files its address has: the
    first file of its address and id, and the first of its address.
    """
    files = _named_files(spark, glob)
    tag = lambda name: F.xpath_string("value", F.lit(f"//{name}[normalize-space()]"))
    rate = F.when(tag("SampleFrequency") != "", tag("SampleFrequency")).otherwise(tag("SampleFreq")).try_cast("double")
    named = files.select(F.regexp_extract("file", r"(?i)^Machine(.+)_(\d+)\.xml$", 1).alias("ip"), F.regexp_extract("file", r"(?i)^Machine(.+)_(\d+)\.xml$", 2).try_cast("int").alias("file_id"), rate.alias("config_rate"), "file")
    good = named.filter((F.col("ip") != "") & valid_rate(F.col("config_rate"))).select(F.lower("ip").alias("address"), "file_id", F.struct(F.lower("file").alias("lower"), "file", "config_rate").alias("found"))
    exact = good.filter("file_id IS NOT NULL").groupBy("address", "file_id").agg(F.min("found").alias("found"))
    first = good.groupBy("address").agg(F.min("found").alias("found"))
    own = devices.select("device_id", F.lower("ip_address").alias("address"))
    place = lambda k: F.struct(F.lit(k).alias("place"), "found").alias("best")
    both = own.join(exact, (own["address"] == exact["address"]) & (own["device_id"] == exact["file_id"])).select("device_id", place(0))
    both = both.unionByName(own.join(first, "address").select("device_id", place(1)))
    return both.groupBy("device_id").agg(F.min("best").alias("best")).select("device_id", "best.found.config_rate")


def block_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of blocks from a folder of Parquet files."""
    return spark.readStream.schema(BLOCK_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
