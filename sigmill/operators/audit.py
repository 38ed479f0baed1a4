"""Audit of stored samples against checksums of the blocks that were received."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.functions.scalars import crc32_before, crc32_hex, float_bytes, whole_quotient
from sigmill.operators.blocks import FLOAT_BYTES, INTERLEAVED
from sigmill.operators.ranks import each_with_all, small


def local_starts(audit: DataFrame) -> DataFrame:
    """Audit rows with ``local_start``, their position after the least position of their group."""
    least = audit.groupBy("group_id").agg(F.min("total_data_count").alias("base"))
    return audit.join(small(least), "group_id").withColumn("local_start", F.col("total_data_count") - F.col("base")).drop("base")


def audit_block_samples(audit: DataFrame, samples: DataFrame, width: int = 4096) -> DataFrame:
    """A row for each audit block (local_start, data_count_per_channel) and stored sample (device_id, sample_idx) in it.

    Blocks are dealt into the bins of ``width`` positions that they touch, so
    the join is on device and bin.
    """
    last = F.col("local_start") + F.col("data_count_per_channel") - 1
    bins = F.sequence(whole_quotient(F.col("local_start"), F.lit(width)), whole_quotient(last, F.lit(width)))
    asked = audit.filter("local_start >= 0 and data_count_per_channel > 0").withColumn("bin", F.explode(bins))
    held = samples.withColumn("bin", whole_quotient(F.col("sample_idx"), F.lit(width)))
    both = asked.join(held, (asked["group_id"] == held["device_id"]) & (asked["bin"] == held["bin"])).drop("bin")
    return both.filter((F.col("sample_idx") >= F.col("local_start")) & (F.col("sample_idx") < F.col("local_start") + F.col("data_count_per_channel")))


def audit_missing_groups(audit: DataFrame, samples: DataFrame) -> DataFrame:
    """Audit rows whose group is not stored."""
    there = small(samples.select(F.col("device_id").alias("group_id")).distinct())
    return audit.join(there, "group_id", "left_anti").withColumn("reason", F.lit("group is missing"))


def audit_verify(audit: DataFrame, stored: DataFrame, width: int = 4096) -> DataFrame:
    """Audit rows (block_index, group_id, crc32, layout, ...) with ``actual`` and ``reason`` (null: it holds).

    ``stored`` has pieces of series: device_id, position (of the channel in a
    block), start and ``values``, an array of any length; or single samples, with
    sample_idx and value. Blocks and pieces meet by device and the bins of
    ``width`` positions that they touch, and a piece gives the slice that the
    block covers. Where channels follow one another, a block's checksum comes
    from those of its slices, which no task has to gather; where samples are
    mixed, its bytes are rebuilt. Group -1 takes all devices by position.
    """
    pieces = stored if "values" in stored.columns else stored.select("device_id", "position", F.col("sample_idx").alias("start"), F.array("value").alias("values"))
    placed = local_starts(audit)
    heads = placed.filter("local_start >= 0 and data_count_per_channel > 0").select("block_index", "group_id", "local_start", "data_count_per_channel", "channel_count", "layout")
    devices = pieces.select("device_id").distinct()
    wanted = heads.filter("group_id >= 0").withColumn("device_id", F.col("group_id")).unionByName(each_with_all(heads.filter("group_id < 0"), devices))
    bins = lambda start, n: F.explode(F.sequence(whole_quotient(start, F.lit(width)), whole_quotient(start + n - 1, F.lit(width))))
    asked = wanted.withColumn("bin", bins(F.col("local_start"), F.col("data_count_per_channel")))
    held = pieces.filter(F.size("values") > 0).withColumn("size", F.size("values")).withColumn("bin", bins(F.col("start"), F.col("size")))
    low, high = F.greatest("local_start", "start"), F.least(F.col("local_start") + F.col("data_count_per_channel"), F.col("start") + F.col("size"))
    met = asked.join(held, ["device_id", "bin"]).filter((low < high) & (F.col("bin") == whole_quotient(low, F.lit(width))))
    slices = met.withColumn("at", low - F.col("local_start")).withColumn("part", F.slice("values", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")))

    own = ["block_index", "group_id"]
    begin, size = F.col("position") * F.col("data_count_per_channel") + F.col("at"), F.size("part")
    whole = F.col("channel_count").cast("long") * F.col("data_count_per_channel")
    apart = slices.filter(F.col("layout") != INTERLEAVED).select(*own, size.alias("n"), whole.alias("whole"), ((whole - begin - size) * FLOAT_BYTES).alias("after"), F.crc32(float_bytes("part")).alias("crc"))
    found = apart.groupBy(*own).agg(F.bit_xor(crc32_before("crc", "after")).alias("crc"), F.sum("n").alias("n"), F.max("whole").alias("whole"), F.min("after").alias("least"))
    # a block of which samples are missing, or that has more channels than it should, has no checksum
    contiguous = found.filter("n = whole and least >= 0").select(*own, F.lpad(F.hex("crc"), 8, "0").alias("actual"))
    place = lambda k: (F.col("at") + k) * F.col("channel_count") + F.col("position")
    cells = F.transform("part", lambda v, k: F.struct(place(k).alias("place"), v.alias("value")))
    lists = slices.filter(F.col("layout") == INTERLEAVED).groupBy(*own).agg(F.array_sort(F.flatten(F.collect_list(cells))).alias("all"))  # a block bounds its list
    mixed = lists.select(*own, crc32_hex(float_bytes(F.transform("all", lambda s: s["value"]))).alias("actual"))
    sums = contiguous.unionByName(mixed)
    there = small(devices.select(F.col("device_id").alias("group_id"), F.lit(True).alias("stored")))
    out = placed.join(sums, ["block_index", "group_id"], "left").join(there, "group_id", "left")
    reason = F.when((F.col("group_id") >= 0) & F.col("stored").isNull(), "group is missing").when(F.col("local_start") < 0, "invalid offset").when(F.upper(F.trim("crc32")) != F.coalesce("actual", F.lit("")), "checksum differs")
    return out.withColumn("reason", reason).drop("stored")


def audit_summary(verified: DataFrame) -> DataFrame:
    """Checked blocks and bytes, mismatches, and whether all hold; blocks of missing groups or with bad offsets are not counted as checked."""
    checked = F.coalesce(F.col("reason"), F.lit("")).isin("", "checksum differs")
    return verified.agg(
        F.sum(F.when(checked, 1).otherwise(0)).alias("checked_blocks"), F.sum(F.when(checked, F.col("buffer_count")).otherwise(0)).alias("checked_bytes"),
        F.count("reason").alias("mismatches"), (F.count("reason") == 0).alias("passed"),
    )


def top_mismatches(verified: DataFrame, n: int = 20) -> DataFrame:
    """The first mismatches in the order of blocks."""
    return verified.filter("reason is not null").orderBy("block_index", "group_id").limit(n)
