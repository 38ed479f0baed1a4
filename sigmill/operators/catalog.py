"""Registries: devices, channels, segments, runs, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.functions.scalars import duration, valid_rate
from sigmill.operators import scans
from sigmill.operators.ranks import small

STORED, PREPROCESSED, RAW_STORED = 1, 2, 4


def active_devices(devices: DataFrame, most: int = 0) -> DataFrame:
    """Online devices, the first by id of each address (in any case), at most ``most`` if that is positive."""
    first = Window.partitionBy(F.lower("ip_address")).orderBy("device_id")
    found = devices.filter("online").withColumn("__first", F.row_number().over(first)).filter("__first = 1").drop("__first")
    return found.orderBy("device_id").limit(most) if most > 0 else found


def _valid_indexes(index: str, window: Window) -> Column:
    n, c = F.count("*").over(window), F.col(index)
    return (F.min(c).over(window) >= 0) & (F.max(c).over(window) < n) & (F.size(F.collect_set(c).over(window)) == n)


def normalize_data_index(channels: DataFrame, multi_device: bool = False) -> DataFrame:
    """Channels (device_id, channel_id, data_index, local_data_index) with indexes that are permutations.

    A device's local indexes that are none give way to the order of its
    channels; so do, across devices, the indexes of blocks of all devices.
    """
    device = Window.partitionBy("device_id")
    local = F.when(_valid_indexes("local_data_index", device), F.col("local_data_index")).otherwise(F.row_number().over(device.orderBy("channel_id")) - 1)
    out = channels.withColumn("__local", local.cast("int"))
    if multi_device:
        n, least, most, distinct = channels.agg(F.count("*"), F.min("data_index"), F.max("data_index"), F.countDistinct("data_index")).first()
        if not (n and least >= 0 and most < n and distinct == n):
            sizes = channels.groupBy("device_id").agg(F.count("*").alias("__n"))
            before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("device_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each device
            place = F.col("__before") + F.row_number().over(device.orderBy("channel_id")) - 1
            out = out.join(small(before.drop("__n")), "device_id").withColumn("data_index", place.cast("int")).drop("__before")
    else:
        out = out.withColumn("data_index", F.col("__local"))
    return out.withColumn("local_data_index", F.col("__local")).drop("__local")


def resolve_sample_rate(devices: DataFrame, configured: DataFrame) -> DataFrame:
    """Devices with ``resolved_rate``: the configured rate (device_id, config_rate) if valid, else their own if valid, else 1."""
    pick = lambda c: F.when(valid_rate(F.col(c)), F.col(c))
    return devices.join(configured, "device_id", "left").withColumn("resolved_rate", F.coalesce(pick("config_rate"), pick("sample_rate"), F.lit(1.0))).drop("config_rate")


def _property(text: str, key: str) -> Column:
    found = F.trim(F.regexp_extract(text, f"(?i){key}=([^;]*)", 1))
    return F.when(F.lower(text).contains(f"{key.lower()}="), found)


def parse_channel_metadata(df: DataFrame) -> DataFrame:
    """(group_name, channel_name, description, ...) with device_id, channel_id and sample_rate.

    Properties come from ``Key=value;`` text; without them the ids come from
    names like Device_0001_... and AI001, and a missing or invalid rate is 0.
    """
    device = F.coalesce(_property("description", "DeviceId").try_cast("int"), F.regexp_extract("group_name", "Device_([0-9]+)", 1).try_cast("int") - 1, F.lit(0))
    channel = F.coalesce(_property("description", "ChannelId").try_cast("int"), F.regexp_extract("channel_name", "(?i)^AI([0-9]+)$", 1).try_cast("int") - 1, F.lit(0))
    rate = _property("description", "SampleRate").try_cast("double")
    return df.withColumns({"device_id": device, "channel_id": channel, "sample_rate": F.when(rate > 0, rate).otherwise(0.0)})


def normalize_records(records: DataFrame) -> DataFrame:
    """Records with their flags as columns; before version 3 codec and preprocessor are the manifest's, and none for raw chunks."""
    flag = lambda bit: F.col("flags").bitwiseAND(F.lit(bit)) != 0
    old_raw = (F.col("version") < 3) & flag(RAW_STORED)
    name = lambda c: F.when(old_raw, "None").when(F.col("version") < 3, F.col(f"manifest_{c}")).otherwise(F.col(c))
    return records.withColumns({"stored": flag(STORED), "preprocessed": flag(PREPROCESSED), "raw_stored": flag(RAW_STORED), "codec": name("codec"), "preprocessor": name("preprocessor")}).drop("manifest_codec", "manifest_preprocessor")


def record_channels(records: DataFrame, channels: DataFrame) -> DataFrame:
    """Records with the columns of their channel, by segment and ordinal."""
    return records.join(channels, ["segment", "channel_ordinal"])


def orphan_records(records: DataFrame, channels: DataFrame) -> DataFrame:
    """Records of ordinals that the segment's manifest does not have: its index is invalid."""
    return records.join(channels.select("segment", "channel_ordinal"), ["segment", "channel_ordinal"], "left_anti")


def effective_sample_rate(records: DataFrame, channels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sample_count, sample_rate): the rate that the times of a channel's blocks show.

    ``records`` has a row for each record with sample_start, sample_count and
    ``callback_blocks``; ``channels`` the nominal rate. The nominal rate stands
    if the observed duration differs from it by under 0.5 %.
    """
    counts = records.groupBy(*keys).agg(F.max(F.col("sample_start") + F.col("sample_count")).alias("sample_count"))
    blocks = records.select(*keys, "sample_start", F.posexplode("callback_blocks").alias("seq", "block")).filter("block.sample_time > 0")
    last = F.struct(F.col("block.sample_time").alias("t"), F.col("sample_start").alias("s"), F.col("seq").alias("q"), F.col("block.data_count_per_channel").alias("n"))
    times = blocks.groupBy(*keys).agg(F.min("block.sample_time").alias("t0"), F.max(last).alias("end"))
    rows = channels.join(counts, keys, "left").join(times, keys, "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0).cast("long")))
    nominal, n = F.col("nominal_rate"), F.col("sample_count")
    seen = (F.col("end.t") - F.col("t0")) / 1000.0 + F.when(F.col("end.n") > 0, F.col("end.n") / nominal).otherwise(0.0)
    far = F.abs(seen - n / nominal) / (n / nominal) >= 0.005
    rate = F.when((n > 0) & valid_rate(nominal) & (seen > 0) & far, n / seen).otherwise(nominal)
    return rows.select(*keys, "sample_count", rate.alias("sample_rate"))


def segment_channel_info(channels: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Channels of segments with sample_count, effective sample_rate, and 'raw' for a missing unit; names compare in any case."""
    names = [k for k in keys if dict(channels.dtypes)[k] == "string"]
    own = channels.withColumns({f"__{k}": F.col(k) for k in names})
    lower = lambda df: df.withColumns({k: F.lower(k) for k in names})
    info = effective_sample_rate(lower(records), lower(own), keys)
    unit = F.when(F.trim(F.coalesce("unit", F.lit(""))) == "", "raw").otherwise(F.col("unit"))
    both = lower(own).drop("nominal_rate").join(info, keys).withColumn("unit", unit)
    return both.select(*(F.col(f"__{c}").alias(c) if c in names else F.col(c) for c in both.columns if not c.startswith("__")))


def run_channel_info(info: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sample_count, duration_s, sample_rate) over the segments of a run; names compare in any case, and the first segment's spelling stands."""
    names = [k for k in keys if dict(info.dtypes)[k] == "string"]
    own = info.withColumn("seconds", duration(F.col("sample_count"), F.col("sample_rate")))
    total = own.groupBy(*(F.lower(k).alias(f"__{k}") if k in names else F.col(k) for k in keys)).agg(
        *(F.min_by(k, F.struct("segment", k)).alias(k) for k in names),
        F.sum("sample_count").alias("sample_count"), F.sum("seconds").alias("duration_s"), F.min_by("sample_rate", "segment").alias("first_rate"),
    ).select(*keys, "sample_count", "duration_s", "first_rate")
    rate = F.when((F.col("sample_count") > 0) & (F.col("duration_s") > 0), F.col("sample_count") / F.col("duration_s")).otherwise(F.col("first_rate"))
    return total.withColumn("sample_rate", rate).drop("first_rate")


def run_overview(info: DataFrame, group: str) -> DataFrame:
    """A row for each group and one for all (null): channels, greatest sample count, longest duration (0.001 s at least)."""
    return info.rollup(group).agg(F.count("*").alias("channels"), F.max("sample_count").alias("max_samples"), F.greatest(F.lit(0.001), F.max("duration_s")).alias("max_duration_s"))


def segment_rates(segments: DataFrame, updates: DataFrame) -> DataFrame:
    """(device_id, segment, opened, sample_rate): the last valid rate reported at or before a segment opened, else the device's own.

    Both tables run along one time line of a device, in spans of time; updates
    come first at equal times, and of those at one time the greatest counts.
    """
    whole = lambda c, df: (F.unix_micros(c) if dict(df.dtypes)[c].startswith("timestamp") else F.col(c)).cast("long")
    none = lambda kind: F.lit(None).cast(kind)
    own = ["segment", "opened", "base_rate"]
    kinds = dict(segments.dtypes)
    events = updates.filter(valid_rate(F.col("rate"))).select("device_id", (whole("reported", updates) * 2).alias("__at"), F.col("rate").cast("double").alias("__rate"), *(none(kinds[c]).alias(c) for c in own), F.lit(False).alias("__asks"))
    opened = segments.select("device_id", (whole("opened", segments) * 2 + 1).alias("__at"), none("double").alias("__rate"), *own, F.lit(True).alias("__asks"))
    last = F.when(F.col("__rate").isNotNull(), F.struct("__at", "__rate"))
    both = scans.running(events.unionByName(opened), ["device_id"], "__at", {"__last": ("max", last)}, inclusive=True)
    return both.filter("__asks").select("device_id", "segment", "opened", F.coalesce("__last.__rate", "base_rate").alias("sample_rate"))


def order_channels(info: DataFrame) -> DataFrame:
    """Channels in the order of devices, then local index, then name in any case."""
    return info.orderBy("device_id", "local_data_index", F.lower("name"))


def first_channels(info: DataFrame, k: int) -> DataFrame:
    return order_channels(info).limit(k)


def union_selections(views: DataFrame, known: DataFrame, cap: int, keys: list[str]) -> DataFrame:
    """Channels of all views (view_id, keys), each view cut to its first ``cap``, known channels only, each once with its first view."""
    real = views.join(small(known.select(*keys).distinct()), keys, "left_semi")
    place = F.row_number().over(Window.partitionBy("view_id").orderBy(*keys))
    return real.withColumn("place", place).filter(F.col("place") <= cap).groupBy(*keys).agg(F.min("view_id").alias("view_id"))


def stale_channels(buffered: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    return buffered.select(*keys).distinct().join(small(selected.select(*keys).distinct()), keys, "left_anti")


def snapshot_series(latest: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted channels (pos, keys) that have points, in the order asked for; a missing display rate is the hardware's."""
    found = wanted.join(latest, keys).withColumn("display_rate", F.when(valid_rate(F.col("display_rate")), F.col("display_rate")).otherwise(F.col("sample_rate")))
    return found.orderBy("pos")
