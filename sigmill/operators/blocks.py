"""Blocks of samples: validity, layout, routing to channels, continuity, chunks and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.functions.scalars import whole_quotient
from sigmill.operators import boundaries, scans
from sigmill.operators.ranks import each_with_all, small, with_positions
from sigmill.plans.shared import materialise

INTERLEAVED, CONTIGUOUS = "SampleInterleavedFloat32", "ChannelContiguousFloat32"
SINGLE_DEVICE, ALL_DEVICES = 5, 21
FLOAT_BYTES = 4


def valid_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that have bytes, a payload and samples."""
    return blocks.filter((F.col("buffer_count") > 0) & F.col("payload").isNotNull() & (F.col("data_count_per_channel") > 0))


def _devices_of(channels: DataFrame) -> tuple[int, int]:
    total, devices = channels.agg(F.count("*"), F.countDistinct("device_id")).first()
    return total, devices


def block_device(blocks: DataFrame, devices: DataFrame) -> DataFrame:
    """Blocks with ``device_id``: the device of the group, else that of the machine; blocks of neither are dropped."""
    known = small(devices.select("device_id").distinct())
    by = lambda key: known.select(F.col("device_id").alias(f"by_{key}"))
    both = blocks.join(by("group"), F.col("group_id") == F.col("by_group"), "left").join(by("machine"), F.col("machine_id") == F.col("by_machine"), "left")
    return both.withColumn("device_id", F.coalesce("by_group", "by_machine")).filter("device_id is not null").drop("by_group", "by_machine")


def infer_channel_count(blocks: DataFrame, channels: DataFrame, multi_device: bool = False) -> DataFrame:
    """Blocks with ``channel_count``: from their bytes if they divide evenly, else from the registry, one at least."""
    total, _ = _devices_of(channels)
    per = small(channels.groupBy("device_id").agg(F.count("*").alias("device_channels")))
    by = lambda key: per.select(F.col("device_id").alias(f"by_{key}"), F.col("device_channels").alias(f"n_{key}"))
    each = F.col("data_count_per_channel") * FLOAT_BYTES
    even = (F.col("data_count_per_channel") > 0) & (F.col("buffer_count") > 0) & (F.col("buffer_count") % F.when(each > 0, each) == 0)
    registry = F.greatest(F.lit(1).cast("long"), F.coalesce("n_group", "n_machine", F.lit(1)))
    if multi_device and total > 0:
        registry = F.lit(total).cast("long")
    both = blocks.join(by("group"), F.col("group_id") == F.col("by_group"), "left").join(by("machine"), F.col("machine_id") == F.col("by_machine"), "left")
    count = F.when(even, whole_quotient(F.col("buffer_count"), F.when(each > 0, each))).otherwise(registry)
    return both.withColumn("channel_count", count.cast("int")).drop("by_group", "n_group", "by_machine", "n_machine")


def classify_blocks(blocks: DataFrame, channels: DataFrame, audit: bool = False) -> DataFrame:
    """Blocks (with channel_count) with ``is_global``: whether a block carries all devices; the audit does not look at the count."""
    total, devices = _devices_of(channels)
    known = (F.col("message_type") == ALL_DEVICES) | (F.col("group_id") < 0) | (F.col("machine_id") < 0)
    if not audit and devices > 1:
        known |= F.col("channel_count") == total
    return blocks.withColumn("is_global", known)


def resolve_data_index(block_channels: DataFrame) -> DataFrame:
    """Rows of a block and a channel with ``position``, the channel's place in the block; places outside of it are dropped."""
    local = ~F.col("is_global") & (F.col("layout") == CONTIGUOUS)
    place = F.when(local, F.col("local_data_index")).otherwise(F.col("data_index"))
    return block_channels.withColumn("position", place.cast("int")).filter((F.col("position") >= 0) & (F.col("position") < F.col("channel_count")))


def block_channels(blocks: DataFrame, channels: DataFrame) -> DataFrame:
    """A row for each block (with is_global and channel_count) and channel that it feeds.

    Blocks of one device meet the device's channels; blocks of all devices meet
    every channel.
    """
    lean = channels.select(F.col("device_id").alias("channel_device"), "channel_id", "data_index", "local_data_index")
    registry = small(lean)
    own = block_device(blocks.filter(~F.col("is_global")), channels)
    one = own.join(registry, F.col("device_id") == F.col("channel_device")).drop("device_id")
    all_ = each_with_all(blocks.filter("is_global"), lean)
    return resolve_data_index(one.unionByName(all_)).withColumnRenamed("channel_device", "device_id")


def deinterleave(blocks: DataFrame) -> DataFrame:
    """(block_index, channel_pos, i, value): one row for each sample of the payload, for both layouts."""
    n, p = F.col("data_count_per_channel"), F.col("p")
    flat = blocks.select("block_index", "layout", "data_count_per_channel", "channel_count", F.posexplode("payload").alias("p", "value"))
    inter = F.col("layout") == INTERLEAVED
    pos = F.when(inter, p % F.col("channel_count")).otherwise(whole_quotient(p, n))
    at = F.when(inter, whole_quotient(p, F.col("channel_count"))).otherwise(p % n)
    return flat.select("block_index", pos.cast("int").alias("channel_pos"), at.cast("int").alias("i"), "value")


def interleave(samples: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block_index, payload) from (block_index, channel_pos, i, value), in the layout of the block; the inverse of ``deinterleave``."""
    spec = blocks.select("block_index", "layout", "data_count_per_channel", "channel_count")
    inter = F.col("layout") == INTERLEAVED
    place = F.when(inter, F.col("i") * F.col("channel_count") + F.col("channel_pos")).otherwise(F.col("channel_pos") * F.col("data_count_per_channel") + F.col("i"))
    placed = samples.join(spec, "block_index").select("block_index", F.struct(place.alias("place"), "value").alias("s"))
    lists = placed.groupBy("block_index").agg(F.array_sort(F.collect_list("s")).alias("all"))  # a block bounds its list
    return lists.select("block_index", F.transform("all", lambda s: s["value"]).alias("payload"))


def channel_arrays(blocks: DataFrame) -> DataFrame:
    """(block_index, channel_pos, values): a narrow form of ``deinterleave``, an array for each channel of a block."""
    n, c = F.col("data_count_per_channel"), F.col("channel_count")
    rows = blocks.withColumn("channel_pos", F.explode(F.sequence(F.lit(0), c - 1)))
    steps = F.sequence(F.lit(0), n - 1)
    inter = F.transform(steps, lambda i: F.get("payload", i * c + F.col("channel_pos")))
    whole = F.slice("payload", F.col("channel_pos") * n + 1, n)
    return rows.select("block_index", "channel_pos", F.when(F.col("layout") == INTERLEAVED, inter).otherwise(whole).alias("values"))


def continuity_key() -> Column:
    return F.when(F.col("group_id") >= 0, F.col("group_id")).otherwise(F.col("machine_id"))


def continuity_check(blocks: DataFrame) -> DataFrame:
    """A fault for each block that does not begin where the one before it, of the same key, ended. Headers only."""
    heads = blocks.select(continuity_key().alias("key"), "block_index", F.col("total_data_count").alias("actual"), "data_count_per_channel")
    expected = scans.neighbour(heads, ["key"], "block_index", {"expected": F.col("actual") + F.col("data_count_per_channel")})
    return expected.filter("expected is not null and expected <> actual").select("key", "block_index", "expected", "actual", F.lit("DATA_NOT_CONTINUOUS").alias("code"))


def until_first_fault(blocks: DataFrame) -> DataFrame:
    """Blocks before the first fault of any device."""
    first = continuity_check(blocks).agg(F.min("block_index")).first()[0]
    return blocks if first is None else blocks.filter(F.col("block_index") < first)


def assign_sample_index(rows: DataFrame, keys: tuple[str, ...] = ("device_id", "channel_id")) -> DataFrame:
    """Rows of a block and a channel with ``sample_start``: the samples of the channel before the block. With the segment among the keys, positions begin anew in each."""
    placed = scans.running(rows, list(keys), "block_index", {"sample_start": ("sum", F.col("data_count_per_channel").cast("long"))})
    return placed.withColumn("sample_start", F.coalesce("sample_start", F.lit(0)).cast("long"))


def _placed(rows: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Heads (with bytes) with their position in the series and the bytes up to them."""
    placed = with_positions(rows, keys, "block_index", "pos")
    return materialise(scans.running(placed, keys, "pos", {"total": ("sum", F.col("bytes"))}, inclusive=True, width=span, span=span))


def assign_chunks(rows: DataFrame, target_bytes: int, keys: tuple[str, ...] = ("device_id", "channel_id"), span: int = scans.SPAN) -> DataFrame:
    """(keys, block_index, data_count_per_channel, chunk): whole blocks join a chunk until it has the target's bytes. With the segment among the keys no chunk crosses its end."""
    keys = list(keys)
    heads = _placed(rows.select(*keys, "block_index", "data_count_per_channel", (F.col("data_count_per_channel") * FLOAT_BYTES).cast("long").alias("bytes")), keys, span)
    ends = boundaries.first_reaching(heads, keys, "total", F.col("total") - F.col("bytes") + target_bytes, "last", span)
    found = boundaries.groups(ends.select(*keys, "block_index", "data_count_per_channel", "pos", (F.col("last") + 1).alias("next")), keys, span)
    return found.select(*keys, "block_index", "data_count_per_channel", F.col("group").alias("chunk"))


def assign_even_chunks(rows: DataFrame, target_bytes: int, block_samples: int, keys: tuple[str, ...] = ("device_id", "channel_id")) -> DataFrame:
    """``assign_chunks`` for blocks of equal size, without Python."""
    blocks_each = max(1, -(-target_bytes // (block_samples * FLOAT_BYTES)))
    placed = with_positions(rows.select(*keys, "block_index", "data_count_per_channel"), list(keys), "block_index", "pos")
    return placed.select(*keys, "block_index", "data_count_per_channel", whole_quotient(F.col("pos"), F.lit(blocks_each)).alias("chunk"))


def assign_segments(rows: DataFrame, split_bytes: int, channels: int, run: str = "run_id", span: int = scans.SPAN) -> DataFrame:
    """(run, block_index, segment) from rows of a block and a channel: a segment ends after the block with which it has the bytes, if all channels have data.

    All channels: those that the run has at all; a run with fewer than
    ``channels`` is one segment.
    """
    keys, channel = [run], list(dict.fromkeys([run, "device_id", "channel_id"]))
    heads = _placed(rows.groupBy(run, "block_index").agg(F.sum(F.col("data_count_per_channel") * FLOAT_BYTES).cast("long").alias("bytes")), keys, span)
    full = boundaries.first_reaching(heads, keys, "total", F.col("total") - F.col("bytes") + split_bytes, "last", span)
    # by the block before a segment, the last of the blocks at which its channels are next fed
    fed = rows.select(*channel, "block_index").distinct().join(heads.select(run, "block_index", "pos"), [run, "block_index"])
    later = scans.neighbour(fed, channel, "pos", {"again": F.col("pos")}, after=True, width=span, span=span)
    again = later.groupBy(run, "pos").agg(F.max(F.coalesce("again", F.lit(boundaries.NEVER))).alias("again"))
    first = fed.groupBy(*channel).agg(F.min("pos").alias("pos")).groupBy(run).agg(F.max("pos").alias("all_fed"), F.count("*").alias("fed"))
    begun = scans.running(full.join(again, [run, "pos"]), keys, "pos", {"waits": ("max", F.col("again"))}, width=span, span=span).join(first, run)
    end = F.greatest("last", F.coalesce("waits", F.lit(0)), "all_fed")
    ends = F.when(F.col("last").isNotNull() & (F.col("fed") >= channels) & (end < boundaries.NEVER), end + 1)
    found = boundaries.groups(begun.select(run, "block_index", "pos", ends.alias("next")), keys, span)
    return found.select(run, "block_index", F.col("group").alias("segment"))
