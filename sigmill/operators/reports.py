"""Statistics and reports over channels, records and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.functions.scalars import is_finite

KEYS = ("device_id", "channel")


def channel_stats(samples: DataFrame, channels: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Samples, extremes, peak to peak and half amplitude of each channel; zeros for one without samples."""
    low, high = F.min(F.when(~F.isnan("value"), F.col("value"))), F.max(F.when(~F.isnan("value"), F.col("value")))
    found = samples.groupBy(*keys).agg(F.count("*").alias("samples"), low.alias("minimum"), high.alias("maximum"))
    rows = channels.join(found, list(keys), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    span = zero(F.col("maximum")) - zero(F.col("minimum"))
    return rows.select(*channels.columns, F.coalesce("samples", F.lit(0).cast("long")).alias("samples"), zero(F.col("minimum")).alias("minimum"), zero(F.col("maximum")).alias("maximum"), span.alias("peak_to_peak"), (span / 2).alias("half_amplitude"))


def storage_report(records: DataFrame, by: list[str], seconds: float, overhead: Column | None = None) -> DataFrame:
    """Bytes, chunk states, shares, ratio and MB per second of records (original_length, payload_length, flags), by rollup of ``by``.

    Written bytes are those of the files: payloads and, for each record,
    ``overhead`` (its header and its share of the manifest and the index).
    Ratio and MB per second are of written bytes.
    """
    overhead = F.lit(0) if overhead is None else overhead
    stored, raw = F.col("flags").bitwiseAND(F.lit(1)) != 0, F.col("flags").bitwiseAND(F.lit(4)) != 0
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    total = records.rollup(*by).agg(
        F.sum("original_length").alias("raw_bytes"), F.sum("payload_length").alias("payload_bytes"), F.sum(F.col("payload_length") + overhead).cast("long").alias("written_bytes"), F.count("*").alias("chunks"),
        count(~stored & ~raw).alias("compressed"), count(stored | raw).alias("stored"), count(raw).alias("raw_stored"),
    )
    share = lambda c: 100.0 * F.col(c) / F.col("chunks")
    return total.withColumns({
        "compressed_pct": share("compressed"), "stored_pct": share("stored"),
        "ratio": F.when(F.col("written_bytes") > 0, F.col("raw_bytes") / F.col("written_bytes")).otherwise(0.0),
        "mb_per_s": F.col("written_bytes") / 1048576.0 / max(seconds, 0.001),
    })


def ingest_report(blocks: DataFrame, faults: DataFrame, codes: list[str], drops: DataFrame | None = None) -> DataFrame:
    """Blocks, bytes and dropped blocks of each key, and its faults by code; ``drops`` (key, dropped): blocks that a display has dropped besides those without bytes."""
    total = blocks.groupBy("key").agg(F.count("*").alias("blocks"), F.sum("buffer_count").alias("bytes"), F.sum(F.when(F.col("buffer_count") <= 0, 1).otherwise(0)).alias("dropped"))
    if drops is not None:
        more = drops.select("key", F.col("dropped").alias("__more"))
        total = total.join(more, "key", "left").withColumn("dropped", F.col("dropped") + F.coalesce("__more", F.lit(0))).drop("__more")
    if not codes:
        return total
    by_code = faults.groupBy("key").pivot("code", codes).agg(F.count(F.lit(1)))
    return total.join(by_code, "key", "left").fillna(0, codes)


def nice_number(value: Column, rounded: bool) -> Column:
    """1, 2, 5 or 10 times a power of ten, near the value (rounded) or above it."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(value, F.lit(1e-7)))))
    part = value / power
    steps = ((1.5, 1), (3, 2), (7, 5)) if rounded else ((1, 1), (2, 2), (5, 5))
    out = F.lit(10.0)
    for most, nice in reversed(steps):
        out = F.when(part < most if rounded else part <= most, float(nice)).otherwise(out)
    return out * power


def value_range(envelope: DataFrame, by: list[str], finite: bool = False) -> DataFrame:
    """(by, low, high) over all points of all series; -1 to 1 without any, and a margin of 1 for a flat one."""
    rows = envelope.filter(is_finite(F.col("minimum")) & is_finite(F.col("maximum"))) if finite else envelope
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    found = rows.groupBy(*by).agg(F.min(known("minimum")).alias("lo"), F.max(known("maximum")).alias("hi"))
    flat = F.abs(F.col("hi") - F.col("lo")) < 0.000001
    return found.select(*by, F.when(F.col("lo").isNull(), -1.0).when(flat, F.col("lo") - 1).otherwise(F.col("lo")).alias("low"), F.when(F.col("hi").isNull(), 1.0).when(flat, F.col("hi") + 1).otherwise(F.col("hi")).alias("high"))


def axis_bounds(ranges: DataFrame, padded: bool = False, amplitude: float = 0.0) -> DataFrame:
    """``ranges`` (low, high) with axis_low and axis_high on nice steps; the live form adds 6 %, or is symmetric about 0."""
    low, high = F.col("low"), F.col("high")
    if padded:
        if amplitude > 0:
            most = F.greatest(F.abs(low), F.abs(high))
            low, high = -most, most
        flat = F.abs(high - low) < 0.000001
        pad = F.when(flat, F.greatest(F.lit(1.0), F.abs(high) * 0.1)).otherwise((high - low) * 0.06)
        low, high = low - pad, high + pad
    step = nice_number(nice_number(high - low, False) / 8, True)
    a, b = F.floor(low / step) * step, F.ceil(high / step) * step
    flat = F.abs(b - a) < 0.000001
    a, b = F.when(flat, a - 1).otherwise(a), F.when(flat, b + 1).otherwise(b)
    if padded and amplitude > 0:
        fits = F.greatest(F.abs(F.col("low")), F.abs(F.col("high"))) <= amplitude
        a, b = F.when(fits, -float(amplitude)).otherwise(a), F.when(fits, float(amplitude)).otherwise(b)
    return ranges.withColumns({"axis_low": a, "axis_high": b})


def overview_merge(envelopes: DataFrame, width: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(bin, minimum, maximum): all series (keys, bucket) in one strip."""
    bins = int(min(max(width, 64), 1800))
    sizes = envelopes.groupBy(*keys).agg(F.count("*").alias("n"))
    at = ((F.col("bucket") + 0.5) / F.col("n") * bins).cast("int")
    placed = envelopes.join(sizes, list(keys)).withColumn("bin", F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)))
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return placed.groupBy("bin").agg(F.min(known("minimum")).alias("minimum"), F.max(known("maximum")).alias("maximum"))
