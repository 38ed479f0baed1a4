"""Column functions: bucket rules, checksums, rates and names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType


def bucket_boundary(i: Column, n: Column, buckets: Column) -> Column:
    """Bucket p holds the positions from floor(p*n/b) to floor((p+1)*n/b) - 1; buckets must not exceed n."""
    return whole_quotient((i + 1) * buckets - 1, n)


def whole_quotient(a: Column, b: Column) -> Column:
    """Whole quotient of non-negative whole numbers."""
    return ((a - a % b) / b).cast("long")


def bucket_floor(i: Column, n: Column, buckets: Column) -> Column:
    """floor(i / n * b) in doubles, in this order, kept within 0 and b - 1."""
    at = (i.cast("double") / n * buckets).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(buckets.cast("long") - 1, at))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def valid_rate(rate: Column) -> Column:
    return is_finite(rate) & (rate > 0)


def duration(samples: Column, rate: Column) -> Column:
    """Seconds; 0 without a valid rate."""
    return F.when(valid_rate(rate), samples / rate).otherwise(0.0)


def crc32_hex(data: Column) -> Column:
    """CRC32 as eight upper-case hex digits."""
    return F.lpad(F.hex(F.crc32(data)), 8, "0")


@F.arrow_udf(BinaryType())
def float_bytes(values: pa.Array) -> pa.Array:
    """An array of floats as little-endian 32-bit bytes, taken from Arrow's buffers; Spark has no such cast. A missing float is NaN."""
    values = values.cast(pa.list_(pa.float32()))
    ends = values.offsets.to_numpy()
    flat = pc.fill_null(values.values.slice(ends[0], ends[-1] - ends[0]), float("nan"))
    data = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), "<f4")
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(((ends - ends[0]).astype(np.int64) * 4).tobytes()), pa.py_buffer(data.tobytes())])
    return pc.if_else(values.is_valid(), out, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo that of CRC32, in its bit order (the highest bit is the constant term)."""
    out, b = np.zeros_like(a), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ np.uint32(0xEDB88320), b >> np.uint32(1))
    return out


#: x to the powers 8 * 2**k: what a checksum is multiplied by when 2**k bytes follow.
_POWERS = [np.array([1 << 23], np.uint32)]
for _ in range(62):
    _POWERS.append(_times(_POWERS[-1], _POWERS[-1]))


@F.arrow_udf(LongType())
def crc32_before(crc: pa.Array, after: pa.Array) -> pa.Array:
    """What a piece's CRC32 adds to that of the whole if ``after`` bytes follow it.

    The CRC32 of bytes in pieces is the exclusive or (``bit_xor``) of this over
    the pieces, in any order, so pieces that are summed apart need not meet.
    """
    out, n = pc.fill_null(crc, 0).to_numpy(zero_copy_only=False).astype(np.uint32), pc.fill_null(after, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for k in range(int(n.max(initial=0)).bit_length()):
        rows = np.flatnonzero(n >> k & 1)
        out[rows] = _times(out[rows], np.broadcast_to(_POWERS[k], len(rows)))
    return pc.if_else(pc.and_(crc.is_valid(), after.is_valid()), pa.array(out.astype(np.int64)), pa.scalar(None, pa.int64()))


def run_stem(started: Column, custom: Column) -> Column:
    """The name of a run: the custom one, sanitised, or one from the time it started."""
    own = F.when(F.trim(custom) != "", sanitised(F.trim(custom)))
    return F.coalesce(own, F.concat(F.lit("Capture_"), F.date_format(started, "yyyyMMdd_HHmmss")))


def segment_name(stem: Column, index: Column, extension: str = ".dhcap") -> Column:
    """The file name of a run's segment."""
    return F.concat(stem, F.format_string("_%04d", index), F.lit(extension))


def sanitised(name: Column) -> Column:
    """A name that may stand in a path: marks that paths reserve, dots and colons become _."""
    return F.regexp_replace(name, r'[\x00-\x1f"<>|:*?\\/.]', "_")


def group_name(device_id: Column, ip: Column) -> Column:
    return F.format_string("Device_%04d_%s", device_id + 1, sanitised(ip))


def channel_name(channel_id: Column) -> Column:
    return F.format_string("AI%03d", channel_id + 1)
