"""Capture segments: catalog, channels, chunk records, samples.

Segments are read as binary files by Spark, so from any store that it knows,
and must stay under its limit of 2 GiB each; a recording is split well below.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.functions.codecs import CODECS, PREPROCESSORS, decompress, restore

# Fixed values of the segment format.
MAGIC = b"DHCAP01\0"
FOOTERS = (b"DHCIDX3\0", b"DHCIDX2\0")
VERSIONS = range(1, 4)
MAX_MANIFEST, MAX_INDEX = 16 << 20, 128 << 20
STORED, PREPROCESSED, RAW_STORED = 1, 2, 4
#: Little-endian record headers: ordinal, start, count, original length, (preprocessor, codec,) transformed and payload length, flags, (CRCs, summary).
HEADERS = {1: struct.Struct("<iQiiiiB"), 2: struct.Struct("<iQiiiiBIIffff"), 3: struct.Struct("<iQiiBBiiBIIffff")}

BLOCK_FIELDS = "block_index bigint, message_type string, group_id int, machine_id int, total_data_count bigint, data_count_per_channel int, buffer_count int, channel_count int, layout string, sample_time bigint"
CHANNEL_SCHEMA = "path string, segment int, version int, channel_ordinal int, device_id int, group_name string, channel_name string, description string, unit string, channel_id int, data_index int, local_data_index int, nominal_rate double, codec string, preprocessor string, lpc_order int, started_at string"
RECORD_SCHEMA = f"path string, segment int, version int, channel_ordinal int, record_seq int, sample_start bigint, sample_count int, original_length int, transformed_length int, payload_length int, flags int, payload_offset bigint, codec string, preprocessor string, lpc_order int, raw_crc32 bigint, payload_crc32 bigint, first float, last float, minimum float, maximum float, callback_blocks array<struct<{BLOCK_FIELDS.replace(' ', ':').replace(',:', ', ')}>>"


class SegmentError(ValueError):
    pass


def segment_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(path, identity, is_capture) of the segments in a run folder, in the order of their identity.

    Captures (.dhcap, or .tdms with a capture's first bytes) are known by their
    path without extension, other files by the whole path; of paths that agree
    in any case the first counts. A folder without any is an error.
    """
    files = spark.read.format("binaryFile")
    named = files.option("pathGlobFilter", "*.[dD][hH][cC][aA][pP]").load(root).select("path", F.lit(True).alias("is_capture"))
    other = files.option("pathGlobFilter", "*.[tT][dD][mM][sS]").load(root).select("path", (F.substring("content", 1, len(MAGIC)) == F.lit(bytearray(MAGIC))).alias("is_capture"))
    found = named.unionByName(other).withColumn("identity", F.when(F.col("is_capture"), F.regexp_replace("path", r"\.[^./]*$", "")).otherwise(F.col("path")))
    if found.isEmpty():
        raise SegmentError(f"no segments in {root}")
    first = F.row_number().over(Window.partitionBy(F.lower("identity")).orderBy(F.lower("path")))
    return found.withColumn("place", first).filter("place = 1").drop("place").orderBy(F.lower("identity"))


def _lower(x: object) -> object:
    """Names of JSON members are compared in any case."""
    if isinstance(x, dict):
        return {k.lower(): _lower(v) for k, v in x.items()}
    return [_lower(v) for v in x] if isinstance(x, list) else x


def _named(x: object, names: list[str]) -> str:
    return names[x] if isinstance(x, int) else str(x or "None")


def read_manifest(data: bytes) -> tuple[int, dict, int]:
    """Version, manifest and where the records begin."""
    if data[:8] != MAGIC:
        raise SegmentError("not a capture segment")
    if len(data) < 16:
        raise SegmentError("the manifest is cut off")
    version, size = struct.unpack_from("<ii", data, 8)
    if version not in VERSIONS:
        raise SegmentError(f"version {version} is not supported")
    if not 0 < size <= MAX_MANIFEST or len(data) < 16 + size:
        raise SegmentError("the manifest's length is invalid")
    return version, _lower(json.loads(data[16 : 16 + size])), 16 + size


def _index(data: bytes, begin: int) -> list[dict] | None:
    """The records of the index at the end, None if there is no such index."""
    if len(data) < begin + 12 or data[-8:] not in FOOTERS:
        return None
    (size,) = struct.unpack_from("<i", data, len(data) - 12)
    at = len(data) - 12 - size
    if not 0 < size <= MAX_INDEX or at < begin:
        return None
    index = _lower(json.loads(data[at : at + size]))
    return index["records"] if index.get("version", 0) >= 2 else None


def read_records(data: bytes) -> Iterator[dict]:
    """The records, from the index or else by a scan that ends at the first one that is cut off or invalid; a bad index is an error."""
    version, manifest, begin = read_manifest(data)
    ordinals = {c["ordinal"] for c in manifest["channels"]}
    codec, pre = _named(manifest.get("algorithm"), CODECS), _named(manifest.get("preprocessor"), PREPROCESSORS)

    def valid(r: dict) -> bool:
        return r["channel_ordinal"] in ordinals and r["sample_count"] > 0 and r["original_length"] == 4 * r["sample_count"] and min(r["transformed_length"], r["payload_length"], r["payload_offset"]) >= 0 and r["payload_offset"] + r["payload_length"] <= len(data)

    def settled(r: dict) -> dict:
        if version < 3:
            raw = bool(r["flags"] & RAW_STORED)
            r |= {"codec": "None" if raw else codec, "preprocessor": "None" if raw else pre}
        return r

    listed = _index(data, begin) if version >= 2 else None
    if listed is not None:
        snake = lambda k: {"channelordinal": "channel_ordinal", "samplestart": "sample_start", "samplecount": "sample_count", "originallength": "original_length", "transformedlength": "transformed_length", "payloadlength": "payload_length", "payloadoffset": "payload_offset", "rawcrc32": "raw_crc32", "payloadcrc32": "payload_crc32", "callbackblocks": "callback_blocks"}.get(k, k)
        for item in listed:
            r = {snake(k): v for k, v in item.items()}
            r |= {"codec": _named(r.get("codec"), CODECS), "preprocessor": _named(r.get("preprocessor"), PREPROCESSORS), "callback_blocks": [_block(b) for b in r.get("callback_blocks") or []]}
            if not valid(r):
                raise SegmentError("the index at the end is invalid")
            yield settled(r)
        return
    head, at = HEADERS[version], begin
    while at + head.size <= len(data):
        f = list(head.unpack_from(data, at))
        ids = ["None", "None"]
        if version == 3:
            p, c = f.pop(4), f.pop(4)
            ids = [CODECS[c] if c < len(CODECS) else str(c), PREPROCESSORS[p] if p < len(PREPROCESSORS) else str(p)]
        f += [0, 0, *[float("nan")] * 4][len(f) - 7 :] if version == 1 else []
        names = ["channel_ordinal", "sample_start", "sample_count", "original_length", "transformed_length", "payload_length", "flags", "raw_crc32", "payload_crc32", "first", "last", "minimum", "maximum"]
        r = dict(zip(names, f)) | {"payload_offset": at + head.size, "codec": ids[0], "preprocessor": ids[1], "callback_blocks": []}
        if not valid(r):
            return
        yield settled(r)
        at += head.size + r["payload_length"]


def _block(b: dict) -> dict:
    names = ["block_index", "message_type", "group_id", "machine_id", "total_data_count", "data_count_per_channel", "buffer_count", "channel_count", "layout", "sample_time"]
    return {n: b.get(n.replace("_", ""), 0) for n in names}


def decode(payload: bytes, r: dict, version: int) -> bytes:
    """The raw bytes of a record; lengths and, from version 2 on, both checksums must hold."""
    if version >= 2 and zlib.crc32(payload) != r["payload_crc32"]:
        raise SegmentError("payload checksum")
    plain = payload if r["flags"] & (STORED | RAW_STORED) else decompress(payload, r["codec"], r["transformed_length"])
    if len(plain) != r["transformed_length"]:
        raise SegmentError("transformed length")
    raw = plain if r["flags"] & RAW_STORED else restore(plain, r["preprocessor"], r["lpc_order"])
    if len(raw) != r["original_length"]:
        raise SegmentError("original length")
    if version >= 2 and zlib.crc32(raw) != r["raw_crc32"]:
        raise SegmentError("raw checksum")
    return raw


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root).select("path", "content")


def _rows(df: DataFrame, fn, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = list(fn(row))
                for at in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 4096], schema=kind)

    return df.mapInArrow(run, schema)


def capture_channels(spark: SparkSession, root: str, pattern: str = "*.dhcap") -> DataFrame:
    """A row for each channel in the manifests of the segments."""

    def read(row: dict) -> Iterator[dict]:
        version, m, _ = read_manifest(row["content"])
        own = {"path": row["path"], "segment": m.get("segmentindex"), "version": version, "codec": _named(m.get("algorithm"), CODECS), "preprocessor": _named(m.get("preprocessor"), PREPROCESSORS), "lpc_order": m.get("lpcorder", 2), "started_at": m.get("startedat")}
        for c in m["channels"]:
            yield own | {"channel_ordinal": c["ordinal"], "device_id": c["deviceid"], "group_name": c["groupname"], "channel_name": c["channelname"], "description": c.get("channeldescription"), "unit": c.get("unit"), "channel_id": c.get("channelid"), "data_index": c.get("dataindex"), "local_data_index": c.get("localdataindex"), "nominal_rate": float(c.get("samplerate", 0))}

    return _rows(_files(spark, root, pattern), read, CHANNEL_SCHEMA)


def _all_records(row: dict) -> Iterator[dict]:
    version, m, _ = read_manifest(row["content"])
    own = {"path": row["path"], "segment": m.get("segmentindex"), "version": version, "lpc_order": m.get("lpcorder", 2)}
    for n, r in enumerate(read_records(row["content"])):
        yield own | r | {"record_seq": n}


def capture_records(spark: SparkSession, root: str, pattern: str = "*.dhcap") -> DataFrame:
    """A row for each chunk record of the segments, without its payload."""
    return _rows(_files(spark, root, pattern), _all_records, RECORD_SCHEMA)


def decode_samples(spark: SparkSession, root: str, pattern: str = "*.dhcap") -> DataFrame:
    """(segment, channel_ordinal, local_idx, value): all samples of the segments; a chunk that does not verify is an error."""
    schema = "segment int, channel_ordinal int, sample_start bigint, samples array<float>"

    def read(row: dict) -> Iterator[dict]:
        for r in _all_records(row):
            raw = decode(row["content"][r["payload_offset"] : r["payload_offset"] + r["payload_length"]], r, r["version"])
            yield {"segment": r["segment"], "channel_ordinal": r["channel_ordinal"], "sample_start": r["sample_start"], "samples": np.frombuffer(raw, "<f4")}

    chunks = _rows(_files(spark, root, pattern), read, schema)
    return chunks.select("segment", "channel_ordinal", "sample_start", F.posexplode("samples").alias("i", "value")).select("segment", "channel_ordinal", (F.col("sample_start") + F.col("i")).alias("local_idx"), "value")


def chunk_integrity(spark: SparkSession, root: str, pattern: str = "*.dhcap") -> DataFrame:
    """(path, segment, channel_ordinal, record_seq, status): 'ok', or what does not hold, for every chunk; for a segment that cannot be read one row."""
    schema = "path string, segment int, channel_ordinal int, record_seq int, status string"

    def read(row: dict) -> Iterator[dict]:
        try:
            for r in _all_records(row):
                try:
                    decode(row["content"][r["payload_offset"] : r["payload_offset"] + r["payload_length"]], r, r["version"])
                    status = "ok"
                except SegmentError as e:
                    status = str(e)
                except (zlib.error, OSError, ValueError, EOFError, pa.ArrowException):
                    status = "payload cannot be decompressed"
                yield {"path": r["path"], "segment": r["segment"], "channel_ordinal": r["channel_ordinal"], "record_seq": r["record_seq"], "status": status}
        except SegmentError as e:
            yield {"path": row["path"], "status": str(e)}
        except (ValueError, KeyError, TypeError, AttributeError, IndexError, struct.error) as e:
            yield {"path": row["path"], "status": f"manifest or index cannot be read: {type(e).__name__}"}

    return _rows(_files(spark, root, pattern), read, schema)
