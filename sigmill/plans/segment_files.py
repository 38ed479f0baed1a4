"""Capture segments made from a table of samples, as input for the segment sources."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sigmill.functions.codecs import CODECS, PREPROCESSORS, compress, preprocess
from sigmill.plans.shared import scratch
from sigmill.sources.segments import FOOTERS, HEADERS, MAGIC, PREPROCESSED, RAW_STORED, STORED


def packed(raw: bytes, codec: str, pre: str, order: int = 2) -> tuple[bytes, int]:
    """Payload and flags of a chunk; without a codec the chunk is stored raw."""
    if codec == "None":
        return raw, STORED | RAW_STORED
    changed = preprocess(raw, pre, order)
    small = compress(changed, codec)
    flags = PREPROCESSED if pre != "None" else 0
    return (changed, flags | STORED) if len(small) >= len(raw) else (small, flags)


def segment_bytes(manifest: dict, chunks: list[tuple[int, int, list[float]]], version: int = 3, footer: bool = False, blocks: list[dict] | None = None) -> bytes:
    """A segment of chunks (ordinal, start, samples), with an index at its end if ``footer``."""
    text = json.dumps(manifest).encode()
    out, index = MAGIC + struct.pack("<ii", version, len(text)) + text, []
    codec, pre = manifest["Algorithm"], manifest["Preprocessor"]
    for ordinal, start, samples in chunks:
        v = np.asarray(samples, "<f4")
        raw = v.tobytes()
        payload, flags = packed(raw, CODECS[codec], PREPROCESSORS[pre], manifest.get("LpcOrder", 2))
        sums = (zlib.crc32(raw), zlib.crc32(payload), float(v[0]), float(v[-1]), float(v.min()), float(v.max()))
        head = [ordinal, start, len(v), len(raw), *((pre, codec) if version == 3 else ()), len(raw), len(payload), flags, *(sums if version > 1 else ())]
        out += HEADERS[version].pack(*head)
        names = ["ChannelOrdinal", "SampleStart", "SampleCount", "OriginalLength", "TransformedLength", "PayloadLength", "Flags", "PayloadOffset", "Codec", "Preprocessor", "RawCrc32", "PayloadCrc32", "First", "Last", "Minimum", "Maximum", "CallbackBlocks"]
        index.append(dict(zip(names, [ordinal, start, len(v), len(raw), len(raw), len(payload), flags, len(out), codec, pre, *sums, blocks or []])))
        out += payload
    if footer:
        tail = json.dumps({"Version": version, "RecordCount": len(index), "Records": index}).encode()
        out += tail + struct.pack("<i", len(tail)) + FOOTERS[0 if version == 3 else 1]
    return out


def manifest(segment: int, channels: list[dict], codec: str, pre: str) -> dict:
    return {"FormatVersion": 3, "SegmentIndex": segment, "StartedAt": "2024-01-01T00:00:00+00:00", "Algorithm": CODECS.index(codec), "Preprocessor": PREPROCESSORS.index(pre), "LpcOrder": 2, "Channels": channels}


def write_segments(samples: DataFrame, path: str, chunk: int = 64, chunks_each: int = 8, codec: str = "Zstd", pre: str = "IntDeltaZigZag", damaged: bool = False) -> None:
    """Writes (device_id, channel, sample_idx, value) as segments of one channel and ``chunks_each`` chunks, one file each.

    Positions in a segment count from its first sample. Spark's text sink ends
    each file with a line feed, so there is no index at the end and readers scan.
    With ``damaged`` every third segment gets a wrong last byte, and every third
    a manifest that is no JSON.
    """
    seq = F.floor(F.col("sample_idx") / chunk)
    pieces = samples.groupBy("device_id", "channel", seq.alias("seq")).agg(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("all"))
    piece = F.struct("seq", F.transform("all", lambda s: s["value"].cast("float")).alias("samples"))
    files = pieces.groupBy("device_id", "channel", F.floor(F.col("seq") / chunks_each).alias("segment")).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own = {"Ordinal": 0, "DeviceId": r["device_id"], "GroupName": f"Device_{r['device_id'] + 1:04d}", "SampleRate": 1000, "ChannelName": r["channel"], "ChannelDescription": "", "Unit": "raw", "ChannelId": 0, "DataIndex": 0, "LocalDataIndex": 0}
                base = r["segment"] * chunks_each
                data = segment_bytes(manifest(r["segment"], [own], codec, pre), [(0, (p["seq"] - base) * chunk, p["samples"]) for p in r["pieces"]])
                if damaged and r["segment"] % 3 == 1:
                    data = data[:-1] + bytes([data[-1] ^ 1])
                if damaged and r["segment"] % 3 == 2:
                    data = data.replace(b'{"', b'["', 1)
                rows.append(data)
            yield pa.RecordBatch.from_pydict({"segment": pa.array(rows, pa.binary())})

    out = files.mapInArrow(run, "segment binary").select(F.col("segment").cast("string"))
    out.write.option("maxRecordsPerFile", 1).text(path)


#: Files of a folder of ``write_named``, about, and renames at a time.
FOLDER_FILES, AT_ONCE = 1000, 16


def rename(spark: SparkSession, path: str, name: Callable[[int], str]) -> None:
    """Names the files that a Spark writer left in a folder by their place in the listing."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(f.getPath().getName() for f in fs.listStatus(fs_path(path)) if f.getPath().getName().startswith("part-"))
    for k, file in enumerate(files):
        if not fs.rename(fs_path(f"{path}/{file}"), fs_path(f"{path}/{name(k)}")):
            raise OSError(f"{file} could not be renamed")


def write_named(rows: DataFrame, path: str) -> None:
    """Writes each text of ``rows`` (value), which has its file's name in a comment, as the file of that name.

    Spark writes a file for each row, in folders of about ``FOLDER_FILES``, so
    that a commit moves folders. The driver gives the names, as a rename is a
    call of the file system; it meets those of one folder at a time.
    """
    spark = rows.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    bins, made = max(1, -(-rows.count() // FOLDER_FILES)), scratch(spark, "files")
    dealt = rows.select("value", F.pmod(F.xxhash64("value"), F.lit(bins)).alias("bin"))
    dealt.repartition(bins, "bin").write.partitionBy("bin").option("maxRecordsPerFile", 1).text(made)
    written = spark.read.option("wholetext", True).text(made)
    named = written.select("bin", F.input_file_name().alias("file"), F.regexp_extract("value", "<!--(.+)-->", 1).alias("name")).repartition(bins, "bin")
    fs.mkdirs(fs_path(path))

    def move(row: Row) -> None:
        if not fs.rename(fs_path(row.file), fs_path(f"{path}/{row["name"]}")):
            raise OSError(f"{row.file} could not be renamed")

    with ThreadPoolExecutor(AT_ONCE) as pool:
        for folder in folders(named.toLocalIterator(prefetchPartitions=True)):
            list(pool.map(move, folder))


def folders(rows: Iterator[Row]) -> Iterator[list[Row]]:
    """Rows in lists of ``FOLDER_FILES``."""
    while part := list(islice(rows, FOLDER_FILES)):
        yield part
