"""A recording as a stream: blocks of a run become chunks in segments, written once however often a batch runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from sigmill.operators.blocks import FLOAT_BYTES
from sigmill.sinks.tables import new_run
from sigmill.streaming.stateful import _by_state, stored_state

OUT = "run_key {kind}, device_id int, channel_id int, segment bigint, chunk bigint, sample_start bigint, source_blocks array<bigint>, payload binary"
NAMES = ["run_key", "device_id", "channel_id", "segment", "chunk", "sample_start", "source_blocks", "payload"]


class Recorder(StatefulProcessor):
    """The state of a run: its segment with the bytes and channels that it has, and each channel's unfilled chunk.

    A turn of its loops is for a segment and for a chunk, not for a block.
    """

    def __init__(self, target_bytes: int, split_bytes: int, channels: int):
        self.target, self.split, self.channels = -(-target_bytes // FLOAT_BYTES), split_bytes, channels

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "segment bigint, bytes bigint, fed array<bigint>")
        self.open = handle.getMapState("open", "device_id int, channel_id int", "segment bigint, chunk bigint, start bigint, source_blocks array<bigint>, payload binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        both = pd.concat(frames).sort_values("block_index", kind="stable", ignore_index=True)
        block, first = np.unique(both["block_index"].to_numpy(), return_index=True)
        code = (both["device_id"].to_numpy().astype(np.int64) << 32) + both["channel_id"].to_numpy()
        sizes = both["n"].to_numpy().astype(np.int64)
        bytes_to = np.concatenate([[0], np.cumsum(np.add.reduceat(sizes, first))]) * FLOAT_BYTES
        begins = np.append(first, len(both))
        at_of = {c: np.searchsorted(begins, np.flatnonzero(code == c), side="right") - 1 for c in np.unique(code).tolist()}  # the channel's blocks
        segment, size, fed = self.run.get() if self.run.exists() else (0, 0, [])
        fed, at, out = set(fed or []), 0, []
        held = {(d, c): [s, k, b, list(src or []), [bytes(p)]] for (d, c), (s, k, b, src, p) in self.open.iterator()}
        touched = set()
        while at < len(block):
            full = int(np.searchsorted(bytes_to, bytes_to[at] + self.split - size)) - 1  # the block with which the segment has its bytes
            later = sorted(int(p[i]) if (i := np.searchsorted(p, at)) < len(p) else len(block) for c, p in at_of.items() if c not in fed)
            need = self.channels - len(fed)
            all_fed = -1 if need <= 0 else later[need - 1] if need <= len(later) else len(block)
            end = max(full, all_fed, at)
            closed, stop = end < len(block), min(end + 1, len(block))
            for c, places in at_of.items():
                own = places[np.searchsorted(places, at) : np.searchsorted(places, stop)]
                if not len(own):
                    continue
                fed.add(c)
                channel = (c >> 32, c & 0xFFFFFFFF)
                touched.add(channel)
                mine = np.flatnonzero((code[begins[at] : begins[stop]] == c)) + begins[at]
                out += self._filled(key, channel, segment, held, both, mine, sizes)
            size += int(bytes_to[stop] - bytes_to[at])
            if closed:
                for channel in list(held):  # a segment's chunks end with it
                    touched.add(channel)
                    out += self._given(key, channel, held)
                segment, size, fed = segment + 1, 0, set()
            at = stop
        self.run.update((int(segment), int(size), sorted(fed)))
        for channel in touched:
            if channel in held:
                s, k, b, src, parts = held[channel]
                self.open.updateValue(channel, (s, k, b, src, b"".join(parts)))
            else:
                self.open.removeKey(channel)
        if out:
            yield pd.DataFrame(out, columns=NAMES)

    def _filled(self, key: tuple, channel: tuple, segment: int, held: dict, both: pd.DataFrame, rows: np.ndarray, sizes: np.ndarray) -> list[tuple]:
        """The chunks that a channel's blocks fill; what is left stays open."""
        out, at, total = [], 0, np.concatenate([[0], np.cumsum(sizes[rows])])
        values, blocks = both["values"].to_numpy(), both["block_index"].to_numpy()
        if channel not in held or held[channel][0] != segment:
            held[channel] = [segment, 0, 0, [], []]
        while at < len(rows):
            now = held[channel]
            have = sum(map(len, now[4])) // FLOAT_BYTES
            end = min(len(rows), int(np.searchsorted(total, total[at] + self.target - have)))
            now[3] += blocks[rows[at:end]].tolist()
            now[4] += [np.asarray(v, "<f4").tobytes() for v in values[rows[at:end]]]
            if (have + total[end] - total[at]) >= self.target:
                out += self._given(key, channel, held, more=True)
            at = end
        return out

    def _given(self, key: tuple, channel: tuple, held: dict, more: bool = False) -> list[tuple]:
        segment, chunk, start, blocks, parts = held.pop(channel)
        data = b"".join(parts)
        if more:
            held[channel] = [segment, chunk + 1, start + len(data) // FLOAT_BYTES, [], []]
        return [(key[0], *channel, segment, chunk, start, blocks, data)] if blocks else []

    def close(self) -> None:
        pass


def recorded(rows: DataFrame, target_bytes: int, split_bytes: int, channels: int, run: str = "device_id") -> DataFrame:
    """Chunks (of ``OUT``) from a stream of rows of a block and a channel (device_id, channel_id, block_index, n, ``values`` of floats) as they are filled or their segment ends."""
    named = rows.select(F.col(run).alias("run_key"), "device_id", "channel_id", "block_index", "n", "values")
    return _by_state(named, ["run_key"], Recorder(target_bytes, split_bytes, channels), OUT.format(kind=dict(named.dtypes)["run_key"]))


def _claimed(spark: SparkSession, root: str, run: str, checkpoint: str) -> str:
    """The run's name: the one that this checkpoint's stream has claimed, else a new one, claimed by a file that only one can create."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/run-name")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        return spark.read.text(at.toString()).first()[0]
    while True:
        name = new_run(spark, root, run)
        mark = jvm.org.apache.hadoop.fs.Path(f"{root}/run_id={name}/_claimed")
        try:
            fs.create(mark, False).close()
            break
        except Exception as taken:  # by another stream since
            if not fs.exists(mark):
                raise taken
    out = fs.create(at, True)
    out.write(bytearray(name.encode()))
    out.close()
    return name


def record(rows: DataFrame, root: str, run: str, checkpoint: str, target_bytes: int, split_bytes: int, channels: int, key: str = "device_id") -> str:
    """Records a stream under the run's folder, which is never reused, and returns its name.

    A batch's chunks are in a folder of its number, so one that runs again after
    a failure replaces what it had written; a stream that is started again with
    its checkpoint goes on with the name that it claimed. The unfilled chunks are
    written when all input is taken, and again if the stream goes on.
    """
    spark = rows.sparkSession
    name = _claimed(spark, root, run, checkpoint)
    folder = f"{root}/run_id={name}"

    def commit(df: DataFrame, batch: int | str) -> None:
        dealt = df.repartition("segment")  # a segment's folder has a file of the batch, whose bytes are bounded, and not one of each run
        dealt.withColumns({"raw_crc32": F.crc32("payload"), "payload_crc32": F.crc32("payload")}).write.mode("overwrite").partitionBy("segment").parquet(f"{folder}/batch={batch}")

    stream = recorded(rows, target_bytes, split_bytes, channels, key).writeStream.outputMode("append")
    stream.option("checkpointLocation", f"{checkpoint}/stream").foreachBatch(commit).trigger(availableNow=True).start().awaitTermination()
    left = stored_state(spark, f"{checkpoint}/stream", "open").selectExpr("key.run_key", "user_map_key.device_id", "user_map_key.channel_id", "user_map_value.segment", "user_map_value.chunk", "user_map_value.start AS sample_start", "user_map_value.source_blocks", "user_map_value.payload")
    commit(left.filter(F.size("source_blocks") > 0), -1)
    return name


def read_recording(spark: SparkSession, root: str, run: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/run_id={run}").parquet(f"{root}/run_id={run}/batch=*").drop("batch")
