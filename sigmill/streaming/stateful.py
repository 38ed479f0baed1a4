"""Incremental forms of the block and point operators, on ``transformWithState``: a state for each key in RocksDB, rows in order within a batch."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from sigmill.operators.blocks import FLOAT_BYTES, continuity_key

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a file of a table that is streamed, and bytes of a micro-batch (at least a file).
FILE_ROWS, BATCH_BYTES = 1 << 18, 64 << 20

#: From a key, its columns of a micro-batch in order, and its state (None at first): rows to give out, and the new state.
Step = Callable[[tuple, dict[str, np.ndarray], tuple | None], tuple[pd.DataFrame, tuple]]


def _columns(frames: Iterator[pd.DataFrame], order: str) -> dict[str, np.ndarray]:
    """A key's columns of one micro-batch in order; the trigger bounds how many rows there are."""
    parts = [f for f in frames if len(f)]
    if not parts:
        return {}
    both = pd.concat(parts)
    place = np.argsort(both[order].to_numpy(), kind="stable")
    return {c: both[c].to_numpy()[place] for c in both.columns}


def fields(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


class Stepwise(StatefulProcessor):
    """A value state for each key; it may begin with a row of a batch table."""

    def __init__(self, step: Step, schema: str, order: str):
        self.step, self.schema, self.order = step, schema, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if columns := _columns(rows, self.order):
            out, new = self.step(key, columns, self.state.get() if self.state.exists() else None)
            self.state.update(new)
            if len(out):
                yield out

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        first = [initialState[f].iloc[0] for f in fields(self.schema)]  # by column, as a row would have one type
        self.state.update(tuple(x.item() if isinstance(x, np.generic) else x for x in first))

    def close(self) -> None:
        pass


def _by_state(rows: DataFrame, keys: list[str], processor: StatefulProcessor, out: str, initial: DataFrame | None = None, event_time: bool = False) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)  # the only one that transformWithState takes
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "EventTime" if event_time else "None", initial.groupBy(*keys) if initial is not None else None)


def stream_continuity(blocks: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Faults as ``continuity_check`` has them; the state is the expected position, which may begin with that of a table (key, expected)."""
    heads = blocks.select(continuity_key().alias("key"), "block_index", "total_data_count", F.col("data_count_per_channel").alias("n"))
    names = ["key", "block_index", "expected", "actual", "code"]

    def step(key: tuple, rows: dict[str, np.ndarray], state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        ends = rows["total_data_count"] + rows["n"]
        due = np.concatenate([[state[0] if state else rows["total_data_count"][0]], ends[:-1]])
        bad = np.flatnonzero(due != rows["total_data_count"])
        found = dict(zip(names, (key[0], rows["block_index"][bad], due[bad], rows["total_data_count"][bad], "DATA_NOT_CONTINUOUS")))
        return pd.DataFrame(found, columns=names), (int(ends[-1]),)

    kind = dict(heads.dtypes)
    return _by_state(heads, ["key"], Stepwise(step, "expected bigint", "block_index"), f"key {kind['key']}, block_index {kind['block_index']}, expected bigint, actual bigint, code string", expected)


def stream_decimate(samples: DataFrame, most: float) -> DataFrame:
    """Points as ``decimate`` has them from samples (device_id, channel, sample_idx, value, sample_rate).

    A bucket stays open across batches; a change of the factor discards it.
    """
    names = ["device_id", "channel", "point", "first", "last", "minimum", "maximum", "display_rate"]

    def step(key: tuple, rows: dict[str, np.ndarray], state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        point, factor, n, first, last, low, high = state or (0, 0, 0, 0.0, 0.0, 0.0, 0.0)
        v, rate = (rows[c].astype(float) for c in ("value", "sample_rate"))
        good = np.isfinite(v)
        v, rate = v[good], rate[good]
        rate = np.where(np.isfinite(rate) & (rate > 0), rate, most)
        factors = np.maximum(1, np.rint(rate / np.minimum(rate, most))).astype(np.int64)
        cuts, out = np.flatnonzero(np.diff(factors)) + 1 if len(v) else [], []
        for run, own, f in zip(np.split(v, cuts), np.split(rate, cuts), np.split(factors, cuts)):  # runs of one factor
            if not len(run):
                continue
            if f[0] != factor:
                factor, n = int(f[0]), 0
            bucket = (n + np.arange(len(run))) // factor
            begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            end = np.append(begin[1:], len(run))
            firsts, lasts, lows, highs = run[begin], run[end - 1], np.minimum.reduceat(run, begin), np.maximum.reduceat(run, begin)
            if n:  # the first bucket was open
                firsts[0], lows[0], highs[0] = first, min(low, lows[0]), max(high, highs[0])
            done = (n + len(run)) // factor
            out.append(pd.DataFrame(dict(zip(names, (*key, point + np.arange(done), firsts[:done], lasts[:done], lows[:done], highs[:done], own[end[:done] - 1] / factor))), columns=names))
            point, n = point + done, (n + len(run)) % factor
            if n:
                first, last, low, high = (float(x[-1]) for x in (firsts, lasts, lows, highs))
        found = pd.concat(out) if out else pd.DataFrame(columns=names)
        return found, (int(point), factor, int(n), float(first), float(last), float(low), float(high))

    processor = Stepwise(step, "point bigint, factor bigint, n bigint, first double, last double, low double, high double", "sample_idx")
    return _by_state(samples, ["device_id", "channel"], processor, "device_id int, channel string, point bigint, first double, last double, minimum double, maximum double, display_rate double")


class Newest(StatefulProcessor):
    """A list state of the newest points: batches are appended, and it is cut back to ``capacity`` when it has twice as many."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points, self.held = handle.getListState("points", "point_idx bigint, minimum double, maximum double"), handle.getValueState("held", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        for f in rows:  # no more than a frame and the newest points at once
            new = [np.concatenate([x, f[c].to_numpy(x.dtype)]) for x, c in zip(new, ("point_idx", "minimum", "maximum"))]
            keep = np.argsort(new[0], kind="stable")[-self.capacity :]
            new = [x[keep] for x in new]
        added = list(zip(*(x.tolist() for x in new)))
        if added:
            n = (self.held.get()[0] if self.held.exists() else 0) + len(added)
            if n > 2 * self.capacity:
                whole = [*self.points.get(), *added] if n > len(added) else added
                self.points.put([tuple(p) for p in whole[-self.capacity :]])
                n = self.capacity
            else:
                self.points.appendList(added)
            self.held.update((n,))
            yield pd.DataFrame({"device_id": [key[0]], "channel": [key[1]], "added": [len(added)]})

    def close(self) -> None:
        pass


def stream_latest(points: DataFrame, capacity: int) -> DataFrame:
    """Keeps the newest ``capacity`` points (device_id, channel, point_idx, minimum, maximum) of each channel, which come in order; gives out how many a batch added. ``newest`` reads what is kept."""
    return _by_state(points.select("device_id", "channel", "point_idx", "minimum", "maximum"), ["device_id", "channel"], Newest(capacity), "device_id int, channel string, added bigint")


def stored_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """What a stream's state store holds after its last batch: (key, value or the parts of a collection, partition_id)."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def newest(spark: SparkSession, checkpoint: str, capacity: int) -> DataFrame:
    """(device_id, channel, pos, point_idx, minimum, maximum): the newest points that a stream keeps, ``pos`` from the oldest of them."""
    from pyspark.sql import Window

    held = stored_state(spark, checkpoint, "points").select("key.device_id", "key.channel", "list_element.*")  # twice the capacity of a channel at most
    own = Window.partitionBy("device_id", "channel")
    ranked = held.withColumn("back", F.row_number().over(own.orderBy(F.desc("point_idx")))).filter(F.col("back") <= capacity)
    return ranked.withColumn("pos", (F.row_number().over(own.orderBy("point_idx")) - 1).cast("bigint")).drop("back")


CHUNK_STATE = "chunk bigint, start bigint, n bigint, first double, last double, low double, high double"


def chunk_step(target_bytes: int) -> Step:
    names = ["device_id", "channel_id", "chunk", "sample_start", "sample_count", "first", "last", "minimum", "maximum"]

    def step(key: tuple, rows: dict[str, np.ndarray], state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        chunk, start, n, first, last, low, high = state or (0, 0, 0, 0.0, 0.0, 0.0, 0.0)
        total = np.concatenate([[0], np.cumsum(rows["n"].astype(np.int64))])
        out, at, size = [], 0, len(rows["n"])
        while at < size:  # a turn for each chunk, or part of one
            need = -(-target_bytes // FLOAT_BYTES) - n
            end = min(size, int(np.searchsorted(total, total[at] + need)))
            if n == 0:
                first, low, high = rows["first"][at], np.inf, -np.inf
            last, n = rows["last"][end - 1], n + int(total[end] - total[at])
            low, high = min(low, rows["minimum"][at:end].min()), max(high, rows["maximum"][at:end].max())
            if n * FLOAT_BYTES >= target_bytes:
                out.append((*key, chunk, start, n, first, last, low, high))
                chunk, start, n = chunk + 1, start + n, 0
            at = end
        return pd.DataFrame(out, columns=names), (int(chunk), int(start), int(n), float(first), float(last), float(low), float(high))

    return step


class Chunks(Stepwise):
    """Gives out an unfilled chunk when event time has passed a channel's last block by ``idle_ms``; what comes then is another run, from chunk and position 0."""

    def __init__(self, target_bytes: int, idle_ms: int):
        super().__init__(chunk_step(target_bytes), CHUNK_STATE, "block_index")
        self.idle_ms = idle_ms

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frames, timers = [f for f in rows if len(f)], list(self.handle.listTimers())
        if frames and timers and min(f["sample_at"].min() for f in frames).timestamp() * 1000 >= timers[0]:
            yield from self.handleExpiredTimer(key, timerValues)  # the timer's batch would come after these rows
        yield from super().handleInputRows(key, iter(frames), timerValues)
        if frames:
            for timer in timers:
                self.handle.deleteTimer(timer)
            last = max(f["sample_at"].max() for f in frames)
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo | None = None) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            chunk, start, n, first, last, low, high = self.state.get()
            self.state.clear()
            if n:
                yield pd.DataFrame([(*key, chunk, start, n, first, last, low, high)], columns=["device_id", "channel_id", "chunk", "sample_start", "sample_count", "first", "last", "minimum", "maximum"])


def stream_chunks(blocks: DataFrame, target_bytes: int, idle_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Chunk summaries from rows of a block and a channel (device_id, channel_id, block_index, n, first, last, minimum, maximum).

    Whole blocks join a chunk until it has the target's bytes. With ``idle_ms``
    (and a time ``sample_at`` with a watermark) a timer ends the run of a channel
    that has had no block for so long; without, ``open_chunks`` reads what is
    left. ``initial``: open chunks (the keys and the state's columns) of an
    earlier stream to go on from.
    """
    processor = Stepwise(chunk_step(target_bytes), CHUNK_STATE, "block_index") if idle_ms is None else Chunks(target_bytes, idle_ms)
    out = "device_id int, channel_id int, chunk bigint, sample_start bigint, sample_count bigint, first double, last double, minimum double, maximum double"
    return _by_state(blocks, ["device_id", "channel_id"], processor, out, initial, idle_ms is not None)


def open_chunks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The unfilled chunks that a stream has at its end, as it would give them out."""
    held = stored_state(spark, checkpoint, "state").select("key.device_id", "key.channel_id", "value.*").filter("n > 0")
    return held.withColumnsRenamed({"start": "sample_start", "n": "sample_count", "low": "minimum", "high": "maximum"})


def stream_report(blocks: DataFrame, every: int = 32) -> DataFrame:
    """(key, blocks, bytes): running blocks and bytes of each device, a row after each ``every`` blocks however they are dealt into batches."""
    names = ["key", "blocks", "bytes"]

    def step(key: tuple, rows: dict[str, np.ndarray], state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        n, size = state or (0, 0)
        counts, sizes = n + 1 + np.arange(len(rows["bytes"])), size + np.cumsum(rows["bytes"].astype(np.int64))
        told = np.flatnonzero(counts % every == 0)
        return pd.DataFrame({"key": key[0], "blocks": counts[told], "bytes": sizes[told]}, columns=names), (int(counts[-1]), int(sizes[-1]))

    heads = blocks.select(continuity_key().alias("key"), "block_index", F.col("buffer_count").alias("bytes"))
    return _by_state(heads, ["key"], Stepwise(step, "blocks bigint, bytes bigint", "block_index"), f"key {dict(heads.dtypes)['key']}, blocks bigint, bytes bigint")


def display_budget(blocks: DataFrame, per_second: int, burst: int) -> DataFrame:
    """Blocks (with sample_time in ms) with ``shown``: whether the display takes a block, and ``dropped``, how many of its device it has not taken so far.

    A device has a bucket of ``burst`` tokens, filled with ``per_second`` a
    second of sample time; a block that finds none is dropped. Counted in
    thousandths, so that no rounding depends on the batches.
    """
    rows = blocks.withColumn("key", continuity_key())

    def step(key: tuple, columns: dict[str, np.ndarray], state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        tokens, last, dropped = state or (burst * 1000, int(columns["sample_time"][0]), 0)
        shown, drops = [], []
        for t in columns["sample_time"].tolist():
            tokens = min(burst * 1000, tokens + max(0, t - last) * per_second)
            last = max(last, t)
            shown.append(tokens >= 1000)
            tokens -= 1000 * shown[-1]
            dropped += not shown[-1]
            drops.append(dropped)
        return pd.DataFrame(columns | {"shown": shown, "dropped": drops}), (tokens, last, dropped)

    schema = ", ".join([*(f"{n} {k}" for n, k in rows.dtypes), "shown boolean", "dropped bigint"])
    return _by_state(rows, ["key"], Stepwise(step, "tokens bigint, last bigint, dropped bigint", "block_index"), schema).drop("key")


def drain(stream: DataFrame, folder: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that there is and returns what it gave, with ``batch``; in update mode the last word on each key is the highest batch's."""
    spark, path = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/out/part={batch}")  # a batch that runs again replaces itself

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{path}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("part")


def stream_fanout(blocks: DataFrame, folder: str, per_second: int, burst: int) -> tuple[DataFrame, DataFrame]:
    """One feed, two tables: every block is stored, with what the display has ``dropped`` by then; those within its budget are shown."""
    spark, path = blocks.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"

    def fan(df: DataFrame, batch: int) -> None:
        kept = df.persist()
        kept.write.mode("overwrite").parquet(f"{path}/stored/part={batch}")
        kept.filter("shown").drop("shown", "dropped").write.mode("overwrite").parquet(f"{path}/shown/part={batch}")
        kept.unpersist()

    budget = display_budget(blocks, per_second, burst)
    budget.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(fan).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/stored").drop("part"), spark.read.parquet(f"{path}/shown").drop("part")


def write_feed(table: DataFrame, order: str, folder: str) -> str:
    """The path of ``table`` as files in order of the column ``order``; as a file stream takes files by their time of change, that is set in their order."""
    spark, made = table.sparkSession, f"{folder}/feed-{uuid.uuid4().hex}"
    parts = max(1, math.ceil(table.count() / FILE_ROWS))
    table.repartitionByRange(parts, order).sortWithinPartitions(order).write.option("maxRecordsPerFile", FILE_ROWS).parquet(made)
    where = spark._jvm.org.apache.hadoop.fs.Path(made)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")), key=_place)
    begin = fs.getFileStatus(files[0]).getModificationTime() if files else 0
    for i, file in enumerate(files):
        fs.setTimes(file, begin + i, -1)
        if fs.getFileStatus(file).getModificationTime() != begin + i:
            raise RuntimeError(f"{made}: the file system does not set times, so a stream would not keep the order")
    return made


def table_stream(spark: SparkSession, path: str, order: str, folder: str) -> DataFrame:
    """A stream over a Parquet table in order of the column ``order``, of about ``BATCH_BYTES`` in a micro-batch."""
    table = spark.read.parquet(path)
    return spark.readStream.schema(table.schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(write_feed(table, order, folder))


def _place(file) -> tuple[int, int]:
    """Partition, and number within it, of a file that Spark's writer named."""
    name = file.getName()
    return int(name.split("-")[1]), int(re.search(r"c(\d+)\.", name)[1])
