"""Streams give what the batch forms give, however the input is dealt into batches, stopped and started again."""

import os
import shutil
import time

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sigmill import registry
from sigmill.operators import blocks, envelope, reports
from sigmill.sinks import tables
from sigmill.streaming import recording, stateful

HEADS = "block_index long, group_id int, machine_id int, total_data_count long, data_count_per_channel int, buffer_count int, sample_time long"
SAMPLES = "device_id int, channel string, sample_idx long, value double, sample_rate double"
CHUNKS = "device_id int, channel_id int, block_index long, n int, first double, last double, minimum double, maximum double, sample_at timestamp"


class Feed:
    """A folder to which files are added, each a micro-batch."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n, self.began = spark, str(path), schema, 0, time.time() - 10_000
        os.makedirs(f"{path}/all")

    def add(self, *batches):
        for rows in batches:
            made = f"{self.path}/{self.n}"
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(made)
            (file,) = (f for f in os.listdir(made) if f.startswith("part"))
            to = f"{self.path}/all/{self.n}.parquet"
            shutil.copyfile(f"{made}/{file}", to)
            os.utime(to, (self.began + self.n, self.began + self.n))
            self.n += 1
        return self

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/all")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def heads(n=16):
    return [(i, i % 2, 0, i // 2 * 10 + (3 if i > 7 else 0) + (1 if i == 11 else 0), 10, 40 + i, i * 5) for i in range(n)]


def test_continuity_and_decimation_over_batches(spark, tmp_path):
    rows = heads()
    feed = Feed(spark, tmp_path / "h", HEADS).add(rows[:3], rows[3:9], rows[9:])
    columns = ["key", "block_index", "expected", "actual", "code"]
    got = stateful.drain(stateful.stream_continuity(feed.stream()), str(tmp_path)).select(columns)
    assert rows_of(got) == rows_of(blocks.continuity_check(spark.createDataFrame(rows, HEADS)).select(columns)) != []

    values = [(0, "a", i, float((i * 37) % 11), 9000.0) for i in range(50)]
    values[20] = (0, "a", 20, float("nan"), 9000.0)
    feed = Feed(spark, tmp_path / "s", SAMPLES).add(values[:7], values[7:30], values[30:])
    columns = ["point", "first", "last", "minimum", "maximum", "display_rate"]
    batch = spark.createDataFrame(values, SAMPLES)
    rates = batch.groupBy("device_id", "channel").agg(F.first("sample_rate").alias("sample_rate"))
    assert rows_of(stateful.drain(stateful.stream_decimate(feed.stream(), 4000), str(tmp_path)).select(columns)) == rows_of(envelope.decimate(batch.drop("sample_rate"), rates, 4000).select(columns)) != []


def test_continuity_goes_on_from_a_table(spark, tmp_path):
    rows = heads()
    feed = Feed(spark, tmp_path / "h", HEADS).add(rows[9:12], rows[12:])
    known = spark.createDataFrame([(0, 53), (1, 30)], "key int, expected long")
    got = stateful.drain(stateful.stream_continuity(feed.stream(), known), str(tmp_path))
    assert {(r.key, r.block_index, r.expected, r.actual) for r in got.collect()} == {(1, 9, 30, 43), (1, 11, 53, 54), (1, 13, 64, 63)}


def test_newest_points_are_appended_and_survive_a_restart(spark, tmp_path):
    points = [(0, "a", i, float(i), float(-i)) for i in range(37)] + [(0, "b", 5, 1.0, 2.0)]
    feed = Feed(spark, tmp_path / "p", "device_id int, channel string, point_idx long, minimum double, maximum double")
    checkpoint = f"{tmp_path}/state"
    want = lambda rows: sorted((0, c, r, i, float(i), float(-i)) for c in "a" for r, i in enumerate([p[2] for p in rows if p[1] == c][-5:]))
    for part in (points[:3], points[3:6], points[6:30], points[30:]):
        feed.add(part)
        added = stateful.drain(stateful.stream_latest(feed.stream(), 5), str(tmp_path), checkpoint=checkpoint)
        assert added.filter("channel = 'a'").agg(F.sum("added")).first()[0] == min(5, sum(p[1] == "a" for p in part))
        seen = points[: points.index(part[-1]) + 1]
        assert [r for r in rows_of(stateful.newest(spark, checkpoint, 5).select("device_id", "channel", "pos", "point_idx", "minimum", "maximum")) if r[1] == "a"] == want(seen)
        held = stateful.stored_state(spark, checkpoint, "points").filter("key.channel = 'a'").count()
        assert held <= 10
    assert stateful.stored_state(spark, checkpoint, "points").filter("key.channel = 'b'").count() == 1


def chunk_rows(n=5):
    return [(0, 0, i, 3, float(i), i + 0.5, -float(i), float(i), None) for i in range(n)]


WHOLE = [(0, 0, 6, 0.0, 1.5, -1.0, 1.0), (1, 6, 6, 2.0, 3.5, -3.0, 3.0)]
LEFT = [(2, 12, 3, 4.0, 4.5, -4.0, 4.0)]


def chunks(df):
    return sorted((r.chunk, r.sample_start, r.sample_count, r["first"], r["last"], r.minimum, r.maximum) for r in df.collect())


def test_chunks_filled_and_left_open_over_a_restart(spark, tmp_path):
    feed, checkpoint, out = Feed(spark, tmp_path / "c", CHUNKS), f"{tmp_path}/state", []
    for part in (chunk_rows()[:1], chunk_rows()[1:4], chunk_rows()[4:]):
        feed.add(part)
        try:
            out += chunks(stateful.drain(stateful.stream_chunks(feed.stream(), 24), str(tmp_path), checkpoint=checkpoint))
        except Exception as nothing:
            assert "UNABLE_TO_INFER_SCHEMA" in str(nothing)
    assert out == WHOLE and chunks(stateful.open_chunks(spark, checkpoint)) == LEFT


def test_chunks_go_on_from_a_table(spark, tmp_path):
    feed = Feed(spark, tmp_path / "c", CHUNKS).add(chunk_rows()[3:])
    known = spark.createDataFrame([(0, 0, 1, 6, 3, 2.0, 2.5, -2.0, 2.0)], "device_id int, channel_id int, chunk long, start long, n long, first double, last double, low double, high double")
    assert chunks(stateful.drain(stateful.stream_chunks(feed.stream(), 24, initial=known), str(tmp_path), checkpoint=f"{tmp_path}/state")) == WHOLE[1:]
    assert chunks(stateful.open_chunks(spark, f"{tmp_path}/state")) == LEFT


def test_a_timer_ends_a_run_without_a_marker(spark, tmp_path):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [(*r[:8], at(i)) for i, r in enumerate(chunk_rows())]
    other = [(1, 0, 100, 3, 7.0, 7.5, 7.0, 7.0, at(40))]
    again = [(0, 0, 200, 6, 9.0, 9.5, 9.0, 9.0, at(45))]
    feed = Feed(spark, tmp_path / "c", CHUNKS).add(rows[:2], rows[2:], other, again)
    timed = feed.stream().withWatermark("sample_at", "1 second")
    got = stateful.drain(stateful.stream_chunks(timed, 24, idle_ms=10_000), str(tmp_path), checkpoint=f"{tmp_path}/state")
    assert chunks(got.filter("device_id = 0")) == sorted([*WHOLE, *LEFT, (0, 0, 6, 9.0, 9.5, 9.0, 9.0)])  # the next run begins anew
    assert got.filter("device_id = 1").count() == 0 and chunks(stateful.open_chunks(spark, f"{tmp_path}/state").filter("device_id = 1")) == [(0, 0, 3, 7.0, 7.5, 7.0, 7.0)]


@pytest.mark.parametrize("cuts", [[16], [1, 5, 6, 16]])
def test_reports_come_by_count_not_by_batch(spark, tmp_path, cuts):
    rows = heads()
    feed = Feed(spark, tmp_path / "h", HEADS).add(*(rows[a:b] for a, b in zip([0, *cuts], cuts)))
    got = stateful.drain(stateful.stream_report(feed.stream(), 3), str(tmp_path)).drop("batch")
    sizes = {k: np.cumsum([r[5] for r in rows if r[1] == k]).tolist() for k in (0, 1)}
    assert rows_of(got) == sorted((k, n, sizes[k][n - 1]) for k in (0, 1) for n in (3, 6))


@pytest.mark.parametrize("cuts", [[16], [1, 5, 6, 16]])
def test_the_display_drops_what_is_beyond_its_budget(spark, tmp_path, cuts):
    """Two blocks at once, then one each 100 ms; a block comes each 10 ms."""
    rows = heads()
    feed = Feed(spark, tmp_path / "h", HEADS).add(*(rows[a:b] for a, b in zip([0, *cuts], cuts)))
    stored, shown = stateful.stream_fanout(feed.stream(), str(tmp_path), 10, 2)
    assert rows_of(stored.select(spark.createDataFrame([], HEADS).columns)) == sorted(rows)
    assert sorted(r.block_index for r in shown.collect()) == [0, 1, 2, 3]
    drops = stored.groupBy(blocks.continuity_key().alias("key")).agg(F.max("dropped").alias("dropped"))
    assert rows_of(drops) == [(0, 6), (1, 6)]
    report = reports.ingest_report(stored.withColumn("key", blocks.continuity_key()), blocks.continuity_check(stored), [], drops)
    assert {(r.key, r.blocks, r.dropped) for r in report.collect()} == {(0, 8, 6), (1, 8, 6)}


ROWS = "device_id int, channel_id int, block_index long, n int, values array<float>"


def recorded_rows(seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for d, channels in ((0, 3), (1, 2)):
        for at in range(40):
            for c in range(channels):
                if c == 0 or rng.random() < 0.6:
                    n = int(rng.choice([1, 4, 9]))
                    out.append((d, c, at, n, [float(d * 1000 + at) + i / 10 for i in range(n)]))
    return out


def batch_chunks(rows, target, split, channels):
    """Segments and chunks by a fold over the blocks."""
    out = []
    for d in sorted({r[0] for r in rows}):
        segment, size, fed, held = 0, 0, set(), {}
        flush = lambda c: out.append((d, c, segment, *held[c][:2], tuple(held[c][2]), np.array(held[c][3], "<f4").tobytes()))  # noqa: B023, E731
        for at in sorted({r[2] for r in rows if r[0] == d}):
            for _, c, _, n, values in sorted(r for r in rows if r[0] == d and r[2] == at):
                chunk = held.setdefault(c, [0, 0, [], []])
                chunk[2].append(at)
                chunk[3] += values
                size, fed = size + 4 * n, fed | {c}
                if 4 * len(chunk[3]) >= target:
                    flush(c)
                    held[c] = [chunk[0] + 1, chunk[1] + len(chunk[3]), [], []]
            if size >= split and len(fed) >= channels:
                [flush(c) for c in held if held[c][2]]
                segment, size, fed, held = segment + 1, 0, set(), {}
        [flush(c) for c in held if held[c][2]]
    return sorted(out)


def read(spark, root, run):
    rows = recording.read_recording(spark, root, run).collect()
    assert all(r.raw_crc32 == r.payload_crc32 for r in rows)
    return sorted((r.device_id, r.channel_id, r.segment, r.chunk, r.sample_start, tuple(r.source_blocks), bytes(r.payload)) for r in rows)


@pytest.mark.parametrize("size", [7, 60, 1000])
def test_a_recorded_stream_is_the_batch(spark, tmp_path, size):
    rows = recorded_rows()
    order = sorted(rows, key=lambda r: r[2])
    feed = Feed(spark, tmp_path / "r", ROWS).add(*(order[i : i + size] for i in _block_borders(order, size)))
    for name in ("run", "run_001"):
        run = recording.record(feed.stream(), f"{tmp_path}/out", "run", f"{tmp_path}/state-{name}", 60, 400, 2)
        assert run == name and read(spark, f"{tmp_path}/out", run) == batch_chunks(rows, 60, 400, 2)
        if size == 7:
            break


def _block_borders(order, size):
    return range(0, len(order), size)


def test_a_run_stopped_between_write_and_commit(spark, tmp_path, monkeypatch):
    """The batch that was written but not committed runs again under the name that was claimed."""
    rows = recorded_rows(5)
    order = sorted(rows, key=lambda r: r[2])
    cut = next(i for i, r in enumerate(order) if r[2] == 15), next(i for i, r in enumerate(order) if r[2] == 30)
    feed = Feed(spark, tmp_path / "r", ROWS).add(order[: cut[0]], order[cut[0] : cut[1]], order[cut[1] :])
    args = (f"{tmp_path}/out", "run", f"{tmp_path}/state", 60, 400, 2)
    original = recording.F.crc32
    calls = []

    def failing(column):
        calls.append(column)
        if len(calls) == 4:  # in the second batch, once its files would be there
            raise RuntimeError("stopped")
        return original(column)

    monkeypatch.setattr(recording.F, "crc32", failing)
    with pytest.raises(StreamingQueryException):
        recording.record(feed.stream(), *args)
    monkeypatch.setattr(recording.F, "crc32", original)
    # as if the batch had been written before it failed
    junk = spark.createDataFrame([(0, 0, 0, 99, 0, [1], b"x", 0, 0, 0)], "run_key int, device_id int, channel_id int, chunk long, sample_start long, source_blocks array<long>, payload binary, raw_crc32 long, payload_crc32 long, segment long")
    junk.write.mode("overwrite").partitionBy("segment").parquet(f"{tmp_path}/out/run_id=run/batch=1")
    assert recording.record(feed.stream(), *args) == "run"
    assert read(spark, f"{tmp_path}/out", "run") == batch_chunks(rows, 60, 400, 2)
    assert tables.new_run(spark, f"{tmp_path}/out", "run") == "run_001"


@pytest.mark.parametrize("name", ["t1_stream_continuity", "t2_stream_decimate", "t3_stream_latest", "t4_stream_chunks", "t6_stream_report", "k1_stream_chunks"])
def test_registered_streams_do_not_depend_on_batches(spark, monkeypatch, name):
    run = lambda: sorted(map(repr, (tuple(r) for r in registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect())))
    whole = run()
    monkeypatch.setattr(stateful, "FILE_ROWS", 150)
    monkeypatch.setattr(stateful, "BATCH_BYTES", 1)
    assert run() == whole


def test_table_stream_keeps_order_and_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "FILE_ROWS", 10)
    monkeypatch.setattr(stateful, "BATCH_BYTES", 1)
    spark.range(95).selectExpr("94 - id AS id").coalesce(1).write.parquet(f"{tmp_path}/table")
    got = stateful.drain(stateful.table_stream(spark, f"{tmp_path}/table", "id", str(tmp_path)), str(tmp_path)).collect()
    by_batch = {}
    for r in got:
        by_batch.setdefault(r.batch, []).append(r.id)
    assert sorted(i for ids in by_batch.values() for i in ids) == list(range(95))
    assert all(len(ids) <= 10 for ids in by_batch.values())
    assert [i for b in sorted(by_batch) for i in sorted(by_batch[b])] == list(range(95))
