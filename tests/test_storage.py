"""Codecs, capture segments, audit logs, exports and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill import registry
from sigmill.functions.codecs import CODECS, PREPROCESSORS, compress, decompress, preprocess, restore
from sigmill.operators import blocks, envelope
from sigmill.plans import segment_files
from sigmill.plans.segment_files import manifest, segment_bytes
from sigmill.sinks import tables
from sigmill.sources import logs, segments

PAYLOAD = bytes((i * 17 + i // 11) & 255 for i in range(8195))
CHANNELS = [{"Ordinal": k, "DeviceId": 0, "GroupName": "Device_0001_x", "SampleRate": 1000, "ChannelName": f"AI00{k + 1}", "ChannelDescription": "", "Unit": "", "ChannelId": k, "DataIndex": k, "LocalDataIndex": k} for k in (0, 1)]
CHUNKS = [(0, 0, [1.0, 2.0]), (1, 0, [10.0, 20.0, 30.0]), (0, 2, [3.0, 4.0])]


@pytest.mark.parametrize("pre", PREPROCESSORS)
@pytest.mark.parametrize("codec", CODECS)
def test_round_trip(codec, pre):
    for data in (PAYLOAD, b"", b"a", b"abc", b"abcd", PAYLOAD[:9]):
        changed = preprocess(data, pre)
        assert len(changed) == len(data)
        assert restore(decompress(compress(changed, codec), codec, len(changed)), pre) == data


@pytest.mark.parametrize("order", [0, 1, 2, 3, 4, 9])
def test_linear_prediction_orders(order):
    assert restore(preprocess(PAYLOAD, "Lpc", order), "Lpc", order) == PAYLOAD


def test_preprocessors_by_hand():
    assert preprocess(bytes([5, 7, 4]), "Delta1") == bytes([5, 2, 253])
    assert preprocess(bytes([1, 2, 3, 4, 5, 6, 7, 8, 9]), "ByteShuffle") == bytes([1, 5, 2, 6, 3, 7, 4, 8, 9])
    assert np.frombuffer(preprocess(np.array([5, 3, 9], "<i4").tobytes(), "IntDeltaZigZag"), "<u4").tolist() == [5, 3, 12]


def write(folder, name, data):
    folder.joinpath(name).write_bytes(data)


@pytest.mark.parametrize("version", [1, 2, 3])
@pytest.mark.parametrize("footer", [False, True])
@pytest.mark.parametrize("codec,pre", [("Zstd", "Delta1"), ("None", "None"), ("Lz4", "FloatXorDelta")])
def test_segments(spark, tmp_path, version, footer, codec, pre):
    if footer and version == 1:
        pytest.skip("version 1 has no index")
    blocks_ = [{"BlockIndex": 1, "MessageType": "5", "GroupId": 0, "MachineId": 0, "TotalDataCount": 8, "DataCountPerChannel": 4, "BufferCount": 32, "ChannelCount": 2, "Layout": "x"}]
    write(tmp_path, "a.dhcap", segment_bytes(manifest(4, CHANNELS, codec, pre), CHUNKS, version, footer, blocks_))
    root = str(tmp_path)
    channels = segments.capture_channels(spark, root).orderBy("channel_ordinal").collect()
    assert [(r.segment, r.version, r.channel_name, r.codec, r.nominal_rate) for r in channels] == [(4, version, "AI001", codec, 1000.0), (4, version, "AI002", codec, 1000.0)]
    records = segments.capture_records(spark, root).orderBy("record_seq").collect()
    assert [(r.channel_ordinal, r.sample_start, r.sample_count) for r in records] == [(0, 0, 2), (1, 0, 3), (0, 2, 2)]
    assert {r.codec for r in records} <= {codec, "None"} and [len(r.callback_blocks) for r in records] == [int(footer)] * 3
    samples = segments.decode_samples(spark, root).orderBy("channel_ordinal", "local_idx").collect()
    assert [(r.channel_ordinal, r.local_idx, r.value) for r in samples] == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 4), (1, 0, 10), (1, 1, 20), (1, 2, 30)]
    assert {r.status for r in segments.chunk_integrity(spark, root).collect()} == {"ok"}


def test_damaged_segments(spark, tmp_path):
    whole = segment_bytes(manifest(0, CHANNELS, "Zstd", "Delta1"), CHUNKS, 3, False)
    write(tmp_path, "cut.dhcap", whole[:-3])
    assert segments.capture_records(spark, str(tmp_path)).count() == 2
    write(tmp_path, "cut.dhcap", whole[:-1] + bytes([whole[-1] ^ 1]))
    assert sorted(r.status for r in segments.chunk_integrity(spark, str(tmp_path)).collect()) == ["ok", "ok", "payload checksum"]
    write(tmp_path, "cut.dhcap", b"nothing of the kind")
    assert [r.status for r in segments.chunk_integrity(spark, str(tmp_path)).collect()] == ["not a capture segment"]
    bad = segment_bytes(manifest(0, CHANNELS[:1], "None", "None"), CHUNKS, 3, True)
    with pytest.raises(segments.SegmentError):
        list(segments.read_records(bad))


def test_catalog(spark, tmp_path):
    data = segment_bytes(manifest(0, CHANNELS, "None", "None"), CHUNKS)
    for name in ("B_0002.dhcap", "b_0001.DHCAP", "b_0001.tdms"):
        write(tmp_path, name, data)
    write(tmp_path, "other.tdms", b"TDSm")
    got = [r.path.rsplit("/", 1)[1] for r in segments.segment_catalog(spark, str(tmp_path)).collect()]
    assert got == ["b_0001.DHCAP", "B_0002.dhcap", "other.tdms"]
    tmp_path.joinpath("none").mkdir()
    with pytest.raises(segments.SegmentError):
        segments.segment_catalog(spark, f"{tmp_path}/none")


def test_audit_log(spark, tmp_path):
    header = ",".join(logs.AUDIT_COLUMNS)
    rows = ['2024,1,5,0,0,8,4,32,2,ChannelContiguousFloat32, ABCD0123 ,"a ""q"", b"', "", "short,1,2", "2024,2,5,0,0,8,4,32,2,What,00000000"]
    tmp_path.joinpath("a.csv").write_text("\n".join([header, *rows]) + "\n")
    got = logs.read_audit(spark, f"{tmp_path}/a.csv").orderBy("block_index").collect()
    assert [(r.block_index, r.layout, r.crc32, r.group_info) for r in got] == [(1, blocks.CONTIGUOUS, "ABCD0123", 'a "q", b'), (2, blocks.INTERLEAVED, "00000000", None)]


def test_rate_files(spark, tmp_path):
    xml = lambda name, *rates: tmp_path.joinpath(name).write_text("<m><a>" + "".join(f"<{t}>{v}</{t}>" for t, v in rates) + "</a></m>")
    xml("Machine10.0.0.1_1.xml", ("SampleFreq", "500"))
    xml("Machine10.0.0.1_2.xml", ("SampleFrequency", " "), ("SampleFrequency", "250"), ("SampleFreq", "1"))
    xml("Machine10.0.0.2_7.xml", ("SampleFreq", "-5"))
    devices = spark.createDataFrame([(1, "10.0.0.1"), (2, "10.0.0.1"), (3, "10.0.0.1"), (7, "10.0.0.2")], "device_id int, ip_address string")
    assert {r.device_id: r.config_rate for r in logs.device_rate_config(spark, f"{tmp_path}/*.xml", devices).collect()} == {1: 500, 2: 250, 3: 500}


def test_rate_files_of_one_address(spark, tmp_path):
    """An id beyond an int is nobody's own file, and no device meets all files of its address."""
    for name, rate in (("Machine10.0.0.1_99999999999.xml", 7), ("Machine10.0.0.1_1.xml", 500), ("Machine10.0.0.1_2.xml", 0)):
        tmp_path.joinpath(name).write_text(f"<m><SampleFreq>{rate}</SampleFreq></m>")
    devices = spark.createDataFrame([(1, "10.0.0.1"), (2, "10.0.0.1"), (3, None)], "device_id int, ip_address string")
    found = logs.device_rate_config(spark, f"{tmp_path}/Machine*.xml", devices)
    assert {r.device_id: r.config_rate for r in found.collect()} == {1: 500, 2: 500}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    for side in plan.split("Join ")[1:]:  # every join has a grouped side
        assert "Aggregate" in side
    assert logs.device_rate_config(spark, f"{tmp_path}/None*.xml", devices).count() == 0


@pytest.mark.parametrize("folder", [3, 1000])
def test_named_files(spark, tmp_path, monkeypatch, folder):
    monkeypatch.setattr(segment_files, "FOLDER_FILES", folder)
    rows = spark.createDataFrame([(f"<a>{i}</a><!--n{i}.xml-->",) for i in range(10)], "value string")
    segment_files.write_named(rows, f"{tmp_path}/out")
    got = {p.name: p.read_text() for p in tmp_path.joinpath("out").iterdir() if not p.name.startswith(".")}
    assert got == {f"n{i}.xml": f"<a>{i}</a><!--n{i}.xml-->\n" for i in range(10)}


SAMPLES = "device_id int, channel string, sample_idx long, value double"
RANGE = "device_id int, channel string, start_sample long, sample_count long"


def test_export_rules(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", i, float(i)) for i in (0, 1, 5)], SAMPLES)
    ranges = spark.createDataFrame([(0, "a", 0, 8)], RANGE)
    assert tables.export_samples(rows, ranges, f"{tmp_path}/out").first().written == 8
    assert [r.value for r in spark.read.parquet(f"{tmp_path}/out").orderBy("sample_idx").collect()] == [0, 1, 0, 0, 0, 5, 0, 0]
    with pytest.raises(FileExistsError):
        tables.export_samples(rows, ranges, f"{tmp_path}/out")
    with pytest.raises(ValueError):
        tables.export_samples(rows, ranges, f"{tmp_path}/src/out", source=f"{tmp_path}/src")
    with pytest.raises(ValueError):
        tables.export_samples(rows, ranges, f"{tmp_path}/new", slice_samples=2)
    assert not tmp_path.joinpath("new").exists()


@pytest.mark.parametrize("observed", [2000, 1])
def test_an_export_tells_what_it_wrote_of_each_channel(spark, tmp_path, monkeypatch, observed):
    """From the write itself, if there are not too many channels."""
    monkeypatch.setattr(tables, "OBSERVED", observed)
    rows = spark.createDataFrame([(d, c, i, 1.0) for d in (0, 1) for c in "ab" for i in range(0, 40 + 10 * d, 3)], SAMPLES)
    ranges = spark.createDataFrame([(d, c, 0, 40 + 10 * d) for d in (0, 1) for c in "ab"] + [(2, "none", 0, 0)], RANGE)
    got = tables.export_samples(rows, ranges, f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == [(d, c, 40 + 10 * d) for d in (0, 1) for c in "ab"]
    stored = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, stored.groupBy("device_id", "channel").count().collect())) == sorted(map(tuple, got.collect()))


def test_runs_are_never_reused(spark, tmp_path):
    chunks = spark.createDataFrame([(0, 1, 2.0)], "segment int, chunk_seq long, first double")
    assert [tables.write_chunks(chunks, str(tmp_path), "run") for _ in range(3)] == ["run", "run_001", "run_002"]


def test_a_segment_has_a_file_and_not_one_of_each_task(spark, tmp_path):
    chunks = spark.range(0, 400, 1, 8).selectExpr("CAST(id % 10 AS INT) AS segment", "id AS chunk_seq", "CAST(CAST(id AS STRING) AS BINARY) AS payload")
    tables.write_chunks(chunks, str(tmp_path), "run")
    assert len(list(tmp_path.glob("run_id=run/segment=*"))) == 10 and len(list(tmp_path.glob("run_id=run/segment=*/*.parquet"))) == 10
    assert spark.read.parquet(str(tmp_path)).count() == 400
