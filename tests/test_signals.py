"""Operators on small inputs with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from sigmill.functions import scalars as sc
from sigmill.operators import audit, blocks, catalog, envelope, ranks, reports
from sigmill.sinks import tables

NAN, INF = math.nan, math.inf


def series(spark, values, channel="a"):
    return spark.createDataFrame([(0, channel, i, float(v)) for i, v in enumerate(values)], "device_id int, channel string, sample_idx long, value double")


def test_spike_survives_downsampling(spark):
    got = envelope.downsample_points(series(spark, [100.0 if i == 4321 else 0.0 for i in range(10_000)]), 100).collect()
    assert len(got) == 100 and max(r.maximum for r in got) == 100


def test_square_wave_has_both_signs(spark):
    got = envelope.downsample_points(series(spark, [-1.0] * 500 + [1.0] * 500), 50).collect()
    assert len(got) == 50 and {r.minimum for r in got} | {r.maximum for r in got} == {-1.0, 1.0}


def test_non_finite_values_are_dropped(spark):
    r = envelope.downsample_points(series(spark, [NAN, -2, INF, 3, -INF]), 1).first()
    assert (r.first, r.last, r.minimum, r.maximum) == (-2, 3, -2, 3)
    r = envelope.downsample_points(series(spark, [NAN, NAN]), 1).first()
    assert all(math.isnan(x) for x in (r.first, r.last, r.minimum, r.maximum))


def test_envelopes_merge(spark):
    points = spark.createDataFrame([(0, "a", 0, 1.0, 2.0, -10.0, 4.0), (0, "a", 1, 2.0, 3.0, -1.0, 99.0), (0, "a", 2, 3.0, 4.0, -3.0, 5.0)], "device_id int, channel string, point_idx long, first double, last double, minimum double, maximum double")
    r = envelope.downsample_envelopes(points, 1).first()
    assert (r.first, r.last, r.minimum, r.maximum) == (1, 4, -10, 99)
    assert [r.point_idx for r in envelope.latest_points(points, 2).orderBy("pos").collect()] == [1, 2]


@pytest.mark.parametrize("n,b,boundary,floor", [(10, 3, [3, 3, 4], [4, 3, 3]), (22, 22, [1] * 22, None), (5, 5, [1] * 5, [1] * 5)])
def test_bucket_rules_differ(spark, n, b, boundary, floor):
    df = spark.range(n).select(sc.bucket_boundary(F.col("id"), F.lit(n), F.lit(b)).alias("p"), sc.bucket_floor(F.col("id"), F.lit(n), F.lit(b)).alias("f"))
    rows = df.collect()
    assert [sum(r.p == k for r in rows) for k in range(b)] == boundary
    assert [r.f for r in rows] == [min(b - 1, int(i / n * b)) for i in range(n)]
    if floor:
        assert [sum(r.f == k for r in rows) for k in range(b)] == floor


@pytest.mark.parametrize("values,want", [([NAN, 1, 2], (NAN, 2, NAN, NAN)), ([1, NAN, 3], (1, 3, 1, 3)), ([1, 5, NAN], (1, NAN, 1, 5)), ([INF, 1], (INF, 1, 1, INF)), ([NAN, NAN], (NAN, NAN, NAN, NAN))])
def test_stored_summaries_keep_nan_by_rule(spark, values, want):
    r = envelope.chunk_summary(series(spark, values), 10).first()
    assert repr((r.first, r.last, r.minimum, r.maximum)) == repr(tuple(map(float, want)))


def requests(spark, *rows):
    return spark.createDataFrame([(0, "a", i, *r) for i, r in enumerate(rows)], "device_id int, channel string, req_id int, start_sample long, sample_count long, buckets int")


def totals(spark, n):
    return spark.createDataFrame([(0, "a", n)], "device_id int, channel string, n long")


def test_envelope_of_block_values(spark):
    got = envelope.channel_envelope(series(spark, [1, 2, 3, 4]), requests(spark, (0, 4, 4), (2, 100, 9), (9, 1, 1), (0, 4, 0)), totals(spark, 4)).collect()
    assert sorted((r.req_id, r.bucket, r.maximum) for r in got) == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 4), (1, 0, 3), (1, 1, 4), (3, 0, 4)]


def test_gaps_in_an_envelope_are_zero(spark):
    rows = series(spark, range(10)).filter("sample_idx < 3 or sample_idx > 6")
    got = {r.bucket: r.maximum for r in envelope.channel_envelope(rows, requests(spark, (0, 10, 5)), totals(spark, 10)).collect()}
    assert got == {0: 1, 1: 2, 2: 0, 3: 7, 4: 9}


@pytest.mark.parametrize("b", [1, 3, 7, 20])
@pytest.mark.parametrize("nan", [False, True])
def test_summaries_give_the_envelope_of_samples(spark, b, nan):
    values = [math.sin(i * 0.7) * i for i in range(301)]
    if nan:
        values[64] = values[100] = values[300] = NAN
    rows = series(spark, values)
    asked, n = requests(spark, (0, 301, b), (17, 200, b), (64, 64, b), (300, 1, b)), totals(spark, 301)
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    assert key(envelope.envelope_from_summaries(envelope.chunk_summary(rows, 16), rows, asked, n, 16)) == key(envelope.channel_envelope(rows, asked, n))


@pytest.mark.parametrize("nan", [False, True])
@pytest.mark.parametrize("levels", [0, 1, 4])
def test_a_pyramid_gives_the_envelope_of_samples(spark, levels, nan):
    values = [math.sin(i * 0.7) * i for i in range(301)]
    if nan:
        values[64] = values[100] = values[300] = values[0] = NAN
    rows = series(spark, values)
    asked, n = requests(spark, *((low, size, b) for b in (1, 3, 7, 20) for low, size in ((0, 301), (17, 200), (64, 64), (300, 1), (5, 3), (15, 2)))), totals(spark, 301)
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    whole = rows.groupBy("device_id", "channel", F.floor(F.col("sample_idx") / 16).alias("chunk_seq")).agg(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("all"))
    chunks = whole.select("device_id", "channel", "chunk_seq", F.transform("all", lambda c: c["value"]).alias("values"))
    pyramid = envelope.lod_pyramid(envelope.chunk_summary(rows, 16), levels, clean=True)
    assert key(envelope.envelope_from_pyramid(pyramid, chunks, asked, n, 16, levels)) == key(envelope.channel_envelope(rows, asked, n))


def test_a_cover_has_few_nodes_and_all_positions(spark):
    asked, n = requests(spark, *((low, 16 * 1000 - 2 * low, b) for b in (1, 3, 20) for low in (0, 5, 16, 333))), totals(spark, 16_000)
    cut = envelope.clip_requests(asked, n)
    covers = envelope.bucket_covers(cut, 16, 9).collect()
    for r in covers:
        held = [i for node in r.nodes for i in range(node.seq << node.level, node.seq + 1 << node.level)]
        assert sorted(held) == list(range(-(-r.low // 16), r.high // 16)) and len(r.nodes) <= 2 * 9 + 2
    for req in {r.req_id for r in covers}:
        own = sorted((r.low, r.high) for r in covers if r.req_id == req)
        assert all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_bucket_begins_are_those_of_the_rule(spark):
    """For lengths and numbers of buckets at which doubles round."""
    pairs = [(n, b) for n in (1, 2, 7, 49, 100, 1315, 10_000, 123_457) for b in (1, 3, 7, 49, 97, 512, 4096) if b <= n]
    rows = spark.createDataFrame(pairs, "n long, b long").select("n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b"))).alias("j"))
    got = {(r.n, r.b, r.j): r.at for r in rows.withColumn("at", envelope._bucket_begin(F.col("j"))).collect()}
    for (n, b), begins in {(n, b): [got[n, b, j] for j in range(b + 1)] for n, b in pairs}.items():
        of = lambda i: max(0, min(b - 1, int(i / n * b)))
        assert begins[0] == 0 and begins[b] == n and all((x == 0 or of(x - 1) < j) and of(x) >= j for j, x in enumerate(begins[:b]))


def test_ranges_read_only_the_bins_that_they_touch(spark, tmp_path):
    many = spark.createDataFrame([(d, c, i, float(i)) for d in range(3) for c in "ab" for i in range(1000)], "device_id int, channel string, sample_idx long, value double")
    stored = tables.write_samples(many, f"file://{tmp_path}/recording", 100)
    assert key_rows(stored.drop("bin")) == key_rows(many)
    read = lambda df: (df.collect(), scanned(df))[1]
    ask = lambda low, n: spark.createDataFrame([(1, "a", 0, low, n, 4)], "device_id int, channel string, req_id int, start_sample long, sample_count long, buckets int")
    for low, n, bins in ((250, 40, 1), (250, 100, 2), (0, 1000, 10), (950, 500, 1)):
        got = envelope.slice_range(stored, envelope.clip_requests(ask(low, n), totals_of(spark, many)).withColumn("sample_count", F.col("n")), width=100)
        assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()
        assert key_rows(got.select("sample_idx")) == [repr((i,)) for i in sorted(range(low, min(1000, low + n)), key=lambda i: repr((i,)))]
        assert read(got) == bins  # a file for each channel of a bin at most, here one folder each


def totals_of(spark, samples):
    return samples.groupBy("device_id", "channel").agg(F.count("*").alias("n"))


def key_rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def scanned(df):
    """Partitions that the scan of a collected frame read."""
    plan = df._jdf.queryExecution().executedPlan()
    found, left = 0, [plan]
    while left:
        node = left.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif "QueryStage" in node.getClass().getSimpleName():
            left.append(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec" and node.metrics().contains("numPartitions"):
            found = max(found, node.metrics().apply("numPartitions").value())
        left += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_positions_across_spans(spark):
    rows = series(spark, range(50)).filter("sample_idx % 3 <> 1").withColumn("sample_idx", F.col("sample_idx") * 7)
    got = ranks.with_positions(rows, ["device_id", "channel"], "sample_idx", total="n", span=20).orderBy("sample_idx").collect()
    assert [r.pos for r in got] == list(range(33)) and {r.n for r in got} == {33}


def test_interleave_undoes_deinterleave(spark):
    rows = [(1, blocks.INTERLEAVED, 4, 2, [1.0, 10.0, 2.0, 20.0, 3.0, 30.0, 4.0, 40.0]), (2, blocks.CONTIGUOUS, 4, 2, [1.0, 2.0, 3.0, 4.0, 10.0, 20.0, 30.0, 40.0])]
    df = spark.createDataFrame(rows, "block_index long, layout string, data_count_per_channel int, channel_count int, payload array<float>")
    flat = blocks.deinterleave(df)
    for b in (1, 2):
        assert [r.value for r in flat.filter(f"block_index = {b} and channel_pos = 0").orderBy("i").collect()] == [1, 2, 3, 4]
    assert {r.block_index: r.payload for r in blocks.interleave(flat, df).collect()} == {r[0]: r[4] for r in rows}
    assert {(r.block_index, r.channel_pos): r["values"] for r in blocks.channel_arrays(df).collect()}[(1, 1)] == [10, 20, 30, 40]


def heads(spark, rows):
    return spark.createDataFrame(rows, "block_index long, group_id int, machine_id int, total_data_count long, data_count_per_channel int")


def test_continuity(spark):
    rows = [(0, 1, 1, 0, 10), (1, 1, 1, 10, 10), (2, -1, 2, 5, 5), (3, 1, 1, 25, 10), (4, 1, 1, 35, 10), (5, -1, 2, 9, 5), (6, 1, 1, 0, 10), (7, 2, 9, 14, 1)]
    got = sorted((r.key, r.block_index, r.expected, r.actual) for r in blocks.continuity_check(heads(spark, rows)).collect())
    assert got == [(1, 3, 20, 25), (1, 6, 45, 0), (2, 5, 10, 9)]
    assert blocks.until_first_fault(heads(spark, rows)).count() == 3
    assert blocks.until_first_fault(heads(spark, rows[:3])).count() == 3


def test_chunks_of_uneven_blocks(spark):
    rows = spark.createDataFrame([(0, 0, i, n) for i, n in enumerate([3, 3, 3, 9, 1, 1])] + [(0, 1, 0, 2)], "device_id int, channel_id int, block_index long, data_count_per_channel int")
    got = {(r.channel_id, r.block_index): r.chunk for r in blocks.assign_chunks(rows, 24).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (0, 2): 1, (0, 3): 1, (0, 4): 2, (0, 5): 2, (1, 0): 0}
    run = rows.withColumn("run_id", F.lit(1))
    assert {r.block_index: r.segment for r in blocks.assign_segments(run, 20, 2).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}


def test_gap_filling_by_slices(spark):
    rows = series(spark, range(10)).filter("sample_idx in (1, 2, 9)")
    ranges = spark.createDataFrame([(0, "a", 0, 10)], "device_id int, channel string, start_sample long, sample_count long")
    got = {r.sample_idx: r.value for r in envelope.fill_gaps(rows, ranges, slice_samples=4).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 8: 0, 9: 9}


def test_stitching_skips_missing_segments(spark):
    rows = spark.createDataFrame([(0, "a", 0, 0), (0, "a", 0, 3), (0, "a", 2, 1), (0, "b", 1, 0)], "device_id int, channel string, segment int, local_idx long")
    assert sorted((r.channel, r.segment, r.sample_idx) for r in envelope.stitch_segments(rows).collect()) == [("a", 0, 0), ("a", 0, 3), ("a", 2, 5), ("b", 1, 0)]


@pytest.mark.parametrize("ms,expected", [(1004, 1000.0), (1010, 5000 / 5.05)])
def test_effective_rate_threshold(spark, ms, expected):
    """5000 samples in five blocks of a nominal second; under half a percent off, the nominal rate stands."""
    rows = spark.createDataFrame([("a", i * 1000, 1000, [(1_000_000 + i * ms + (ms - 1000 if i == 4 else 0), 1000)]) for i in range(5)], "c string, sample_start long, sample_count long, callback_blocks array<struct<sample_time:long,data_count_per_channel:int>>")
    nominal = spark.createDataFrame([("a", 1000.0), ("none", 5.0)], "c string, nominal_rate double")
    got = {r.c: (r.sample_count, r.sample_rate) for r in catalog.effective_sample_rate(rows, nominal, ["c"]).collect()}
    assert got["a"][0] == 5000 and got["a"][1] == pytest.approx(expected) and got["none"] == (0, 5.0)


def test_crc(spark):
    r = spark.createDataFrame([("123456789", ""), (None, None)], "a string, b string").select(sc.crc32_hex(F.col("a").cast("binary")), sc.crc32_hex(F.col("b").cast("binary"))).collect()
    assert tuple(r[0]) == ("CBF43926", "00000000") and tuple(r[1]) == (None, None)


def test_audit_across_devices(spark):
    """A block of all devices is rebuilt from every device's channels by position."""
    samples = spark.createDataFrame([(d, d, i, float(10 * d + i)) for d in (0, 1) for i in range(4)], "device_id int, position int, sample_idx long, value double")
    whole = [float(10 * d + i) for i in range(2, 4) for d in (0, 1)]
    log = spark.createDataFrame([(1, -1, 5, 2, 16, 2, blocks.INTERLEAVED, [0.0, 10.0, 1.0, 11.0]), (2, -1, 7, 2, 16, 2, blocks.INTERLEAVED, whole), (3, 8, 0, 2, 16, 2, blocks.CONTIGUOUS, whole)], "block_index long, group_id int, total_data_count long, data_count_per_channel int, buffer_count int, channel_count int, layout string, payload array<float>")
    checked = audit.audit_verify(log.withColumn("crc32", F.lower(sc.crc32_hex(sc.float_bytes("payload")))).drop("payload"), samples)
    assert {r.block_index: r.reason for r in checked.collect()} == {1: None, 2: None, 3: "group is missing"}
    s = audit.audit_summary(checked).first()
    assert (s.checked_blocks, s.checked_bytes, s.mismatches, s.passed) == (2, 32, 1, False)


def test_axis_bounds(spark):
    rows = spark.createDataFrame([(-3.0, 7.2), (0.0, 1.0)], "low double, high double")
    assert [(r.axis_low, r.axis_high) for r in reports.axis_bounds(rows).orderBy("low").collect()] == [(-4.0, 8.0), (0.0, 1.0)]
    assert {(r.axis_low, r.axis_high) for r in reports.axis_bounds(rows, True, 10.0).collect()} == {(-10.0, 10.0)}
    flat = spark.createDataFrame([(1, 5.0, 5.0), (2, NAN, NAN)], "k int, minimum double, maximum double")
    assert {r.k: (r.low, r.high) for r in reports.value_range(flat, ["k"]).collect()} == {1: (4, 6), 2: (-1, 1)}


def test_empty_inputs(spark):
    none = series(spark, [1.0]).limit(0)
    assert envelope.chunk_summary(none, 4).count() == 0
    assert envelope.downsample_points(none, 4).count() == 0
    assert blocks.continuity_check(heads(spark, [(0, 0, 0, 0, 1)]).limit(0)).count() == 0


def test_checksums_of_pieces_make_that_of_the_whole(spark):
    import random
    import zlib

    rng = random.Random(3)
    rows, want = [], {}
    for k in range(40):
        data = rng.randbytes(rng.choice((0, 1, 7, 300, 5000)))
        want[k] = zlib.crc32(data)
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(k % 6))})
        pieces = list(zip(cuts, cuts[1:])) or [(0, 0)]
        rng.shuffle(pieces)
        rows += [(k, data[i:j], len(data) - j) for i, j in pieces]
    df = spark.createDataFrame(rows, "k int, piece binary, after long").repartition(3)
    got = df.groupBy("k").agg(F.bit_xor(sc.crc32_before(F.crc32("piece"), "after")).alias("crc")).collect()
    assert {r.k: r.crc for r in got} == want
    far = 10**12  # bytes after, which none has to hold
    (a, b), = df.limit(1).select(sc.crc32_before(F.lit(0x12345678).cast("long"), F.lit(far)).alias("a"), sc.crc32_before(sc.crc32_before(F.lit(0x12345678).cast("long"), F.lit(far - 77)), F.lit(77)).alias("b")).collect()
    assert a == b


@pytest.mark.parametrize("layout", [blocks.INTERLEAVED, blocks.CONTIGUOUS])
def test_an_audit_of_blocks_across_pieces(spark, layout):
    """Pieces end within blocks; a sample that is missing, or a channel too many, does not hold."""
    import zlib

    import numpy as np

    series_ = {c: [float(c * 100 + i) for i in range(30)] for c in range(2)}
    pieces = [(0, c, s, series_[c][s:e]) for c in range(2) for s, e in ((0, 7), (7, 8), (8, 30))]
    order = lambda lo, hi: [series_[c][i] for i in range(lo, hi) for c in range(2)] if layout == blocks.INTERLEAVED else [series_[c][i] for c in range(2) for i in range(lo, hi)]
    crc = lambda lo, hi: f"{zlib.crc32(np.array(order(lo, hi), '<f4').tobytes()):08x}"
    log = [(1, 0, 0, 10, 2, layout, crc(0, 10), 80), (2, 0, 10, 20, 2, layout, f" {crc(10, 30)} ", 160), (3, 0, 5, 10, 2, layout, "00000000", 80), (4, 0, 25, 10, 2, layout, crc(20, 30), 80), (5, 9, 0, 10, 2, layout, crc(0, 10), 80)]
    audit_rows = spark.createDataFrame(log, "block_index long, group_id int, total_data_count long, data_count_per_channel int, channel_count int, layout string, crc32 string, buffer_count int")
    stored = spark.createDataFrame(pieces, "device_id int, position int, start long, values array<float>")
    got = {r.block_index: r.reason for r in audit.audit_verify(audit_rows, stored, 4).collect()}
    assert got == {1: None, 2: None, 3: "checksum differs", 4: "checksum differs", 5: "group is missing"}
