import random

import pytest
from pyspark.sql import functions as F

from sigmill.operators import blocks, boundaries, scans

HEADS = "device_id int, channel_id int, block_index long, data_count_per_channel int"


def series(seed=1):
    """Two long channels with gaps between their blocks, one of a single block, and one without a device."""
    rng, rows = random.Random(seed), []
    for channel, n in ((0, 157), (1, 64), (2, 1)):
        at = 0
        for _ in range(n):
            at += rng.choice((1, 1, 2, 40))
            rows.append((3, channel, at, rng.choice((0, 1, 2, 3, 9, 30))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("span", [4, 1 << 16])
def test_running_values_and_neighbours(spark, span):
    rows = series() + [(None, 0, i, i) for i in range(20)]
    df, keys = spark.createDataFrame(rows, HEADS), ["device_id", "channel_id"]
    n = F.col("data_count_per_channel")
    got = scans.running(df, keys, "block_index", {"before": ("sum", n), "most": ("max", n)}, span=span)
    got = scans.running(got, keys, "block_index", {"least": ("min", n)}, inclusive=True, span=span)
    got = scans.neighbour(got, keys, "block_index", {"last": n, "last_block": F.col("block_index")}, span=span)
    got = scans.neighbour(got, keys, "block_index", {"next": n}, after=True, span=span)
    found = {(r.device_id, r.channel_id, r.block_index): (r.before, r.most, r.least, r["last"], r.last_block, r.next) for r in got.collect()}
    want = {}
    for d, c in {r[:2] for r in rows}:
        own = sorted(r[2:] for r in rows if r[:2] == (d, c))
        for i, (at, _) in enumerate(own):
            seen = [x for _, x in own[:i]]
            want[d, c, at] = (sum(seen) if i else None, max(seen, default=None), min(seen + [own[i][1]]), seen[-1] if i else None, own[i - 1][0] if i else None, own[i + 1][1] if i + 1 < len(own) else None)
    assert found == want


def folded(own, target):
    """The groups of (order, bytes) rows by a fold."""
    out, group, size = {}, 0, 0
    for at, n in sorted(own):
        out[at] = group
        size += n
        if size >= target:
            group, size = group + 1, 0
    return out


@pytest.mark.parametrize("span,target", [(4, 40), (16, 200), (4, 1 << 20), (1 << 16, 1)])
def test_chunks_are_those_of_a_fold(spark, span, target):
    rows = series(2)
    got = blocks.assign_chunks(spark.createDataFrame(rows, HEADS), target, span=span)
    want = {(c, at): g for c in (0, 1, 2) for at, g in folded([(r[2], 4 * r[3]) for r in rows if r[1] == c], target).items()}
    assert {(r.channel_id, r.block_index): r.chunk for r in got.collect()} == want


def folded_segments(rows, target, channels):
    out, segment, size, fed = {}, 0, 0, set()
    for at in sorted({r[2] for r in rows}):
        own = [r for r in rows if r[2] == at]
        out[at] = segment
        size += sum(4 * r[3] for r in own)
        fed |= {r[:2] for r in own}
        if size >= target and len(fed) >= channels:
            segment, size, fed = segment + 1, 0, set()
    return out


@pytest.mark.parametrize("span,target", [(4, 300), (4, 1), (1 << 16, 300)])
def test_segments_wait_for_all_channels(spark, span, target):
    rng = random.Random(4)
    rows = {1: [], 2: [], 3: []}
    for at in range(120):
        for c in range(3):
            if rng.random() < (0.9, 0.5, 0.1)[c]:
                rows[1].append((0, c, at, rng.choice((1, 5, 20))))
            if c < 2 and at > 3:
                rows[2].append((c, 0, at, 8))
        rows[3].append((0, 0, at, 8))  # one of the channels alone: never whole
    df = spark.createDataFrame([(run, *r) for run, own in rows.items() for r in own], "run_id int, " + HEADS)
    for channels in (2, 3):
        got = {(r.run_id, r.block_index): r.segment for r in blocks.assign_segments(df, target, channels, span=span).collect()}
        fit = {run: own for run, own in rows.items() if len({r[:2] for r in own}) == channels or run == 3}
        want = {(run, at): s for run, own in fit.items() for at, s in folded_segments(own, target, channels).items()}
        assert {k: v for k, v in got.items() if k[0] in fit} == want


def test_a_chain_longer_than_the_spans(spark):
    """Groups that span several spans, and rows after which no group begins."""
    jumps = [(0, i, (i // 10 + 1) * 10 if i < 90 else None) for i in range(97)] + [(1, 0, 1), (1, 1, None)]
    got = boundaries.groups(spark.createDataFrame(jumps, "k int, pos long, next long"), ["k"], span=3).collect()
    assert {(r.k, r.pos): r.group for r in got} == {(0, i): i // 10 for i in range(97)} | {(1, 0): 0, (1, 1): 1}


@pytest.mark.parametrize("pack", [1, 64, 1 << 14])
def test_many_short_series_share_a_call(spark, monkeypatch, pack):
    """Calls of Python grow with the rows, not with the series; no call has a span of another's."""
    monkeypatch.setattr(boundaries, "PACK", pack)
    rng = random.Random(5)
    jumps = [(k, None if k % 7 == 3 else f"d{k % 3}", i, i + rng.choice((1, 2, 3)) if i < 4 + k % 4 else None) for k in range(200) for i in range(5 + k % 5)]
    jumps = [j for j in jumps if j[1] is not None]
    rising = {}
    for k, d, i, to in jumps:  # jumps never fall along pos
        rising[k, i] = to if to is None else max(to, rising.get((k, i - 1)) or 0)
    jumps = [(k, d, i, rising[k, i] if rising[k, i] is None or rising[k, i] < 5 + k % 5 else None) for k, d, i, _ in jumps]
    got = boundaries.groups(spark.createDataFrame(jumps, "k int, d string, pos long, next long"), ["k", "d"], span=4)
    want = {}
    for k in {j[0] for j in jumps}:
        to, group, at = {j[2]: j[3] for j in jumps if j[0] == k}, -1, 0
        for i in sorted(to):
            if i == at:
                group, at = group + 1, to[i]
            want[k, i] = group
    assert {(r.k, r.pos): r.group for r in got.collect()} == want
    tables = spark.createDataFrame(jumps, "k int, d string, pos long, next long").withColumn("__span", F.lit(0)).fillna({"next": boundaries.NEVER}).toArrow()
    assert boundaries._exits(tables, ["k", "d"]).num_rows > 2  # one call takes all series


def test_no_window_holds_a_channel(spark):
    """Every window over rows is within a span; those over series are of one row for each span."""
    df = spark.createDataFrame(series(), HEADS)
    plan = blocks.assign_sample_index(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__span" in line.split("]", 1)[1] for line in windows)


def test_empty(spark):
    none = spark.createDataFrame([], "run_id int, " + HEADS)
    assert blocks.assign_chunks(none, 10).collect() == [] and blocks.assign_segments(none, 10, 1).collect() == [] and blocks.assign_sample_index(none).collect() == []
