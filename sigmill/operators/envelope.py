"""Summaries and envelopes (first, last, minimum, maximum by bucket) of sample series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.functions.scalars import bucket_boundary, bucket_floor, is_finite, valid_rate, whole_quotient
from sigmill.operators.ranks import each_with_all, small, with_positions
from sigmill.plans.shared import materialise

KEYS = ("device_id", "channel")
NAN = float("nan")
#: Width of the spans by which the newest points are found.
TAIL = 1 << 12


def extremes(value: str = "value", order: str = "sample_idx") -> list[Column]:
    """first, last, minimum and maximum of a group as the stored path has them.

    A first value that is NaN makes both extremes NaN; later NaN count only as last.
    """
    first = F.min_by(value, order)
    known = F.when(~F.isnan(value), F.col(value))
    return [first.alias("first"), F.max_by(value, order).alias("last"), F.when(F.isnan(first), NAN).otherwise(F.min(known)).alias("minimum"), F.when(F.isnan(first), NAN).otherwise(F.max(known)).alias("maximum")]


def merged(order: str) -> list[Column]:
    """The same of parts that each have them."""
    first = F.min_by("first", order)
    low, high = (F.when(~F.isnan(c), F.col(c)) for c in ("minimum", "maximum"))
    return [first.alias("first"), F.max_by("last", order).alias("last"), F.when(F.isnan(first), NAN).otherwise(F.min(low)).alias("minimum"), F.when(F.isnan(first), NAN).otherwise(F.max(high)).alias("maximum")]


def finite_only(samples: DataFrame, value: str = "value") -> DataFrame:
    return samples.filter(is_finite(F.col(value)))


def chunk_summary(samples: DataFrame, chunk_size: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A row for each chunk of consecutive positions."""
    seq = whole_quotient(F.col("sample_idx"), F.lit(chunk_size))
    return samples.groupBy(*keys, seq.alias("chunk_seq")).agg(F.min("sample_idx").alias("sample_start"), F.count("*").alias("sample_count"), *extremes())


def clip_requests(requests: DataFrame, totals: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Requests with ``n`` (samples that there are of those asked for) and ``b`` (buckets, at most n); those past the end go."""
    n = F.least(F.col("sample_count"), F.col("total") - F.col("start_sample"))
    cut = requests.join(totals.select(*keys, F.col("n").alias("total")), list(keys)).withColumn("n", n).filter("n > 0 and start_sample >= 0").drop("total")
    return cut.withColumn("b", F.least(F.greatest(F.lit(1).cast("long"), F.col("buckets").cast("long")), F.col("n")))


def in_bins(requests: DataFrame, width: int) -> DataFrame:
    """A row with ``bin`` for each bin of ``width`` positions that a request touches."""
    first, last = (whole_quotient(x, F.lit(width)) for x in (F.col("start_sample"), F.col("start_sample") + F.col("sample_count") - 1))
    return requests.filter("sample_count > 0 and start_sample >= 0").withColumn("bin", F.explode(F.sequence(first, last)))


def slice_range(samples: DataFrame, requests: DataFrame, keys: tuple[str, ...] = KEYS, width: int | None = None) -> DataFrame:
    """Samples in the requested ranges, with the request's columns.

    ``width``: of the bins by which a table of samples is partitioned
    (``write_samples``); of it only the devices and bins of some request are read.
    """
    ends = F.col("start_sample") + F.col("sample_count")
    if width:  # stored, as Spark prunes by what it can plan alike for the join and for the scan
        asked = small(materialise(in_bins(requests, width)).filter("bin >= 0"))
        met = samples.join(asked, [*keys, "bin"]).drop("bin")
    else:
        met = samples.join(small(requests), list(keys))
    return met.filter((F.col("sample_idx") >= F.col("start_sample")) & (F.col("sample_idx") < ends))


def _bucket(i: Column, rule: str) -> Column:
    return (bucket_floor if rule == "floor" else bucket_boundary)(i, F.col("n"), F.col("b"))


def _all_buckets(found: DataFrame, requests: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Every bucket of every request; those without samples have zeros."""
    grid = requests.select(*keys, "req_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("bucket"))
    values = ["first", "last", "minimum", "maximum"]
    return grid.join(found, [*keys, "req_id", "bucket"], "left").select(*keys, "req_id", "bucket", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in values))


def channel_envelope(samples: DataFrame, requests: DataFrame, totals: DataFrame, rule: str = "floor", non_finite: str = "keep", keys: tuple[str, ...] = KEYS, width: int | None = None) -> DataFrame:
    """(keys, req_id, bucket, first, last, minimum, maximum) for requests (keys, req_id, start_sample, sample_count, buckets).

    ``rule``: 'floor' as captures have it, or 'boundary' as exported files have
    it. ``non_finite``: 'keep' them by the stored path's rule, or 'drop' them.
    ``width``: as ``slice_range`` has it.
    """
    cut = clip_requests(requests, totals, keys).withColumn("sample_count", F.col("n"))
    rows = slice_range(finite_only(samples) if non_finite == "drop" else samples, cut, keys, width)
    bucket = _bucket(F.col("sample_idx") - F.col("start_sample"), rule)
    return _all_buckets(rows.groupBy(*keys, "req_id", bucket.alias("bucket")).agg(*extremes()), cut, keys)


def overlap_records(requests: DataFrame, records: DataFrame, width: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Pairs of a request and a record (sample_start, sample_count) whose ranges overlap.

    Both sides are dealt into bins of ``width`` positions, so the join is on
    equal keys; a pair is taken in the first bin that it shares.
    """
    bins = lambda start, n: F.explode(F.sequence(whole_quotient(start, F.lit(width)), whole_quotient(start + n - 1, F.lit(width))))
    asked = requests.filter("sample_count > 0").withColumn("bin", bins(F.col("start_sample"), F.col("sample_count"))).withColumnRenamed("sample_count", "asked")
    held = records.filter("sample_count > 0").withColumn("bin", bins(F.col("sample_start"), F.col("sample_count")))
    first = whole_quotient(F.greatest("start_sample", "sample_start"), F.lit(width))
    meet = (F.col("sample_start") + F.col("sample_count") > F.col("start_sample")) & (F.col("sample_start") < F.col("start_sample") + F.col("asked"))
    return asked.join(held, [*keys, "bin"]).filter(meet & (F.col("bin") == first)).drop("bin").withColumnRenamed("asked", "request_count")


def envelope_from_summaries(chunks: DataFrame, samples: DataFrame, requests: DataFrame, totals: DataFrame, chunk_size: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``channel_envelope`` by the floor rule, reading samples only where summaries do not do.

    A chunk's summary does if the chunk lies in the range and in one bucket and
    has no NaN. ``samples`` are single ones (sample_idx, value), or whole chunks
    (chunk_seq and an array ``values``); of chunks only those needed are opened.
    """
    cut = clip_requests(requests, totals, keys).withColumn("sample_count", F.col("n"))
    held = overlap_records(cut, chunks, max(chunk_size, 1) * 16, keys)
    at = F.col("sample_start") - F.col("start_sample")
    low, high = bucket_floor(at, F.col("n"), F.col("b")), bucket_floor(at + F.col("sample_count") - 1, F.col("n"), F.col("b"))
    whole = (at >= 0) & (F.col("sample_start") + F.col("sample_count") <= F.col("start_sample") + F.col("n")) & (low == high)
    for c in ("first", "last", "minimum", "maximum"):
        whole &= ~F.isnan(c)
    held = held.withColumn("whole", F.coalesce(whole, F.lit(False)))
    ready = held.filter("whole").select(*keys, "req_id", low.alias("bucket"), F.col("sample_start").alias("at"), "first", "last", "minimum", "maximum")
    rest = held.filter(~F.col("whole")).select(*keys, "chunk_seq", "req_id", "start_sample", "n", "b")
    if "values" in samples.columns:
        opened = samples.select(*keys, "chunk_seq", "values").join(rest, [*keys, "chunk_seq"])
        raw = opened.select(*rest.columns, F.posexplode("values").alias("i", "value")).withColumn("sample_idx", F.col("chunk_seq") * chunk_size + F.col("i"))
    else:
        raw = samples.withColumn("chunk_seq", whole_quotient(F.col("sample_idx"), F.lit(chunk_size))).join(rest, [*keys, "chunk_seq"])
    raw = raw.filter((F.col("sample_idx") >= F.col("start_sample")) & (F.col("sample_idx") < F.col("start_sample") + F.col("n")))
    own = bucket_floor(F.col("sample_idx") - F.col("start_sample"), F.col("n"), F.col("b"))
    v = F.col("value")
    parts = ready.unionByName(raw.select(*keys, "req_id", own.alias("bucket"), F.col("sample_idx").alias("at"), v.alias("first"), v.alias("last"), v.alias("minimum"), v.alias("maximum")))
    return _all_buckets(parts.groupBy(*keys, "req_id", "bucket").agg(*merged("at")), cut, keys)


def lod_pyramid(chunks: DataFrame, levels: int, keys: tuple[str, ...] = KEYS, clean: bool = False) -> DataFrame:
    """Levels 0 to ``levels`` of chunk summaries, each merging pairs of the one below; (keys, level, seq, ...).

    ``clean``: with a column of that name, whether no chunk below has a NaN in
    its summary, so that merging loses nothing.
    """
    values = ["first", "last", "minimum", "maximum"]
    level = chunks.select(*keys, F.lit(0).alias("level"), F.col("chunk_seq").alias("seq"), "sample_start", "sample_count", *values)
    if clean:
        level = level.withColumn("clean", F.forall(F.array(*values), lambda x: ~F.isnan(x)))
    out = level
    for k in range(1, levels + 1):
        pair = whole_quotient(F.col("seq"), F.lit(2))
        all_ = [F.bool_and("clean").alias("clean")] if clean else []
        level = level.groupBy(*keys, pair.alias("seq")).agg(F.min("sample_start").alias("start"), F.sum("sample_count").alias("sample_count"), *merged("sample_start"), *all_).withColumnRenamed("start", "sample_start").withColumn("level", F.lit(k))
        out = out.unionByName(level)
    return out


def _bucket_begin(j: Column) -> Column:
    """The first of the positions 0 to n - 1 that ``bucket_floor`` has in bucket j or later; n for j = b."""
    n, b = F.col("n"), F.col("b")
    near = whole_quotient(j * n + b - 1, b)  # exact; the rule is in doubles, which can be one off
    at = lambda i: bucket_floor(i, n, b)
    return F.when(j >= b, n).when((near > 0) & (at(near - 1) >= j), near - 1).when((near < n) & (at(near) < j), near + 1).otherwise(near)


def bucket_covers(cut: DataFrame, chunk_size: int, levels: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, req_id, bucket, low, high, nodes) for clipped requests: each bucket's positions, and the nodes (level, seq) of a pyramid that make up its whole chunks.

    These are the segment tree's: at each level at most a node on either side,
    and at the last as many as are left.
    """
    j = F.col("bucket")
    ranges = cut.select(*keys, "req_id", "start_sample", "n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("bucket"))
    ranges = ranges.select(*keys, "req_id", "bucket", (F.col("start_sample") + _bucket_begin(j)).alias("low"), (F.col("start_sample") + _bucket_begin(j + 1)).alias("high")).filter("low < high")
    ranges = ranges.withColumns({"a": whole_quotient(F.col("low") + chunk_size - 1, F.lit(chunk_size)), "z": whole_quotient(F.col("high"), F.lit(chunk_size))})
    node = "named_struct('level', int(k), 'seq', {})"
    at = f"transform(sequence(0, {levels - 1}), k -> named_struct('k', k, 'l', shiftright(a + shiftleft(1L, k) - 1, k), 'r', shiftright(z, k)))" if levels else "array()"
    left = f"transform(filter({at}, x -> x.l < x.r AND x.l % 2 = 1), x -> named_struct('level', x.k, 'seq', x.l))"
    right = f"transform(filter({at}, x -> x.l < x.r AND x.r % 2 = 1), x -> named_struct('level', x.k, 'seq', x.r - 1))"
    l, r = f"shiftright(a + shiftleft(1L, {levels}) - 1, {levels})", f"shiftright(z, {levels})"  # noqa: E741
    top = f"CASE WHEN {l} < {r} THEN transform(sequence({l}, {r} - 1), s -> {node.format('s').replace('int(k)', str(levels))}) ELSE array() END"
    nodes = f"concat({left}, {right}, {top})" if levels else top
    return ranges.withColumn("nodes", F.expr(nodes)).withColumn("chunked", F.col("a") <= F.col("z"))


def envelope_from_pyramid(pyramid: DataFrame, stored: DataFrame, requests: DataFrame, totals: DataFrame, chunk_size: int, levels: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``channel_envelope`` by the floor rule from ``lod_pyramid(..., levels, clean=True)`` and stored chunks (chunk_seq, array ``values``).

    A bucket reads two nodes a level and the chunks at its two ends. Nodes over
    a summary with NaN give way to the two below them, down to single chunks,
    which then are opened.
    """
    cut = clip_requests(requests, totals, keys).withColumn("sample_count", F.col("n"))
    covers = materialise(bucket_covers(cut, chunk_size, levels, keys))
    values = ["first", "last", "minimum", "maximum"]
    ask = covers.select(*keys, "req_id", "bucket", F.explode("nodes").alias("node")).select(*keys, "req_id", "bucket", "node.level", "node.seq")
    ready, opened, k = [], [], levels
    while True:
        found = materialise(pyramid.join(ask, [*keys, "level", "seq"]).select(*keys, "req_id", "bucket", "level", "seq", F.col("sample_start").alias("at"), *values, "clean"))
        ready.append(found.filter("clean").select(*keys, "req_id", "bucket", "at", *values))
        low = F.col("seq") * chunk_size
        opened.append(found.filter("not clean and level = 0").select(*keys, "req_id", "bucket", F.col("seq").alias("chunk_seq"), low.alias("low"), (low + chunk_size).alias("high")))
        below = found.filter("not clean and level > 0")
        if k == 0 or below.isEmpty():
            break
        ask = below.select(*keys, "req_id", "bucket", (F.col("level") - 1).alias("level"), F.explode(F.array(F.col("seq") * 2, F.col("seq") * 2 + 1)).alias("seq"))
        k -= 1
    seq = lambda x: whole_quotient(x, F.lit(chunk_size))
    ends = covers.select(*keys, "req_id", "bucket", F.explode(F.when(F.col("chunked"), F.array(
        F.struct((F.col("a") - 1).alias("chunk_seq"), F.col("low"), (F.col("a") * chunk_size).alias("high")), F.struct(F.col("z").alias("chunk_seq"), (F.col("z") * chunk_size).alias("low"), F.col("high")),
    )).otherwise(F.array(F.struct(seq(F.col("low")).alias("chunk_seq"), F.col("low"), F.col("high"))))).alias("e"))
    opened.append(ends.select(*keys, "req_id", "bucket", "e.chunk_seq", "e.low", "e.high").filter("low < high"))
    asked = reduce(DataFrame.unionByName, opened)
    first = F.col("chunk_seq") * chunk_size
    part = F.slice("values", (F.col("low") - first + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    raw = stored.select(*keys, "chunk_seq", "values").join(asked, [*keys, "chunk_seq"]).select(*keys, "req_id", "bucket", "low", F.posexplode(part).alias("i", "value"))
    v = F.col("value")
    parts = reduce(DataFrame.unionByName, [*ready, raw.select(*keys, "req_id", "bucket", (F.col("low") + F.col("i")).alias("at"), *(v.alias(c) for c in values))])
    return _all_buckets(parts.groupBy(*keys, "req_id", "bucket").agg(*merged("at")), cut, keys)


def pick_lod(width: Column, factor: float = 1.35, most: int = 8192) -> Column:
    """Buckets to draw a width with: a power of two from 512 on that reaches width * factor."""
    target = F.least(F.greatest(width * factor, F.lit(512.0)), F.lit(float(most))).cast("int")
    power = F.lit(most)
    step = most // 2
    while step >= 512:
        power = F.when(target <= step, step).otherwise(power)
        step //= 2
    return power.cast("int")


def downsample_points(samples: DataFrame, width: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """At most ``width`` buckets of each whole series by the boundary rule, over its finite values; a bucket without any has NaN."""
    placed = with_positions(samples, list(keys), "sample_idx", total="n").withColumn("b", F.least(F.lit(width).cast("long"), F.col("n")))
    found = finite_only(placed).groupBy(*keys, _bucket(F.col("pos"), "boundary").alias("bucket")).agg(*extremes())
    grid = placed.groupBy(*keys).agg(F.max("b").alias("b")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("bucket"))
    return grid.join(found, [*keys, "bucket"], "left").select(*keys, "bucket", *(F.coalesce(c, F.lit(NAN)).alias(c) for c in ("first", "last", "minimum", "maximum")))


def downsample_envelopes(points: DataFrame, width: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same over envelope points (point_idx, first, last, minimum, maximum); points with a non-finite extreme are passed over."""
    placed = with_positions(points, list(keys), "point_idx", total="n").withColumn("b", F.least(F.lit(width).cast("long"), F.col("n")))
    good = placed.filter(is_finite(F.col("minimum")) & is_finite(F.col("maximum")))
    found = good.groupBy(*keys, _bucket(F.col("pos"), "boundary").alias("bucket")).agg(*merged("pos"))
    grid = placed.groupBy(*keys).agg(F.max("b").alias("b")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("bucket"))
    return grid.join(found, [*keys, "bucket"], "left").select(*keys, "bucket", *(F.coalesce(c, F.lit(NAN)).alias(c) for c in ("first", "last", "minimum", "maximum")))


def decimation(rate: Column, most: float) -> Column:
    """How many samples make one display point."""
    good = F.when(valid_rate(rate), rate).otherwise(F.lit(float(most)))
    return F.greatest(F.lit(1).cast("long"), F.bround(good / F.least(good, F.lit(float(most)))).cast("long"))


def decimate(samples: DataFrame, rates: DataFrame, most: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, point, first, last, minimum, maximum, display_rate): full count-based buckets of the finite values of each series."""
    sized = rates.withColumn("factor", decimation(F.col("sample_rate"), most))
    placed = with_positions(finite_only(samples), list(keys), "sample_idx").join(small(sized), list(keys))
    found = placed.groupBy(*keys, whole_quotient(F.col("pos"), F.col("factor")).alias("point"), "factor", "sample_rate").agg(F.count("*").alias("n"), *extremes())
    rate = F.when(valid_rate(F.col("sample_rate")), F.col("sample_rate")).otherwise(F.lit(float(most)))
    return found.filter(F.col("n") == F.col("factor")).select(*keys, "point", "first", "last", "minimum", "maximum", (rate / F.col("factor")).alias("display_rate"))


def latest_points(points: DataFrame, capacity: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The newest points of each series, with ``pos`` from the oldest of them.

    Where the newest begin is found from counts by spans of the index; only
    points from there on are ranked, the rest of a series is not shuffled.
    """
    spans = points.groupBy(*keys, F.floor(F.col("point_idx") / TAIL).alias("__span")).agg(F.count("*").alias("__n"))
    later = Window.partitionBy(*keys).orderBy(F.desc("__span")).rowsBetween(Window.unboundedPreceding, -1)
    needed = spans.withColumn("__later", F.coalesce(F.sum("__n").over(later), F.lit(0))).filter(F.col("__later") < capacity)
    begins = needed.groupBy(*keys).agg((F.min("__span") * TAIL).alias("__begin"))
    tail = points.join(small(begins), list(keys)).filter(F.col("point_idx") >= F.col("__begin")).drop("__begin")
    placed = with_positions(tail, list(keys), "point_idx", total="n")
    skip = F.greatest(F.lit(0).cast("long"), F.col("n") - capacity)
    return placed.filter(F.col("pos") >= skip).withColumn("pos", F.col("pos") - skip).drop("n")


def default_capacity(points_per_second: int, seconds: int) -> int:
    return max(1000, points_per_second * seconds)


def live_window(points: DataFrame, rates: DataFrame, seconds: float, width: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The newest points of all series over the time that they show, downsampled to ``width``."""
    rate = F.when(valid_rate(F.col("display_rate")), F.col("display_rate")).otherwise(1.0)
    counted = points.groupBy(*keys).agg(F.count("*").alias("n")).join(rates.select(*keys, rate.alias("rate")), list(keys))
    longest = counted.agg(F.max(F.col("n") / F.col("rate"))).first()[0] or 0.0
    visible = min(max(longest if longest > 0 else seconds, 0.001), max(0.001, seconds))
    shown = counted.select(*keys, F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(visible) * F.col("rate"))).alias("shown"))
    placed = with_positions(points, list(keys), "point_idx", total="n").join(small(shown), list(keys))
    return downsample_envelopes(placed.filter(F.col("pos") >= F.col("n") - F.col("shown")).drop("pos", "n", "shown"), width, keys)


def filled_slices(samples: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = KEYS, slice_samples: int = 1 << 20, piece: int = 1 << 12) -> DataFrame:
    """(keys, slice, low, cells): the ranges (keys, start_sample, sample_count) in pieces of at most ``piece`` positions, each with its cells (i, value) in order, 0 where there is no sample, and no piece of a slice without samples.

    Samples are gathered by piece, in one shuffle; ranges of a series must not overlap.
    """
    cuts = lambda low, end, step: F.explode(F.sequence(low, end - 1, F.lit(step).cast("long")))
    end = F.col("start_sample") + F.col("sample_count")
    slices = ranges.filter("sample_count > 0").select(*keys, cuts(F.col("start_sample"), end, slice_samples).alias("slice"), F.col("start_sample").alias("__from"), end.alias("__end"))
    pieces = slices.select(*keys, "slice", "__from", "__end", cuts(F.col("slice"), F.least(F.col("slice") + slice_samples, "__end"), piece).alias("low"))
    pieces = pieces.withColumn("size", (F.least(F.col("slice") + slice_samples, F.col("__end"), F.col("low") + piece) - F.col("low")).cast("int"))
    asked = small(ranges.filter("sample_count > 0").select(*keys, F.col("start_sample").alias("__from"), end.alias("__end")))
    at = F.col("sample_idx")
    inside = samples.select(*keys, "sample_idx", "value").join(asked, list(keys)).filter((at >= F.col("__from")) & (at < F.col("__end")))
    own_slice = at - (at - F.col("__from")) % slice_samples
    placed = inside.withColumn("slice", own_slice).withColumn("low", at - (at - F.col("slice")) % piece)
    cell = lambda i, v: F.struct(i.cast("int").alias("i"), v.alias("value"))
    held = placed.groupBy(*keys, "slice", "low").agg(F.collect_list(cell(at - F.col("low"), F.coalesce("value", F.lit(0.0)))).alias("held"), F.count("value").alias("n"))  # of a piece
    some = held.groupBy(*keys, "slice").agg(F.sum("n").alias("n")).filter("n > 0").select(*keys, "slice")
    whole = pieces.join(some, [*keys, "slice"], "left_semi").join(held, [*keys, "slice", "low"], "left")
    there = F.coalesce("held", F.array().cast("array<struct<i:int,value:double>>"))
    gaps = F.array_except(F.sequence(F.lit(0), F.col("size") - 1), F.transform(there, lambda c: c["i"]))
    return whole.select(*keys, "slice", "low", F.array_sort(F.concat(there, F.transform(gaps, lambda i: cell(i, F.lit(0.0))))).alias("cells"))


def fill_gaps(samples: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = KEYS, slice_samples: int = 1 << 20) -> DataFrame:
    """Every position of the ranges (keys, start_sample, sample_count), with 0 where there is no sample; slices without any give no rows."""
    pieces = filled_slices(samples, ranges, keys, slice_samples)
    return pieces.select(*keys, "low", F.inline("cells")).select(*keys, (F.col("low") + F.col("i")).cast("long").alias("sample_idx"), "value")


def stitch_segments(samples: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Samples (segment, local_idx) with ``sample_idx``, their position in the run: after all samples of the channel's earlier segments."""
    counts = samples.groupBy(*keys, "segment").agg((F.max("local_idx") + 1).alias("n"))
    before = Window.partitionBy(*keys).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return samples.join(small(offsets), [*keys, "segment"]).withColumn("sample_idx", (F.col("local_idx") + F.col("offset")).cast("long")).drop("offset")


def visible_samples(samples: DataFrame, selections: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Samples of channels that some view selects."""
    return samples.join(small(selections.select(*keys).distinct()), list(keys), "left_semi")


def view_to_sample_range(requests: DataFrame, channels: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, view_id, start_sample, sample_count) from views in seconds (view_id, start_s, window_s) and channels (keys, n, sample_rate).

    A window that is not positive is the longest duration; windows and starts
    are kept within it, and seconds round to samples, halves up.
    """
    longest = channels.agg(F.max(F.when(valid_rate(F.col("sample_rate")), F.col("n") / F.col("sample_rate")))).first()[0] or 0.0
    full = max(0.001, longest)
    window = F.least(F.greatest(F.when(F.col("window_s") <= 0, F.lit(full)).otherwise(F.col("window_s")), F.lit(1e-6)), F.lit(full))
    views = requests.withColumn("w", window).withColumn("s", F.least(F.greatest(F.col("start_s"), F.lit(0.0)), F.greatest(F.lit(0.0), F.lit(full) - F.col("w"))))
    to = lambda x: F.when((x <= 0) | (F.col("sample_rate") <= 0), F.lit(0)).otherwise(F.round(x * F.col("sample_rate"))).cast("long")
    return each_with_all(channels, views).select(*keys, "view_id", to(F.col("s")).alias("start_sample"), to(F.col("w")).alias("sample_count"))


def probe_at(envelope: DataFrame, times: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The bucket of each time (keys, req_id, frac: 0 to 1 of the range), and the fraction at its middle."""
    sizes = envelope.groupBy(*keys, "req_id").agg(F.count("*").alias("buckets"))
    placed = times.join(sizes, [*keys, "req_id"]).withColumn("bucket", F.greatest(F.lit(0).cast("long"), F.least(F.col("buckets") - 1, (F.col("frac") * F.col("buckets")).cast("long"))))
    return placed.join(envelope, [*keys, "req_id", "bucket"]).withColumn("middle", (F.col("bucket") + 0.5) / F.col("buckets")).drop("buckets")
