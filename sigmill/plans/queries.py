"""The operators applied to the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigmill.functions import scalars as sc
from sigmill.operators import audit, blocks, catalog, codec_matrix, envelope, reports
from sigmill.plans import segment_files, sql_access
from sigmill.plans.fixtures import VIEWS, sql, view
from sigmill.plans.shared import materialise, once, scratch, shared_dir
from sigmill.sinks import tables
from sigmill.sources import logs, segments
from sigmill.streaming import recording, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS = ["device_id", "channel"]
#: Samples of a chunk, positions of a bin of the stored recording, levels of its pyramid above the chunks.
CHUNK, BIN, LEVELS = 64, 1024, 10


class Views:
    """The views of one folder of tables, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that a recording has beside its samples, made of these once."""
        return once(self.spark, f"{self.sf_dir}/events.parquet", name, lambda: materialise(make()))

    @property
    def recording(self) -> DataFrame:
        """The samples partitioned by device and bins of ``BIN`` positions."""
        return once(self.spark, f"{self.sf_dir}/events.parquet", "recording", lambda: tables.write_samples(self.samples, scratch(self.spark, "recording"), BIN))

    @property
    def chunk_values(self) -> DataFrame:
        """The recording's chunks of ``CHUNK`` samples as arrays."""
        whole = self.samples.groupBy(*KEYS, F.floor(F.col("sample_idx") / CHUNK).alias("chunk_seq")).agg(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("all"))
        return self.stored("chunk_values", lambda: whole.select(*KEYS, "chunk_seq", F.transform("all", lambda s: s["value"]).alias("values")))

    @property
    def chunk_summaries(self) -> DataFrame:
        return self.stored("chunk_summaries", lambda: envelope.chunk_summary(self.samples, CHUNK))

    @property
    def pyramid(self) -> DataFrame:
        return self.stored("pyramid", lambda: envelope.lod_pyramid(self.chunk_summaries, LEVELS, clean=True))

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, self.made)


def query(name: str, oracle: str = "", *views: str):
    """Registers a function of the views under ``name``; ``oracle`` is DuckDB SQL over the named views."""

    def add(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if oracle:
            ORACLES[name] = sql(oracle, *views)
        return fn

    return add


# Blocks

#: CRC32 in SQL: the table of 256 remainders from the polynomial, then a fold over the bytes.
CRC_TABLE = "t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)))"
CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])), 4294967295)"
#: The bits of a float from its exponent and its fraction, and the little-endian bytes of a block's floats.
FLOATS = """e AS (SELECT block_index, list_transform(payload, lambda x: CAST(abs(x) AS DOUBLE)) AS size, list_transform(payload, lambda x: x < 0) AS low FROM blocks),
p AS (SELECT *, list_transform(size, lambda a: CASE WHEN a = 0 THEN 0 ELSE CAST(floor(log2(a)) AS BIGINT) END) AS guess FROM e),
q AS (SELECT *, list_transform(range(1, len(size) + 1), lambda i: guess[i] + CASE WHEN size[i] >= pow(2.0, guess[i] + 1) THEN 1 WHEN size[i] > 0 AND size[i] < pow(2.0, guess[i]) THEN -1 ELSE 0 END) AS power FROM p),
w AS (SELECT block_index, list_transform(range(1, len(size) + 1), lambda i: CASE WHEN low[i] THEN 2147483648 ELSE 0 END + CASE WHEN size[i] = 0 THEN 0 ELSE (power[i] + 127) * 8388608 + CAST((size[i] / pow(2.0, power[i]) - 1) * 8388608 AS BIGINT) END) AS words FROM q),
b AS (SELECT block_index, flatten(list_transform(words, lambda x: [x & 255, (x >> 8) & 255, (x >> 16) & 255, (x >> 24) & 255])) AS bytes FROM w)"""

COUNTED = "SELECT b.*, CAST({c} AS INT) AS channel_count FROM {b} b LEFT JOIN n g ON g.device_id = b.group_id LEFT JOIN n m ON m.device_id = b.machine_id"
PER = "WITH n AS (SELECT device_id, count(*) AS n FROM channels GROUP BY 1),\n"
COUNT_RULE = "CASE WHEN data_count_per_channel > 0 AND buffer_count > 0 AND buffer_count % (4 * data_count_per_channel) = 0 THEN buffer_count // (4 * data_count_per_channel) ELSE greatest(1, coalesce(g.n, m.n, 1)) END"
GLOBAL_RULE = "(message_type = 21 OR group_id < 0 OR machine_id < 0 OR channel_count = (SELECT count(*) FROM channels))"
ROUTED = PER + f"""counted AS ({COUNTED.format(c=COUNT_RULE, b="blocks")}),
flagged AS (SELECT *, {GLOBAL_RULE} AS is_global FROM counted),
fed AS (SELECT f.*, c.device_id, c.channel_id, c.data_index, c.local_data_index FROM flagged f JOIN channels c ON NOT f.is_global AND c.device_id = coalesce((SELECT device_id FROM n WHERE device_id = f.group_id), (SELECT device_id FROM n WHERE device_id = f.machine_id))
        UNION ALL SELECT f.*, c.device_id, c.channel_id, c.data_index, c.local_data_index FROM flagged f JOIN channels c ON f.is_global),
routed AS (SELECT * FROM (SELECT *, CAST(CASE WHEN NOT is_global AND layout = 'ChannelContiguousFloat32' THEN local_data_index ELSE data_index END AS INT) AS position FROM fed) WHERE position >= 0 AND position < channel_count)
"""
HEAD = ["block_index", "group_id", "machine_id", "message_type", "total_data_count", "data_count_per_channel", "buffer_count"]


def _counted(v: Views, odd: bool = False) -> DataFrame:
    return blocks.infer_channel_count(v.odd_blocks if odd else v.blocks, v.channels)


def _routed(v: Views) -> DataFrame:
    return blocks.block_channels(blocks.classify_blocks(_counted(v), v.channels), v.channels)


@query("p1_valid_blocks", "SELECT block_index, group_id, buffer_count, data_count_per_channel FROM odd_blocks WHERE buffer_count > 0 AND payload IS NOT NULL AND data_count_per_channel > 0", "odd_blocks")
def _(v):
    return blocks.valid_blocks(v.odd_blocks).select("block_index", "group_id", "buffer_count", "data_count_per_channel")


@query("p2_infer_channel_count", PER + f"r AS ({COUNTED.format(c=COUNT_RULE, b='odd_blocks')}) SELECT block_index, channel_count FROM r", "odd_blocks", "channels")
def _(v):
    return _counted(v, True).select("block_index", "channel_count")


@query("p3_classify_blocks", PER + f"r AS ({COUNTED.format(c=COUNT_RULE, b='odd_blocks')}) SELECT block_index, {GLOBAL_RULE} AS is_global FROM r", "odd_blocks", "channels")
def _(v):
    return blocks.classify_blocks(_counted(v, True), v.channels).select("block_index", "is_global")


@query("p2_infer_channel_count_multi", PER + f"r AS ({COUNTED.format(c=COUNT_RULE.replace('greatest(1, coalesce(g.n, m.n, 1))', '(SELECT count(*) FROM channels)'), b='odd_blocks')}) SELECT block_index, channel_count FROM r", "odd_blocks", "channels")
def _(v):
    return blocks.infer_channel_count(v.odd_blocks, v.channels, True).select("block_index", "channel_count")


@query("p3_classify_blocks_audit", "SELECT block_index, message_type = 21 OR group_id < 0 OR machine_id < 0 AS is_global FROM odd_blocks", "odd_blocks")
def _(v):
    return blocks.classify_blocks(_counted(v, True), v.channels, True).select("block_index", "is_global")


@query("p4_resolve_data_index", ROUTED + "SELECT block_index, device_id, channel_id, position FROM routed", "blocks", "channels")
def _(v):
    return _routed(v).select("block_index", "device_id", "channel_id", "position")


DEINTERLEAVED = """WITH flat AS (SELECT block_index, layout, unnest(payload) AS value, generate_subscripts(payload, 1) - 1 AS p FROM blocks)
SELECT block_index, CAST(CASE WHEN layout = 'SampleInterleavedFloat32' THEN p % 4 ELSE p // 16 END AS INT) AS channel_pos, CAST(CASE WHEN layout = 'SampleInterleavedFloat32' THEN p // 4 ELSE p % 16 END AS INT) AS i, value FROM flat"""


@query("p5_deinterleave", DEINTERLEAVED, "blocks")
def _(v):
    return blocks.deinterleave(_counted(v))


@query("p5_channel_arrays", """WITH c AS (SELECT unnest([0, 1, 2, 3]) AS channel_pos)
SELECT block_index, CAST(channel_pos AS INT) AS channel_pos, CASE WHEN layout = 'SampleInterleavedFloat32' THEN list_transform(range(0, 16), lambda i: payload[i * 4 + channel_pos + 1]) ELSE payload[channel_pos * 16 + 1 : channel_pos * 16 + 16] END AS values FROM blocks, c""", "blocks")
def _(v):
    return blocks.channel_arrays(_counted(v))


@query("p6_interleave", "SELECT block_index, payload FROM blocks", "blocks")
def _(v):
    counted = _counted(v)
    return blocks.interleave(blocks.deinterleave(counted), counted)


@query("p7_finite_only", "SELECT device_id, channel, sample_idx, value FROM noisy WHERE isfinite(value)", "noisy")
def _(v):
    return envelope.finite_only(v.noisy)


VIEW_ROWS = [(0, 0.0, 0.0), (1, 0.05, 0.3), (2, 5.0, 0.1), (3, -1.0, 1e-9), (4, 0.0125, 100.0)]
VIEW_VALUES = ", ".join(f"({a}, CAST({b} AS DOUBLE), CAST({c!r} AS DOUBLE))" for a, b, c in VIEW_ROWS)


@query("p8_view_to_sample_range", f"""WITH info AS (SELECT *, CAST(1000 + 100 * device_id AS DOUBLE) AS sample_rate FROM totals),
d AS (SELECT greatest(0.001, max(n / sample_rate)) AS d FROM info),
w AS (SELECT view_id, start_s, least(greatest(CASE WHEN window_s <= 0 THEN d ELSE window_s END, 1e-6), d) AS w, d FROM (VALUES {VIEW_VALUES}) AS v(view_id, start_s, window_s), d),
s AS (SELECT view_id, w, least(greatest(start_s, 0.0), greatest(0.0, d - w)) AS s FROM w)
SELECT device_id, channel, view_id, CAST(round(s * sample_rate) AS BIGINT) AS start_sample, CAST(round(w * sample_rate) AS BIGINT) AS sample_count FROM info, s""", "totals")
def _(v):
    views = v.spark.sql(f"SELECT * FROM VALUES {VIEW_VALUES} AS v(view_id, start_s, window_s)")
    return envelope.view_to_sample_range(views, v.totals.withColumn("sample_rate", (1000 + 100 * F.col("device_id")).cast("double")))


@query("p9_slice_range", "SELECT s.device_id, s.channel, r.req_id, s.sample_idx, s.value FROM samples s JOIN requests r ON s.device_id = r.device_id AND s.channel = r.channel AND s.sample_idx >= r.start_sample AND s.sample_idx < r.start_sample + r.sample_count", "samples", "requests")
def _(v):
    return envelope.slice_range(v.recording, v.requests, width=BIN).select(*KEYS, "req_id", "sample_idx", "value")


META = """SELECT device_id AS source_device, channel_id AS source_channel, CASE WHEN device_id % 2 = 0 THEN 'Device_000' || CAST(device_id % 9 + 1 AS VARCHAR(3)) || '_10_0_0_1' ELSE 'Other' END AS group_name, name AS channel_name,
CASE channel_id WHEN 0 THEN 'deviceid=' || CAST(device_id AS VARCHAR(3)) || '; ChannelId=7; SampleRate=1250.5' WHEN 1 THEN 'SampleRate=-4;x=1' WHEN 2 THEN 'DeviceId=x; SAMPLERATE= 10 ' ELSE '' END AS description FROM {channels}"""


@query("p10_parse_channel_metadata", f"""WITH m AS ({META.format(channels="channels")})
SELECT source_device, source_channel, coalesce(TRY_CAST(nullif(regexp_extract(description, '(?i)DeviceId=([^;]*)', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(group_name, 'Device_([0-9]+)', 1), '') AS INT) - 1, 0) AS device_id,
coalesce(TRY_CAST(nullif(trim(regexp_extract(description, '(?i)ChannelId=([^;]*)', 1)), '') AS INT), TRY_CAST(nullif(regexp_extract(channel_name, '(?i)^AI([0-9]+)$', 1), '') AS INT) - 1, 0) AS channel_id,
CASE WHEN TRY_CAST(trim(regexp_extract(description, '(?i)SampleRate=([^;]*)', 1)) AS DOUBLE) > 0 THEN TRY_CAST(trim(regexp_extract(description, '(?i)SampleRate=([^;]*)', 1)) AS DOUBLE) ELSE 0.0 END AS sample_rate FROM m""", "channels")
def _(v):
    return catalog.parse_channel_metadata(v.spark.sql(META, channels=v.channels)).select("source_device", "source_channel", "device_id", "channel_id", "sample_rate")


@query("p11_normalize_records", """SELECT device_id, channel, record_seq, flags & 1 <> 0 AS stored, flags & 2 <> 0 AS preprocessed, flags & 4 <> 0 AS raw_stored,
CASE WHEN version < 3 AND flags & 4 <> 0 THEN 'None' WHEN version < 3 THEN 'Lz4' ELSE codec END AS codec, CASE WHEN version < 3 AND flags & 4 <> 0 THEN 'None' WHEN version < 3 THEN 'Lpc' ELSE preprocessor END AS preprocessor FROM records""", "records")
def _(v):
    rows = v.records.withColumns({"manifest_codec": F.lit("Lz4"), "manifest_preprocessor": F.lit("Lpc")})
    return catalog.normalize_records(rows).select(*KEYS, "record_seq", "stored", "preprocessed", "raw_stored", "codec", "preprocessor")


@query("p12_active_devices", "SELECT device_id, ip_address FROM devices WHERE online QUALIFY row_number() OVER (PARTITION BY lower(ip_address) ORDER BY device_id) = 1 ORDER BY device_id LIMIT 20", "devices")
def _(v):
    return catalog.active_devices(v.devices, 20).select("device_id", "ip_address")


ODD_CHANNELS = "SELECT device_id, channel_id, CAST(CASE WHEN device_id % 3 = 0 THEN channel_id + 1 ELSE local_data_index END AS INT) AS local_data_index, CAST(device_id * 4 + channel_id + {shift} AS INT) AS data_index FROM {channels}"


def _normalized(shift: int) -> str:
    return f"""WITH c AS ({ODD_CHANNELS.format(shift=shift, channels="channels")}),
l AS (SELECT *, CASE WHEN min(local_data_index) OVER d >= 0 AND max(local_data_index) OVER d < count(*) OVER d AND len(list_distinct(list(local_data_index) OVER d)) = count(*) OVER d THEN local_data_index
      ELSE CAST(row_number() OVER (PARTITION BY device_id ORDER BY channel_id) - 1 AS INT) END AS fixed FROM c WINDOW d AS (PARTITION BY device_id)),
g AS (SELECT count(*) = count(DISTINCT data_index) AND min(data_index) >= 0 AND max(data_index) < count(*) AS ok FROM c)
SELECT device_id, channel_id, fixed AS local_data_index, """


@query("p13_normalize_data_index", _normalized(1) + "fixed AS data_index FROM l", "channels")
def _(v):
    return catalog.normalize_data_index(v.spark.sql(ODD_CHANNELS.replace("{shift}", "1"), channels=v.channels)).select("device_id", "channel_id", "local_data_index", "data_index")


@query("p13_normalize_data_index_multi", _normalized(1) + "CASE WHEN ok THEN data_index ELSE CAST(row_number() OVER (ORDER BY device_id, channel_id) - 1 AS INT) END AS data_index FROM l, g", "channels")
def _(v):
    return catalog.normalize_data_index(v.spark.sql(ODD_CHANNELS.replace("{shift}", "1"), channels=v.channels), True).select("device_id", "channel_id", "local_data_index", "data_index")


@query("p14_resolve_sample_rate", """WITH c AS (SELECT device_id, CASE WHEN device_id % 4 = 0 THEN -1.0 ELSE device_id * 10.0 END AS config_rate FROM devices WHERE device_id % 3 = 0)
SELECT d.device_id, CAST(coalesce(CASE WHEN config_rate > 0 THEN config_rate END, CASE WHEN sample_rate > 0 AND isfinite(sample_rate) THEN sample_rate END, 1.0) AS DOUBLE) AS resolved_rate FROM devices d LEFT JOIN c ON c.device_id = d.device_id""", "devices")
def _(v):
    config = v.devices.filter("device_id % 3 = 0").select("device_id", F.when(F.col("device_id") % 4 == 0, F.lit(-1.0)).otherwise(F.col("device_id") * 10.0).alias("config_rate"))
    return catalog.resolve_sample_rate(v.devices, config).select("device_id", "resolved_rate")


# Joins


@query("j1_block_device", "WITH d AS (SELECT DISTINCT device_id FROM channels) SELECT block_index, coalesce(g.device_id, m.device_id) AS device_id FROM odd_blocks b LEFT JOIN d g ON g.device_id = b.group_id LEFT JOIN d m ON m.device_id = b.machine_id WHERE coalesce(g.device_id, m.device_id) IS NOT NULL", "odd_blocks", "channels")
def _(v):
    return blocks.block_device(v.odd_blocks, v.channels).select("block_index", "device_id")


@query("j2_block_channels", ROUTED + "SELECT device_id, channel_id, count(*) AS blocks, CAST(sum(CASE WHEN is_global THEN 1 ELSE 0 END) AS BIGINT) AS global_blocks, min(block_index) AS first_block, max(block_index) AS last_block FROM routed GROUP BY 1, 2", "blocks", "channels")
def _(v):
    return _routed(v).groupBy("device_id", "channel_id").agg(F.count("*").alias("blocks"), F.sum(F.col("is_global").cast("int")).alias("global_blocks"), F.min("block_index").alias("first_block"), F.max("block_index").alias("last_block"))


ORDINALS = "SELECT CAST(segment AS INT) AS segment, device_id, channel, CAST(dense_rank() OVER (ORDER BY device_id, channel) - 1 AS INT) AS channel_ordinal FROM (SELECT DISTINCT s.segment, t.device_id, t.channel FROM {totals} t CROSS JOIN (VALUES (0), (1), (2)) AS s(segment))"


def _ordinals(v: Views) -> tuple[DataFrame, DataFrame]:
    table = v.spark.sql(ORDINALS, totals=v.totals)
    return v.records.join(table, ["segment", *KEYS]).select("segment", "channel_ordinal", "record_seq"), table.filter("channel_ordinal % 4 <> 3")


JOINED = f"WITH o AS ({ORDINALS.format(totals='totals')}), r AS (SELECT segment, channel_ordinal, record_seq FROM records JOIN o USING (segment, device_id, channel)), c AS (SELECT * FROM o WHERE channel_ordinal % 4 <> 3)\n"


@query("j3_record_channels", JOINED + "SELECT segment, channel_ordinal, record_seq, device_id, channel FROM r JOIN c USING (segment, channel_ordinal)", "records", "totals")
def _(v):
    return catalog.record_channels(*_ordinals(v))


@query("j3_orphan_records", JOINED + "SELECT * FROM r WHERE channel_ordinal % 4 = 3", "records", "totals")
def _(v):
    return catalog.orphan_records(*_ordinals(v))


@query("j4_visible_samples", "SELECT device_id, channel, sample_idx, value FROM samples s WHERE EXISTS (SELECT 1 FROM selections v WHERE v.device_id = s.device_id AND v.channel = s.channel)", "samples", "selections")
def _(v):
    return envelope.visible_samples(v.samples, v.selections).select(*KEYS, "sample_idx", "value")


@query("j5_overlap_records", "SELECT r.device_id, r.channel, r.req_id, c.chunk_seq FROM requests r JOIN chunks c ON c.device_id = r.device_id AND c.channel = r.channel AND c.sample_start + c.sample_count > r.start_sample AND c.sample_start < r.start_sample + r.sample_count", "requests", "chunks")
def _(v):
    return envelope.overlap_records(v.requests, v.chunks, 256).select(*KEYS, "req_id", "chunk_seq")


SEGMENTED = "SELECT device_id, channel, seg_id AS segment, CAST(row_number() OVER (PARTITION BY device_id, channel, seg_id ORDER BY sample_idx) - 1 AS BIGINT) AS local_idx, value, sample_idx AS whole_idx FROM {samples} WHERE NOT (device_id = 1 AND seg_id = 12)"


@query("j6_stitch_segments", f"""WITH s AS ({SEGMENTED.format(samples="samples")}), n AS (SELECT device_id, channel, segment, max(local_idx) + 1 AS n FROM s GROUP BY 1, 2, 3),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY device_id, channel ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM n)
SELECT device_id, channel, segment, local_idx, CAST(local_idx + o AS BIGINT) AS sample_idx, value FROM s JOIN o USING (device_id, channel, segment)""", "samples")
def _(v):
    return envelope.stitch_segments(v.spark.sql(SEGMENTED, samples=v.samples)).select(*KEYS, "segment", "local_idx", "sample_idx", "value")


#: Each series is the one channel of a group.
STORED = "SELECT g.group_id AS device_id, 0 AS position, s.sample_idx, s.value FROM {samples} s JOIN {groups} g ON g.device_id = s.device_id AND g.channel = s.channel"
LOCAL = f"WITH stored AS ({STORED.format(samples='samples', groups='groups')}), placed AS (SELECT *, total_data_count - min(total_data_count) OVER (PARTITION BY group_id) AS local_start FROM audit)\n"


@query("j7_audit_block_samples", LOCAL + "SELECT block_index, group_id, sample_idx, value FROM placed JOIN stored ON device_id = group_id AND sample_idx >= local_start AND sample_idx < local_start + data_count_per_channel", "audit", "samples", "groups")
def _(v):
    return audit.audit_block_samples(audit.local_starts(v.audit), v.spark.sql(STORED, samples=v.samples, groups=v.groups)).select("block_index", "group_id", "sample_idx", "value")


@query("j7_audit_missing_groups", LOCAL + "SELECT block_index, group_id, 'group is missing' AS reason FROM audit WHERE group_id NOT IN (SELECT device_id FROM stored)", "audit", "samples", "groups")
def _(v):
    return audit.audit_missing_groups(v.audit, v.spark.sql(STORED, samples=v.samples, groups=v.groups)).select("block_index", "group_id", "reason")


WANTED = "SELECT CAST(row_number() OVER (ORDER BY channel DESC, device_id) AS INT) AS pos, device_id, channel FROM {totals}"
LATEST = "SELECT device_id, channel, max(point_idx) AS newest, CASE WHEN device_id = 0 THEN CAST(NULL AS DOUBLE) ELSE 250.0 END AS display_rate, 1000.0 AS sample_rate FROM {points} WHERE channel <> 'click' GROUP BY device_id, channel"


@query("j8_snapshot_series", f"SELECT pos, w.device_id, w.channel, newest, CAST(coalesce(display_rate, sample_rate) AS DOUBLE) AS display_rate FROM ({WANTED.format(totals='totals')}) w JOIN ({LATEST.format(points='points')}) l ON l.device_id = w.device_id AND l.channel = w.channel", "totals", "points")
def _(v):
    latest = v.spark.sql(LATEST, points=v.points).withColumns({c: F.col(c).cast("double") for c in ("display_rate", "sample_rate")})
    return catalog.snapshot_series(latest, v.spark.sql(WANTED, totals=v.totals), KEYS).select("pos", *KEYS, "newest", "display_rate")


UPDATES = "SELECT g.group_id AS device_id, s.sample_idx AS reported, CASE WHEN s.sample_idx % 5 = 0 THEN -1.0 ELSE s.value END AS rate FROM {samples} s JOIN {groups} g ON g.device_id = s.device_id AND g.channel = s.channel"
OPENED = "SELECT g.group_id AS device_id, CAST(c.chunk_seq AS INT) AS segment, c.sample_start AS opened, CAST(1000 AS DOUBLE) AS base_rate FROM {chunks} c JOIN {groups} g ON g.device_id = c.device_id AND g.channel = c.channel"


@query("j9_segment_rates", f"""WITH u AS ({UPDATES.format(samples="samples", groups="groups")}), s AS ({OPENED.format(chunks="chunks", groups="groups")}),
l AS (SELECT s.device_id, s.segment, max_by(u.rate, u.reported) AS rate FROM s JOIN u ON u.device_id = s.device_id AND u.reported <= s.opened AND u.rate > 0 AND isfinite(u.rate) GROUP BY 1, 2)
SELECT s.device_id, s.segment, s.opened, coalesce(l.rate, s.base_rate) AS sample_rate FROM s LEFT JOIN l ON l.device_id = s.device_id AND l.segment = s.segment""", "samples", "chunks", "groups")
def _(v):
    return catalog.segment_rates(v.spark.sql(OPENED, chunks=v.chunks, groups=v.groups), v.spark.sql(UPDATES, samples=v.samples, groups=v.groups).withColumn("rate", F.col("rate").cast("double")))


# Aggregations

STORED_RULE = "min_by(value, sample_idx) AS first, max_by(value, sample_idx) AS last, CASE WHEN isnan(min_by(value, sample_idx)) THEN CAST('NaN' AS DOUBLE) ELSE min(CASE WHEN NOT isnan(value) THEN value END) END AS minimum, CASE WHEN isnan(min_by(value, sample_idx)) THEN CAST('NaN' AS DOUBLE) ELSE max(CASE WHEN NOT isnan(value) THEN value END) END AS maximum"


@query("a1_chunk_summary", f"SELECT device_id, channel, sample_idx // 50 AS chunk_seq, min(sample_idx) AS sample_start, count(*) AS sample_count, {STORED_RULE} FROM noisy GROUP BY 1, 2, 3", "noisy")
def _(v):
    return envelope.chunk_summary(v.noisy, 50)


def _envelope_sql(source: str, bucket: str, where: str = "TRUE") -> str:
    return f"""WITH cut AS (SELECT r.device_id, r.channel, req_id, start_sample, least(sample_count, n - start_sample) AS n, buckets FROM requests r JOIN totals t ON t.device_id = r.device_id AND t.channel = r.channel WHERE least(sample_count, n - start_sample) > 0),
asked AS (SELECT *, least(greatest(1, buckets), n) AS b FROM cut),
found AS (SELECT s.device_id, s.channel, req_id, {bucket} AS bucket, {STORED_RULE} FROM {source} s JOIN asked a ON s.device_id = a.device_id AND s.channel = a.channel AND sample_idx >= start_sample AND sample_idx < start_sample + n WHERE {where} GROUP BY 1, 2, 3, 4),
grid AS (SELECT device_id, channel, req_id, unnest(range(0, b)) AS bucket FROM asked)
SELECT g.device_id, g.channel, g.req_id, g.bucket, coalesce(first, 0.0) AS first, coalesce(last, 0.0) AS last, coalesce(minimum, 0.0) AS minimum, coalesce(maximum, 0.0) AS maximum FROM grid g LEFT JOIN found f ON f.device_id = g.device_id AND f.channel = g.channel AND f.req_id = g.req_id AND f.bucket = g.bucket"""


FLOOR = "greatest(0, least(b - 1, CAST(trunc(CAST(sample_idx - start_sample AS DOUBLE) / n * b) AS BIGINT)))"
BOUNDARY = "((sample_idx - start_sample + 1) * b - 1) // n"


@query("a2_channel_envelope", _envelope_sql("samples", FLOOR), "samples", "requests", "totals")
def _(v):
    return envelope.channel_envelope(v.recording, v.requests, v.totals, width=BIN)


@query("a2_envelope_boundary_rule", _envelope_sql("noisy", BOUNDARY, "isfinite(value)"), "noisy", "requests", "totals")
def _(v):
    return envelope.channel_envelope(v.noisy, v.requests, v.totals, "boundary", "drop")


@query("a2_envelope_with_nan", _envelope_sql("noisy", FLOOR), "noisy", "requests", "totals")
def _(v):
    return envelope.channel_envelope(v.noisy, v.requests, v.totals)


@query("a3_envelope_from_summaries", _envelope_sql("samples", FLOOR), "samples", "requests", "totals")
def _(v):
    return envelope.envelope_from_summaries(v.chunk_summaries, v.chunk_values, v.requests, v.totals, CHUNK)


@query("a4_envelope_from_pyramid", _envelope_sql("samples", FLOOR), "samples", "requests", "totals")
def _(v):
    return envelope.envelope_from_pyramid(v.pyramid, v.chunk_values, v.requests, v.totals, CHUNK, LEVELS)


@query("a4_lod_pyramid", " UNION ALL ".join(f"SELECT device_id, channel, CAST({k} AS INT) AS level, chunk_seq // {1 << k} AS seq, min(sample_start) AS sample_start, CAST(sum(sample_count) AS BIGINT) AS sample_count, min_by(first, sample_start) AS first, max_by(last, sample_start) AS last, min(minimum) AS minimum, max(maximum) AS maximum FROM chunks GROUP BY 1, 2, 3, 4" for k in range(4)), "chunks")
def _(v):
    return envelope.lod_pyramid(v.chunks, 3)


@query("a4_pick_lod", """WITH t AS (SELECT p_partkey, CAST(p_partkey * 7 % 9000 AS DOUBLE) AS width FROM part)
SELECT p_partkey, CAST(least(8192, 2 ** greatest(9, ceil(log2(trunc(least(greatest(width * 1.35, 512), 8192)))))) AS INT) AS buckets, CAST(least(4096, 2 ** greatest(9, ceil(log2(trunc(least(greatest(width * 1.2, 512), 4096)))))) AS INT) AS overview FROM t""")
def _(v):
    width = (F.col("p_partkey") * 7 % 9000).cast("double")
    return v.part.select("p_partkey", envelope.pick_lod(width).alias("buckets"), envelope.pick_lod(width, 1.2, 4096).alias("overview"))


STATS_CHANNELS = "SELECT device_id, channel, 1000.0 AS sample_rate FROM {totals} UNION ALL SELECT 9, 'none', 500.0"


@query("a5_channel_stats", f"""WITH c AS ({STATS_CHANNELS.format(totals="totals")}), f AS (SELECT device_id, channel, count(*) AS samples, min(value) AS minimum, max(value) AS maximum FROM samples GROUP BY 1, 2)
SELECT c.device_id, c.channel, CAST(sample_rate AS DOUBLE) AS sample_rate, coalesce(samples, 0) AS samples, coalesce(minimum, 0.0) AS minimum, coalesce(maximum, 0.0) AS maximum, coalesce(maximum - minimum, 0.0) AS peak_to_peak, coalesce(maximum - minimum, 0.0) / 2 AS half_amplitude FROM c LEFT JOIN f ON f.device_id = c.device_id AND f.channel = c.channel""", "samples", "totals")
def _(v):
    return reports.channel_stats(v.samples, v.spark.sql(STATS_CHANNELS, totals=v.totals).withColumn("sample_rate", F.col("sample_rate").cast("double")))


NOMINAL = "SELECT DISTINCT device_id, channel, segment, CAST(CASE WHEN device_id = 0 THEN 100 ELSE 90 END AS DOUBLE) AS nominal_rate, CASE WHEN device_id = 2 THEN 'V' ELSE '' END AS unit FROM {records}"
EFFECTIVE = f"""WITH c AS ({NOMINAL.format(records="records")}),
t AS (SELECT device_id, channel, segment, max(sample_start + sample_count) AS sample_count, min(sample_time) AS t0, max(sample_time) AS t1, max_by(block_samples, sample_time) AS n FROM records GROUP BY 1, 2, 3),
e AS (SELECT *, (t1 - t0) / 1000.0::DOUBLE + n / nominal_rate AS seen FROM c JOIN t USING (device_id, channel, segment)),
info AS (SELECT device_id, channel, segment, sample_count, CASE WHEN seen > 0 AND abs(seen - sample_count / nominal_rate) / (sample_count / nominal_rate) >= 0.005 THEN sample_count / seen ELSE nominal_rate END AS sample_rate, CASE WHEN unit = '' THEN 'raw' ELSE unit END AS unit FROM e)
"""
RUN = EFFECTIVE + """, run AS (SELECT device_id, channel, CAST(sum(sample_count) AS BIGINT) AS sample_count, sum(CASE WHEN sample_rate > 0 THEN sample_count / sample_rate ELSE 0 END) AS duration_s FROM info GROUP BY 1, 2)
"""


def _info(v: Views) -> DataFrame:
    block = F.array(F.struct(F.col("sample_time"), F.col("block_samples").alias("data_count_per_channel")))
    return catalog.segment_channel_info(v.spark.sql(NOMINAL, records=v.records), v.records.withColumn("callback_blocks", block), [*KEYS, "segment"])


@query("a6_segment_channel_info", EFFECTIVE + "SELECT * FROM info", "records")
def _(v):
    return _info(v)


@query("a7_run_channel_info", RUN + "SELECT device_id, channel, sample_count, duration_s, sample_count / duration_s AS sample_rate FROM run", "records")
def _(v):
    return catalog.run_channel_info(_info(v), KEYS)


@query("a8_effective_sample_rate", EFFECTIVE + "SELECT device_id, channel, segment, sample_count, sample_rate FROM info", "records")
def _(v):
    return _info(v).select(*KEYS, "segment", "sample_count", "sample_rate")


@query("a9_run_overview", RUN + "SELECT device_id, count(*) AS channels, max(sample_count) AS max_samples, greatest(0.001, max(duration_s)) AS max_duration_s FROM run GROUP BY ROLLUP (device_id)", "records")
def _(v):
    return catalog.run_overview(catalog.run_channel_info(_info(v), KEYS), "device_id")


@query("a10_storage_report", """WITH t AS (SELECT device_id, segment, CAST(sum(original_length) AS BIGINT) AS raw_bytes, CAST(sum(payload_length) AS BIGINT) AS payload_bytes, count(*) AS chunks,
CAST(sum(CASE WHEN flags & 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS compressed, CAST(sum(CASE WHEN flags & 5 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS stored, CAST(sum(CASE WHEN flags & 4 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS raw_stored FROM records GROUP BY ROLLUP (device_id, segment)),
w AS (SELECT *, payload_bytes + 100 * chunks AS written_bytes FROM t)
SELECT *, 100.0::DOUBLE * compressed / chunks AS compressed_pct, 100.0::DOUBLE * stored / chunks AS stored_pct, raw_bytes / written_bytes AS ratio, written_bytes / 1048576.0::DOUBLE / 2.5::DOUBLE AS mb_per_s FROM w""", "records")
def _(v):
    return reports.storage_report(v.records, ["device_id", "segment"], 2.5, F.lit(100))


FAULTS = "faults AS (SELECT CASE WHEN group_id >= 0 THEN group_id ELSE machine_id END AS key, block_index, total_data_count AS actual, lag(total_data_count + data_count_per_channel) OVER (PARTITION BY CASE WHEN group_id >= 0 THEN group_id ELSE machine_id END ORDER BY block_index) AS expected FROM {b}), bad AS (SELECT key, block_index, expected, actual, 'DATA_NOT_CONTINUOUS' AS code FROM faults WHERE expected <> actual)\n"


@query("a11_ingest_report", "WITH " + FAULTS.format(b="odd_blocks") + """, t AS (SELECT CASE WHEN group_id >= 0 THEN group_id ELSE machine_id END AS key, count(*) AS blocks, CAST(sum(buffer_count) AS BIGINT) AS bytes, CAST(sum(CASE WHEN buffer_count <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS dropped FROM odd_blocks GROUP BY 1),
f AS (SELECT key, count(*) AS n FROM bad GROUP BY 1) SELECT t.*, coalesce(n, 0) AS "DATA_NOT_CONTINUOUS", CAST(0 AS BIGINT) AS "CALLBACK_ERROR" FROM t LEFT JOIN f ON f.key = t.key""", "odd_blocks")
def _(v):
    rows = v.odd_blocks.withColumn("key", blocks.continuity_key())
    return reports.ingest_report(rows, blocks.continuity_check(v.odd_blocks), ["DATA_NOT_CONTINUOUS", "CALLBACK_ERROR"])


def _verified(v: Views) -> DataFrame:
    """Audits of two recordings of the blocks: those of one device each by group, and those of all devices.

    The log has the checksums of what was received. In what was stored, the
    first sample of blocks whose number is divisible by 9 differs; group 99 is
    not stored.
    """
    counted = _counted(v).select("block_index", "group_id", "total_data_count", "data_count_per_channel", "buffer_count", "channel_count", "layout", "message_type", "payload")
    found = []
    for whole in (False, True):
        rows = counted.filter("message_type = 21" if whole else "message_type <> 21").withColumn("group_id", F.lit(-1).cast("int") if whole else F.col("group_id"))
        arrays = blocks.channel_arrays(rows).join(rows.select("block_index", "group_id", "total_data_count"), "block_index")
        least = rows.groupBy("group_id").agg(F.min("total_data_count").alias("base"))
        wrong = F.transform("values", lambda x, i: F.when((F.col("block_index") % 9 == 0) & (F.col("channel_pos") == 0) & (i == 0), (x + 1).cast("float")).otherwise(x))
        device = F.col("channel_pos") if whole else F.col("group_id")
        stored = materialise(arrays.join(least, "group_id").select(device.alias("device_id"), F.col("channel_pos").alias("position"), (F.col("total_data_count") - F.col("base")).alias("start"), wrong.alias("values")))
        log = rows.withColumn("crc32", sc.crc32_hex(sc.float_bytes("payload"))).drop("payload", "message_type")
        if not whole:
            log = log.unionByName(log.filter("block_index % 50 = 1").withColumns({"group_id": F.lit(99).cast("int"), "block_index": F.col("block_index") + 1_000_000}))
        found.append(audit.audit_verify(materialise(log), stored))
    return found[0].unionByName(found[1])


VERIFIED = f"""WITH both_ AS (SELECT 2 * block_index AS block_index, payload FROM blocks
UNION ALL SELECT 2 * block_index + 1, list_transform(range(1, len(payload) + 1), lambda i: CASE WHEN i = 1 AND block_index % 9 = 0 THEN CAST(payload[i] + CAST(1 AS FLOAT) AS FLOAT) ELSE payload[i] END) FROM blocks),
{CRC_TABLE}, {FLOATS.replace("FROM blocks", "FROM both_")},
sums AS (SELECT block_index, {CRC} AS crc FROM b, t),
one AS (SELECT x.block_index, CAST(CASE WHEN message_type = 21 THEN -1 ELSE group_id END AS INT) AS group_id, message_type, buffer_count, CASE WHEN received.crc <> stored.crc THEN 'checksum differs' END AS reason
        FROM blocks x JOIN sums received ON received.block_index = 2 * x.block_index JOIN sums stored ON stored.block_index = 2 * x.block_index + 1),
checked AS (SELECT block_index, group_id, buffer_count, reason FROM one UNION ALL SELECT block_index + 1000000, CAST(99 AS INT), buffer_count, 'group is missing' FROM one WHERE message_type <> 21 AND block_index % 50 = 1)
"""


@query("a12_audit_verify", VERIFIED + "SELECT block_index, group_id, reason FROM checked", "blocks")
def _(v):
    return _verified(v).select("block_index", "group_id", "reason")


@query("a13_audit_summary", VERIFIED + "SELECT count(*) FILTER (WHERE coalesce(reason, '') <> 'group is missing') AS checked_blocks, CAST(sum(buffer_count) FILTER (WHERE coalesce(reason, '') <> 'group is missing') AS BIGINT) AS checked_bytes, count(reason) AS mismatches, count(reason) = 0 AS passed FROM checked", "blocks")
def _(v):
    return audit.audit_summary(_verified(v))


def _sample_chunks(v: Views) -> DataFrame:
    placed = v.samples.withColumn("chunk_seq", F.floor(F.col("sample_idx") / 4096))
    return placed.groupBy(*KEYS, "chunk_seq").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("all")).select(*KEYS, "chunk_seq", F.transform("all", lambda s: s["value"].cast("float")).alias("samples"))


@query("a15_codec_matrix")
def _(v):
    return codec_matrix.codec_matrix(_sample_chunks(v), [*KEYS, "chunk_seq"])


@query("a15_recommend")
def _(v):
    return codec_matrix.recommend(codec_matrix.codec_matrix(_sample_chunks(v), [*KEYS, "chunk_seq"]), KEYS)


def _nice_sql(value: str, rounded: bool) -> str:
    power = f"pow(10.0::DOUBLE, floor(log10(greatest({value}, 1e-7))))"
    steps = ((1.5, 1.0), (3, 2.0), (7, 5.0)) if rounded else ((1, 1.0), (2, 2.0), (5, 5.0))
    cases = " ".join(f"WHEN {value} / {power} {'<' if rounded else '<='} {a} THEN {b}::DOUBLE" for a, b in steps)
    return f"((CASE {cases} ELSE 10.0::DOUBLE END) * {power})"


RANGES = "WITH r AS (SELECT device_id, min(minimum) AS lo, max(maximum) AS hi FROM chunks GROUP BY 1), g AS (SELECT device_id, CASE WHEN abs(hi - lo) < 0.000001 THEN lo - 1 ELSE lo END AS low, CASE WHEN abs(hi - lo) < 0.000001 THEN hi + 1 ELSE hi END AS high FROM r)\n"


@query("a16_value_range", RANGES + "SELECT * FROM g", "chunks")
def _(v):
    return reports.value_range(v.chunks, ["device_id"])


@query("a16_axis_bounds", RANGES + f", s AS (SELECT *, {_nice_sql('(high - low)', False)} AS nice FROM g), t AS (SELECT device_id, low, high, {_nice_sql('(nice / 8)', True)} AS step FROM s) SELECT device_id, low, high, floor(low / step) * step AS axis_low, ceil(high / step) * step AS axis_high FROM t", "chunks")
def _(v):
    return reports.axis_bounds(reports.value_range(v.chunks, ["device_id"]))


@query("a16_axis_bounds_live", RANGES + f", p AS (SELECT *, low - (high - low) * 0.06::DOUBLE AS l, high + (high - low) * 0.06::DOUBLE AS h FROM g), s AS (SELECT *, {_nice_sql('(h - l)', False)} AS nice FROM p), t AS (SELECT device_id, low, high, l, h, {_nice_sql('(nice / 8)', True)} AS step FROM s) SELECT device_id, low, high, floor(l / step) * step AS axis_low, ceil(h / step) * step AS axis_high FROM t", "chunks")
def _(v):
    return reports.axis_bounds(reports.value_range(v.chunks, ["device_id"], True), True)


AMPLITUDE = "900.0::DOUBLE"


@query("a16_axis_bounds_symmetric", RANGES + f", m AS (SELECT *, greatest(abs(low), abs(high)) AS most FROM g), p AS (SELECT *, -most - (most + most) * 0.06::DOUBLE AS l, most + (most + most) * 0.06::DOUBLE AS h FROM m), s AS (SELECT *, {_nice_sql('(h - l)', False)} AS nice FROM p), t AS (SELECT *, {_nice_sql('(nice / 8)', True)} AS step FROM s) SELECT device_id, low, high, CASE WHEN most <= {AMPLITUDE} THEN -{AMPLITUDE} ELSE floor(l / step) * step END AS axis_low, CASE WHEN most <= {AMPLITUDE} THEN {AMPLITUDE} ELSE ceil(h / step) * step END AS axis_high FROM t", "chunks")
def _(v):
    return reports.axis_bounds(reports.value_range(v.chunks, ["device_id"], True), True, 900.0)


@query("a17_overview_merge", "WITH e AS (SELECT *, count(*) OVER (PARTITION BY device_id, channel) AS n FROM chunks) SELECT CAST(least(greatest(CAST(trunc((chunk_seq + 0.5) / n * 64) AS INT), 0), 63) AS INT) AS bin, min(minimum) AS minimum, max(maximum) AS maximum FROM e GROUP BY 1", "chunks")
def _(v):
    return reports.overview_merge(v.chunks.withColumnRenamed("chunk_seq", "bucket"), 10)


# Windows


@query("w1_continuity_check", "WITH " + FAULTS.format(b="odd_blocks") + "SELECT * FROM bad", "odd_blocks")
def _(v):
    return blocks.continuity_check(v.odd_blocks)


EVEN = "SELECT block_index, CAST(block_index // 100 AS INT) AS group_id, CAST(0 AS INT) AS machine_id, (block_index % 100) * 16 + CASE WHEN block_index % 100 >= 57 AND block_index >= 200 THEN 5 ELSE 0 END AS total_data_count, 16 AS data_count_per_channel FROM {blocks}"


@query("w2_until_first_fault", f"WITH e AS ({EVEN.format(blocks='blocks')}), " + FAULTS.format(b="e") + "SELECT block_index, group_id FROM e WHERE block_index < coalesce((SELECT min(block_index) FROM bad), 9000000000)", "blocks")
def _(v):
    return blocks.until_first_fault(v.spark.sql(EVEN.replace("block_index // 100", "floor(block_index / 100)"), blocks=v.blocks)).select("block_index", "group_id")


#: Each device is a run; its blocks have 256 bytes, so a segment of 4,000 bytes has 16 blocks.
SEGMENTS = ROUTED + ", headed AS (SELECT *, CAST((dense_rank() OVER (PARTITION BY device_id ORDER BY block_index) - 1) // 16 AS BIGINT) AS segment FROM routed)\n"


def _segmented(v: Views) -> DataFrame:
    rows = materialise(_routed(v).select("device_id", "channel_id", "block_index", "position", "data_count_per_channel"))
    return rows.join(blocks.assign_segments(rows, 4_000, 4, "device_id"), ["device_id", "block_index"])


@query("w3_assign_sample_index", SEGMENTS + "SELECT device_id, channel_id, segment, block_index, CAST(coalesce(sum(data_count_per_channel) OVER (PARTITION BY device_id, channel_id, segment ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sample_start FROM headed", "blocks", "channels")
def _(v):
    return blocks.assign_sample_index(_segmented(v), ("device_id", "channel_id", "segment")).select("device_id", "channel_id", "segment", "block_index", "sample_start")


CHUNKED = ROUTED + "SELECT device_id, channel_id, block_index, data_count_per_channel, CAST((row_number() OVER (PARTITION BY device_id, channel_id ORDER BY block_index) - 1) // 5 AS BIGINT) AS chunk FROM routed"


@query("w4_assign_chunks", CHUNKED, "blocks", "channels")
def _(v):
    return blocks.assign_chunks(_routed(v), 300)


@query("w4_assign_even_chunks", CHUNKED, "blocks", "channels")
def _(v):
    return blocks.assign_even_chunks(_routed(v), 300, 16)


@query("w4_chunks_by_segment", SEGMENTS + "SELECT device_id, channel_id, segment, block_index, CAST((row_number() OVER (PARTITION BY device_id, channel_id, segment ORDER BY block_index) - 1) // 5 AS BIGINT) AS chunk FROM headed", "blocks", "channels")
def _(v):
    return blocks.assign_chunks(_segmented(v), 300, ("device_id", "channel_id", "segment")).drop("data_count_per_channel")


UNEVEN = "SELECT device_id, channel, chunk_seq AS block_index, CAST(10 + chunk_seq * 7 % 50 AS INT) AS data_count_per_channel FROM {chunks}"


@query("w4_assign_uneven_chunks", f"""WITH RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY device_id, channel ORDER BY block_index) AS k FROM ({UNEVEN.format(chunks="chunks")})),
f AS (SELECT *, CAST(0 AS BIGINT) AS chunk, CAST(4 * data_count_per_channel AS BIGINT) AS size FROM u WHERE k = 1
      UNION ALL SELECT u.*, CASE WHEN f.size >= 300 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.size >= 300 THEN 0 ELSE f.size END + 4 * u.data_count_per_channel FROM f JOIN u ON u.device_id = f.device_id AND u.channel = f.channel AND u.k = f.k + 1)
SELECT device_id, channel, block_index, data_count_per_channel, chunk FROM f""", "chunks")
def _(v):
    return blocks.assign_chunks(v.spark.sql(UNEVEN, chunks=v.chunks), 300, tuple(KEYS))


@query("w5_assign_segments", ROUTED.replace("WITH ", "WITH RECURSIVE ", 1) + """, heads AS (SELECT group_id AS run_id, block_index, CAST(sum(4 * data_count_per_channel) AS BIGINT) AS bytes, list(DISTINCT concat(device_id, '/', channel_id)) AS fed, row_number() OVER (PARTITION BY group_id ORDER BY block_index) AS k FROM routed GROUP BY group_id, block_index),
f AS (SELECT run_id, block_index, k, CAST(0 AS BIGINT) AS segment, bytes, fed FROM heads WHERE k = 1
      UNION ALL SELECT h.run_id, h.block_index, h.k, CASE WHEN f.bytes >= 4000 AND len(f.fed) >= 40 THEN f.segment + 1 ELSE f.segment END, CASE WHEN f.bytes >= 4000 AND len(f.fed) >= 40 THEN h.bytes ELSE f.bytes + h.bytes END,
                       CASE WHEN f.bytes >= 4000 AND len(f.fed) >= 40 THEN h.fed ELSE list_distinct(list_concat(f.fed, h.fed)) END FROM f JOIN heads h ON h.run_id = f.run_id AND h.k = f.k + 1)
SELECT run_id, block_index, segment FROM f""", "blocks", "channels")
def _(v):
    """Each group of blocks is a run, so that runs are folded side by side."""
    return blocks.assign_segments(_routed(v).withColumn("run_id", F.col("group_id")), 4_000, 40)


def _downsample_sql(source: str, order: str, good: str, values: str, width: int) -> str:
    return f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY device_id, channel ORDER BY {order}) - 1 AS pos, count(*) OVER (PARTITION BY device_id, channel) AS n FROM {source}),
q AS (SELECT *, least({width}, n) AS b FROM p), f AS (SELECT device_id, channel, ((pos + 1) * b - 1) // n AS bucket, {values} FROM q WHERE {good} GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT device_id, channel, unnest(range(0, b)) AS bucket FROM q), nan AS (SELECT CAST('NaN' AS DOUBLE) AS x)
SELECT g.device_id, g.channel, g.bucket, coalesce(first, x) AS first, coalesce(last, x) AS last, coalesce(minimum, x) AS minimum, coalesce(maximum, x) AS maximum FROM g LEFT JOIN f ON f.device_id = g.device_id AND f.channel = g.channel AND f.bucket = g.bucket, nan"""


@query("w6_downsample_points", _downsample_sql("noisy", "sample_idx", "isfinite(value)", "min_by(value, pos) AS first, max_by(value, pos) AS last, min(value) AS minimum, max(value) AS maximum", 300), "noisy")
def _(v):
    return envelope.downsample_points(v.noisy, 300)


NOISY_POINTS = "SELECT device_id, channel, point_idx, first, last, CASE WHEN point_idx % 31 = 4 THEN CAST('NaN' AS DOUBLE) ELSE minimum END AS minimum, maximum FROM {points}"


@query("w7_downsample_envelopes", _downsample_sql(f"({NOISY_POINTS.format(points='points')})", "point_idx", "isfinite(minimum) AND isfinite(maximum)", "min_by(first, pos) AS first, max_by(last, pos) AS last, min(minimum) AS minimum, max(maximum) AS maximum", 50), "points")
def _(v):
    return envelope.downsample_envelopes(v.spark.sql(NOISY_POINTS, points=v.points), 50)


RATES = "SELECT device_id, channel, CAST(CASE WHEN device_id = 0 THEN 10000 WHEN device_id = 1 THEN 26000 ELSE -1 END AS DOUBLE) AS sample_rate FROM {totals}"
DECIMATED = f"""WITH r AS (SELECT *, CASE WHEN sample_rate > 0 THEN sample_rate ELSE 4000.0 END AS rate FROM ({RATES.format(totals="totals")})),
k AS (SELECT *, CAST(greatest(1, round_even(rate / least(rate, 4000.0), 0)) AS BIGINT) AS factor FROM r),
p AS (SELECT device_id, channel, value, row_number() OVER (PARTITION BY device_id, channel ORDER BY sample_idx) - 1 AS pos FROM noisy WHERE isfinite(value))
SELECT p.device_id, p.channel, pos // factor AS point, min_by(value, pos) AS first, max_by(value, pos) AS last, min(value) AS minimum, max(value) AS maximum, CAST(rate / factor AS DOUBLE) AS display_rate FROM p JOIN k ON k.device_id = p.device_id AND k.channel = p.channel GROUP BY p.device_id, p.channel, pos // factor, factor, rate HAVING count(*) = factor"""


@query("w8_decimate", DECIMATED, "noisy", "totals")
def _(v):
    return envelope.decimate(v.noisy, v.spark.sql(RATES, totals=v.totals), 4000)


LATEST_SQL = "SELECT device_id, channel, point_idx, minimum, maximum, CAST(row_number() OVER (PARTITION BY device_id, channel ORDER BY point_idx) - 1 AS BIGINT) AS pos FROM points QUALIFY row_number() OVER (PARTITION BY device_id, channel ORDER BY point_idx DESC) <= 40"


@query("w9_latest_points", "SELECT device_id, channel, point_idx, minimum, maximum, CAST(row_number() OVER (PARTITION BY device_id, channel ORDER BY point_idx) - 1 AS BIGINT) AS pos FROM (" + LATEST_SQL.replace(", CAST(row_number() OVER (PARTITION BY device_id, channel ORDER BY point_idx) - 1 AS BIGINT) AS pos", "") + ")", "points")
def _(v):
    return envelope.latest_points(v.points, 40).select(*KEYS, "point_idx", "minimum", "maximum", "pos")


SHOWN = "WITH r AS (SELECT device_id, channel, count(*) AS n, CAST(10 + 5 * device_id AS DOUBLE) AS rate FROM points GROUP BY 1, 2), v AS (SELECT least(greatest(max(n / rate), 0.001), 5.0) AS v FROM r), last AS (SELECT p.* FROM points p JOIN r ON r.device_id = p.device_id AND r.channel = p.channel, v QUALIFY row_number() OVER (PARTITION BY p.device_id, p.channel ORDER BY point_idx DESC) <= greatest(1, ceil(v * rate)))"


@query("w10_live_window", SHOWN + ", " + _downsample_sql("last", "point_idx", "isfinite(minimum) AND isfinite(maximum)", "min_by(first, pos) AS first, max_by(last, pos) AS last, min(minimum) AS minimum, max(maximum) AS maximum", 20)[5:], "points")
def _(v):
    rates = v.totals.select(*KEYS, (10 + 5 * F.col("device_id")).cast("double").alias("display_rate"))
    return envelope.live_window(v.points, rates, 5.0, 20)


GAPPY = "SELECT device_id, channel, sample_idx, value FROM {samples} WHERE sample_idx % 7 <> 3 AND NOT (device_id = 2 AND sample_idx BETWEEN 100 AND 199)"


@query("w11_fill_gaps", f"""WITH s AS ({GAPPY.format(samples="samples")}), g AS (SELECT device_id, channel, unnest(range(0, n)) AS sample_idx FROM totals),
f AS (SELECT g.device_id, g.channel, g.sample_idx, value, count(value) OVER (PARTITION BY g.device_id, g.channel, g.sample_idx // 100) AS k FROM g LEFT JOIN s ON s.device_id = g.device_id AND s.channel = g.channel AND s.sample_idx = g.sample_idx)
SELECT device_id, channel, sample_idx, coalesce(value, 0.0) AS value FROM f WHERE k > 0""", "samples", "totals")
def _(v):
    ranges = v.totals.select(*KEYS, F.lit(0).cast("long").alias("start_sample"), F.col("n").alias("sample_count"))
    return envelope.fill_gaps(v.spark.sql(GAPPY, samples=v.samples), ranges, slice_samples=100)


# Order, sets, probes


@query("o1_order_channels", "SELECT device_id, local_data_index, name FROM channels", "channels")
def _(v):
    return catalog.order_channels(v.channels).select("device_id", "local_data_index", "name")


@query("o2_first_channels", "SELECT device_id, local_data_index, name FROM channels ORDER BY device_id, local_data_index, lower(name) LIMIT 4", "channels")
def _(v):
    return catalog.first_channels(v.channels, 4).select("device_id", "local_data_index", "name")


@query("o3_top_mismatches", VERIFIED + "SELECT block_index, group_id, reason FROM checked WHERE reason IS NOT NULL ORDER BY block_index, group_id LIMIT 20", "blocks")
def _(v):
    return audit.top_mismatches(_verified(v)).select("block_index", "group_id", "reason")


@query("u1_union_selections", "WITH r AS (SELECT * FROM selections QUALIFY row_number() OVER (PARTITION BY view_id ORDER BY device_id, channel) <= 7) SELECT device_id, channel, min(view_id) AS view_id FROM r GROUP BY 1, 2", "selections")
def _(v):
    return catalog.union_selections(v.selections, v.totals, 7, KEYS)


@query("u2_stale_channels", "SELECT device_id, channel FROM totals EXCEPT SELECT device_id, channel FROM selections", "totals", "selections")
def _(v):
    return catalog.stale_channels(v.totals, v.selections, KEYS)


# Functions


@query("f1_crc32", f"""WITH {CRC_TABLE}, h AS (SELECT event_id, hex(encode(props)) AS h FROM events),
b AS (SELECT event_id, list_transform(range(0, len(h) // 2), lambda i: CAST(CAST('0x' || substr(h, 2 * i + 1, 2) AS INT) AS BIGINT)) AS bytes FROM h)
SELECT event_id, CAST({CRC} AS BIGINT) AS crc32, printf('%08X', {CRC}) AS crc32_hex FROM b, t""")
def _(v):
    return v.events.select("event_id", F.crc32(F.col("props").cast("binary")).alias("crc32"), sc.crc32_hex(F.col("props").cast("binary")).alias("crc32_hex"))


@query("f2_float_bytes", f"WITH {CRC_TABLE}, {FLOATS} SELECT block_index, CAST(len(bytes) AS INT) AS bytes, printf('%08X', {CRC}) AS crc32_hex FROM b, t", "blocks")
def _(v):
    return v.blocks.select("block_index", F.octet_length(sc.float_bytes("payload")).alias("bytes"), sc.crc32_hex(sc.float_bytes("payload")).alias("crc32_hex"))


@query("f3_duration", "SELECT device_id, sample_rate > 0 AS valid, CASE WHEN sample_rate > 0 THEN 1000 / sample_rate ELSE 0.0 END AS seconds FROM devices", "devices")
def _(v):
    return v.devices.select("device_id", sc.valid_rate(F.col("sample_rate")).alias("valid"), sc.duration(F.lit(1000), F.col("sample_rate")).alias("seconds"))


@query("f4_names", "SELECT device_id, printf('Device_%04d_%s', device_id + 1, replace(ip_address, '.', '_')) AS group_name, printf('AI%03d', device_id + 1) AS channel_name FROM devices", "devices")
def _(v):
    return v.devices.select("device_id", sc.group_name(F.col("device_id"), F.col("ip_address")).alias("group_name"), sc.channel_name(F.col("device_id")).alias("channel_name"))


@query("f4_run_names", """WITH r AS (SELECT event_id, make_timestamp(2024, 1 + event_id % 12, 1 + event_id % 28, event_id % 24, event_id % 60, event_id % 59) AS moment, CASE event_id % 3 WHEN 0 THEN ' my:run.' || event_id || '/x ' WHEN 1 THEN ' ' END AS custom FROM events),
s AS (SELECT event_id, CASE WHEN trim(coalesce(custom, '')) <> '' THEN replace(replace(replace(trim(custom), ':', '_'), '.', '_'), '/', '_') ELSE 'Capture_' || strftime(moment, '%Y%m%d_%H%M%S') END AS stem FROM r)
SELECT event_id, stem, stem || '_' || printf('%04d', event_id) || '.dhcap' AS segment FROM s""")
def _(v):
    at = F.expr("make_timestamp_ntz(2024, int(1 + event_id % 12), int(1 + event_id % 28), int(event_id % 24), int(event_id % 60), event_id % 59)")
    custom = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" my:run."), F.col("event_id"), F.lit("/x "))).when(F.col("event_id") % 3 == 1, " ")
    named = v.events.select("event_id", sc.run_stem(at, custom).alias("stem"))
    return named.withColumn("segment", sc.segment_name(F.col("stem"), F.col("event_id")))


TIMES = "SELECT device_id, channel, req_id, f.frac FROM {requests} CROSS JOIN (VALUES (0.0), (0.37), (0.5), (0.999), (1.0)) AS f(frac)"


@query("f5_probe_at", _envelope_sql("samples", FLOOR).replace("SELECT g.device_id, g.channel, g.req_id, g.bucket,", "e AS (SELECT g.device_id, g.channel, g.req_id, g.bucket,").replace("grid AS (", "grid AS (").replace("\ne AS", ",\ne AS") + f"""),
z AS (SELECT device_id, channel, req_id, count(*) AS m FROM e GROUP BY 1, 2, 3), t AS ({TIMES.format(requests="requests")})
SELECT t.device_id, t.channel, t.req_id, CAST(frac AS DOUBLE) AS frac, e.bucket, first, last, minimum, maximum, (e.bucket + 0.5) / m AS middle FROM t JOIN z ON z.device_id = t.device_id AND z.channel = t.channel AND z.req_id = t.req_id
JOIN e ON e.device_id = t.device_id AND e.channel = t.channel AND e.req_id = t.req_id AND e.bucket = greatest(0, least(m - 1, CAST(trunc(CAST(frac AS DOUBLE) * m) AS BIGINT)))""", "samples", "requests", "totals")
def _(v):
    times = v.spark.sql(TIMES, requests=v.requests).withColumn("frac", F.col("frac").cast("double"))
    return envelope.probe_at(envelope.channel_envelope(v.samples, v.requests, v.totals), times)


# Sinks, read back


K1_SQL = SEGMENTS + f""", vals AS (SELECT device_id, channel_id, segment, block_index, CASE WHEN layout = 'SampleInterleavedFloat32' THEN list_transform(range(0, 16), lambda i: payload[i * channel_count + position + 1]) ELSE payload[position * 16 + 1 : position * 16 + 16] END AS vals,
row_number() OVER (PARTITION BY device_id, channel_id, segment ORDER BY block_index) - 1 AS k FROM headed),
packed AS (SELECT device_id, channel_id, CAST(segment AS INT) AS segment, k // 5 AS chunk, CAST(min(k) * 16 AS BIGINT) AS sample_start, list(block_index ORDER BY block_index) AS source_blocks, flatten(list(vals ORDER BY block_index)) AS payload FROM vals GROUP BY 1, 2, 3, 4),
numbered AS (SELECT row_number() OVER () AS block_index, * FROM packed),
{CRC_TABLE}, {FLOATS.replace("FROM blocks", "FROM numbered")}
SELECT device_id, channel_id, chunk, segment, sample_start, source_blocks, CAST(len(bytes) AS INT) AS bytes, CAST({CRC} AS BIGINT) AS raw_crc32, CAST({CRC} AS BIGINT) AS payload_crc32 FROM numbered JOIN b USING (block_index), t"""


@query("k1_write_chunks", K1_SQL, "blocks", "channels")
def _(v):
    """Blocks routed to channels, cut in segments and those in chunks, and written with their source blocks and checksums; each device is a run of segments."""
    keys = ["device_id", "channel_id", "segment"]
    values = blocks.channel_arrays(_counted(v)).withColumnRenamed("channel_pos", "position")
    rows = materialise(blocks.assign_sample_index(_segmented(v), tuple(keys)).join(values, ["block_index", "position"]))
    chunk = blocks.assign_chunks(rows, 300, tuple(keys)).drop("data_count_per_channel")
    whole = rows.join(chunk, [*keys, "block_index"]).groupBy(*keys, "chunk").agg(F.min("sample_start").alias("sample_start"), F.array_sort(F.collect_list(F.struct("block_index", "values"))).alias("all"))  # a chunk's blocks
    rows = whole.select("device_id", "channel_id", "chunk", F.col("segment").cast("int").alias("segment"), "sample_start", F.transform("all", lambda b: b["block_index"]).alias("source_blocks"), sc.float_bytes(F.flatten(F.transform("all", lambda b: b["values"]))).alias("payload"))
    root = f"{shared_dir(v.spark)}/chunks-{uuid.uuid4().hex}"
    run = tables.write_chunks(rows.withColumn("raw_crc32", F.crc32("payload")), root, "run")
    return v.spark.read.parquet(root).filter(F.col("run_id") == run).drop("run_id").withColumn("bytes", F.octet_length("payload")).drop("payload")


@query("k2_export_samples", f"WITH s AS ({GAPPY.format(samples='samples')}), g AS (SELECT device_id, channel, unnest(range(0, n)) AS sample_idx FROM totals) SELECT g.device_id, g.channel, g.sample_idx, coalesce(value, 0.0) AS value FROM g LEFT JOIN s ON s.device_id = g.device_id AND s.channel = g.channel AND s.sample_idx = g.sample_idx", "samples", "totals")
def _(v):
    path = f"{shared_dir(v.spark)}/export-{uuid.uuid4().hex}"
    tables.export_samples(v.spark.sql(GAPPY, samples=v.samples), v.totals.select(*KEYS, F.lit(0).cast("long").alias("start_sample"), F.col("n").alias("sample_count")), path)
    return v.spark.read.parquet(path)


def _audit_log(v: Views) -> DataFrame:
    path = f"{shared_dir(v.spark)}/audit-{uuid.uuid4().hex}"
    rows = _counted(v).withColumn("group_info", F.concat(F.lit('a "quoted", '), F.col("group_id").cast("string")))
    tables.write_audit(rows.withColumn("message_type", F.col("message_type").cast("string")), path)
    return logs.read_audit(v.spark, path)


@query("k3_write_audit", PER + f"""{CRC_TABLE}, {FLOATS},
c AS (SELECT block_index, printf('%08X', {CRC}) AS crc32 FROM b, t), r AS ({COUNTED.format(c=COUNT_RULE, b="blocks")})
SELECT strftime(make_timestamp(sample_time * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS utc, block_index, CAST(message_type AS VARCHAR) AS message_type, group_id, machine_id, CAST(total_data_count AS BIGINT) AS total_data_count, CAST(data_count_per_channel AS INT) AS data_count_per_channel,
CAST(buffer_count AS INT) AS buffer_count, channel_count, layout, crc32, 'a "quoted", ' || group_id AS group_info FROM r JOIN c USING (block_index)""", "blocks", "channels")
def _(v):
    return _audit_log(v)


@query("s5_read_audit", "SELECT block_index, CAST(message_type AS VARCHAR) AS message_type, group_id, CAST(total_data_count AS BIGINT) AS total_data_count, CAST(data_count_per_channel AS INT) AS data_count_per_channel, CAST(buffer_count AS INT) AS buffer_count, layout, 'a \"quoted\", ' || group_id AS group_info FROM blocks", "blocks")
def _(v):
    return _audit_log(v).select("block_index", "message_type", "group_id", "total_data_count", "data_count_per_channel", "buffer_count", "layout", "group_info")


# Segments, written from samples and read back


def _segments(v: Views) -> str:
    path = f"{shared_dir(v.spark)}/segments-{uuid.uuid4().hex}"
    segment_files.write_segments(v.samples, path)
    return path


def _with_channel(v: Views, path: str, rows: DataFrame) -> DataFrame:
    names = segments.capture_channels(v.spark, path, "*.txt").select("path", "device_id", F.col("channel_name").alias("channel"))
    return rows.join(names, "path")


@query("s2_capture_channels", "SELECT DISTINCT device_id, channel AS channel_name, CAST(sample_idx // 512 AS INT) AS segment, 'raw' AS unit, CAST(1000 AS DOUBLE) AS nominal_rate, 'Zstd' AS codec, 'IntDeltaZigZag' AS preprocessor FROM samples", "samples")
def _(v):
    return segments.capture_channels(v.spark, _segments(v), "*.txt").select("device_id", "channel_name", "segment", "unit", "nominal_rate", "codec", "preprocessor")


@query("s3_capture_records", "SELECT device_id, channel, CAST(sample_idx // 512 AS INT) AS segment, (sample_idx // 64 % 8) * 64 AS sample_start, CAST(count(*) AS INT) AS sample_count, CAST(count(*) * 4 AS INT) AS original_length, CAST(min_by(value, sample_idx) AS FLOAT) AS first, CAST(max_by(value, sample_idx) AS FLOAT) AS last, min(CAST(value AS FLOAT)) AS minimum, max(CAST(value AS FLOAT)) AS maximum FROM samples GROUP BY device_id, channel, sample_idx // 512, sample_idx // 64", "samples")
def _(v):
    path = _segments(v)
    return _with_channel(v, path, segments.capture_records(v.spark, path, "*.txt")).select(*KEYS, "segment", "sample_start", "sample_count", "original_length", "first", "last", "minimum", "maximum")


@query("s4_decode_samples", "SELECT CAST(sample_idx // 512 AS INT) AS segment, CAST(sample_idx % 512 AS BIGINT) AS local_idx, CAST(value AS FLOAT) AS value FROM samples", "samples")
def _(v):
    return segments.decode_samples(v.spark, _segments(v), "*.txt").select("segment", "local_idx", "value")


@query("a14_chunk_integrity", """WITH c AS (SELECT device_id, channel, sample_idx // 512 AS segment, sample_idx // 64 AS seq FROM samples GROUP BY ALL), s AS (SELECT *, seq = max(seq) OVER (PARTITION BY device_id, channel, segment) AS is_last FROM c),
r AS (SELECT CASE WHEN segment % 3 = 1 AND is_last THEN 'payload checksum' ELSE 'ok' END AS status FROM s WHERE segment % 3 <> 2 UNION ALL SELECT 'manifest or index cannot be read: JSONDecodeError' FROM s WHERE segment % 3 = 2 AND is_last)
SELECT status, count(*) AS chunks FROM r GROUP BY 1""", "samples")
def _(v):
    """Of every three segments of a channel one is whole, one has a last payload with a wrong byte, one a broken manifest."""
    path = f"{shared_dir(v.spark)}/segments-{uuid.uuid4().hex}"
    segment_files.write_segments(v.samples, path, damaged=True)
    return segments.chunk_integrity(v.spark, path, "*.txt").groupBy("status").agg(F.count("*").alias("chunks"))


@query("s1_segment_catalog", "WITH n AS (SELECT count(DISTINCT (device_id, channel, sample_idx // 512)) AS n FROM samples), k AS (SELECT unnest(range(0, n)) AS k FROM n) SELECT printf('run_%04d', k) AS segment, true AS is_capture FROM k", "samples")
def _(v):
    """Captures under both extensions."""
    path = _segments(v)
    segment_files.rename(v.spark, path, lambda k: f"run_{k:04d}.dhcap" if k % 2 else f"run_{k:04d}.tdms")
    found = segments.segment_catalog(v.spark, path)
    return found.select(F.regexp_extract("identity", r"([^/]+)$", 1).alias("segment"), "is_capture")


RATE_FILES = "SELECT device_id, ip_address, concat('<Machine><', CASE WHEN device_id % 2 = 0 THEN 'SampleFrequency' ELSE 'SampleFreq' END, '>', CAST(CASE WHEN device_id % 5 = 0 THEN -1 ELSE 100 * device_id END AS VARCHAR(12)), '</', CASE WHEN device_id % 2 = 0 THEN 'SampleFrequency' ELSE 'SampleFreq' END, '></Machine>') AS body FROM {devices} WHERE device_id % 3 > 0"


@query("s6_device_rate_config", """WITH f AS (SELECT device_id AS file_id, ip_address AS ip, CAST(100 * device_id AS DOUBLE) AS rate, lower('Machine' || ip_address || '_' || device_id || '.xml') AS file FROM devices WHERE device_id % 3 > 0 AND device_id % 5 > 0)
SELECT device_id, rate AS config_rate FROM devices JOIN f ON lower(ip_address) = lower(ip) QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY file_id <> device_id, file) = 1""", "devices")
def _(v):
    path = f"{shared_dir(v.spark)}/rates-{uuid.uuid4().hex}"
    rows = v.spark.sql(RATE_FILES, devices=v.devices)
    text = rows.select(F.concat("body", F.lit("<!--Machine"), "ip_address", F.lit("_"), "device_id", F.lit(".xml-->")).alias("value"))
    segment_files.write_named(text, path)
    return logs.device_rate_config(v.spark, f"{path}/Machine*.xml", v.devices)


# Streams, drained


def _block_stream(v: Views) -> DataFrame:
    own = stateful.table_stream(v.spark, f"{v.sf_dir}/embeddings.parquet", "vec_id", shared_dir(v.spark))
    return v.spark.sql(VIEWS["blocks"], embeddings=own)


@query("s7_block_stream", "SELECT block_index, group_id, layout, buffer_count FROM blocks", "blocks")
def _(v):
    kinds = dict(v.blocks.dtypes)
    whole = v.blocks.selectExpr(*(f"{c if c in kinds else 'NULL'} AS {c}" for c in map(str.strip, stateful.fields(logs.BLOCK_SCHEMA)))).to(StructType.fromDDL(logs.BLOCK_SCHEMA))
    feed = logs.block_stream(v.spark, stateful.write_feed(whole, "block_index", shared_dir(v.spark)))
    return stateful.drain(feed.select("block_index", "group_id", "layout", "buffer_count"), shared_dir(v.spark)).drop("batch")


@query("t1_stream_continuity", "WITH " + FAULTS.format(b="blocks") + "SELECT * FROM bad", "blocks")
def _(v):
    return stateful.drain(stateful.stream_continuity(_block_stream(v)), shared_dir(v.spark)).drop("batch")


PLAIN = "SELECT CAST(user_id % 3 AS INT) AS device_id, event_type AS channel, event_id AS sample_idx, value, CAST(10000 AS DOUBLE) AS sample_rate FROM {events}"


def _sample_stream(v: Views) -> DataFrame:
    return v.spark.sql(PLAIN, events=stateful.table_stream(v.spark, f"{v.sf_dir}/events.parquet", "event_id", shared_dir(v.spark)))


@query("t2_stream_decimate", f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY device_id, channel ORDER BY sample_idx) - 1 AS pos FROM ({PLAIN.format(events='events')})) SELECT device_id, channel, pos // 2 AS point, min_by(value, pos) AS first, max_by(value, pos) AS last, min(value) AS minimum, max(value) AS maximum, CAST(5000 AS DOUBLE) AS display_rate FROM p GROUP BY 1, 2, 3 HAVING count(*) = 2")
def _(v):
    return stateful.drain(stateful.stream_decimate(_sample_stream(v), 4000), shared_dir(v.spark)).drop("batch")


@query("t3_stream_latest", f"WITH p AS (SELECT device_id, channel, sample_idx AS point_idx, value AS minimum, value AS maximum FROM ({PLAIN.format(events='events')}) QUALIFY row_number() OVER (PARTITION BY device_id, channel ORDER BY sample_idx DESC) <= 40) SELECT *, CAST(row_number() OVER (PARTITION BY device_id, channel ORDER BY point_idx) - 1 AS BIGINT) AS pos FROM p")
def _(v):
    points = _sample_stream(v).select(*KEYS, F.col("sample_idx").alias("point_idx"), F.col("value").alias("minimum"), F.col("value").alias("maximum"))
    checkpoint = scratch(v.spark, "state")
    stateful.drain(stateful.stream_latest(points, 40), shared_dir(v.spark), checkpoint=checkpoint)
    return stateful.newest(v.spark, checkpoint, 40)


def _fed_stream(v: Views) -> DataFrame:
    """A stream of rows of a block and a channel with its values; blocks of all devices feed every channel."""
    counted = blocks.infer_channel_count(_block_stream(v), v.channels)
    routed = blocks.block_channels(blocks.classify_blocks(counted, v.channels), v.channels)
    n = F.col("data_count_per_channel")
    mixed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("payload", i * F.col("channel_count") + F.col("position")))
    values = F.when(F.col("layout") == blocks.INTERLEAVED, mixed).otherwise(F.slice("payload", F.col("position") * n + 1, n))
    return routed.select("device_id", "channel_id", "block_index", n.alias("n"), values.alias("values"))


@query("t4_stream_chunks", ROUTED + """, vals AS (SELECT device_id, channel_id, CASE WHEN layout = 'SampleInterleavedFloat32' THEN list_transform(range(0, 16), lambda i: payload[i * channel_count + position + 1]) ELSE payload[position * 16 + 1 : position * 16 + 16] END AS vals,
row_number() OVER (PARTITION BY device_id, channel_id ORDER BY block_index) - 1 AS k FROM routed)
SELECT device_id, channel_id, k // 5 AS chunk, CAST(min(k) * 16 AS BIGINT) AS sample_start, CAST(count(*) * 16 AS BIGINT) AS sample_count, CAST(min_by(vals[1], k) AS DOUBLE) AS first, CAST(max_by(vals[16], k) AS DOUBLE) AS last, CAST(min(list_min(vals)) AS DOUBLE) AS minimum, CAST(max(list_max(vals)) AS DOUBLE) AS maximum FROM vals GROUP BY 1, 2, 3""", "blocks", "channels")
def _(v):
    """Filled chunks from the stream, and those that are open at its end from its state."""
    values = F.transform("values", lambda x: x.cast("double"))
    heads = _fed_stream(v).withColumn("values", values).select("device_id", "channel_id", "block_index", "n", F.get("values", F.lit(0)).alias("first"), F.element_at("values", -1).alias("last"), F.array_min("values").alias("minimum"), F.array_max("values").alias("maximum"))
    checkpoint = scratch(v.spark, "state")
    filled = stateful.drain(stateful.stream_chunks(heads, 300), shared_dir(v.spark), checkpoint=checkpoint).drop("batch")
    return filled.unionByName(stateful.open_chunks(v.spark, checkpoint))


@query("k1_stream_chunks", K1_SQL, "blocks", "channels")
def _(v):
    """``k1_write_chunks`` as a stream: each device is a run of segments, and the result is that of the batch."""
    root = scratch(v.spark, "recorded")
    run = recording.record(_fed_stream(v), root, "run", scratch(v.spark, "state"), 300, 4_000, 4)
    rows = recording.read_recording(v.spark, root, run)
    return rows.withColumns({"segment": F.col("segment").cast("int"), "bytes": F.octet_length("payload")}).drop("payload", "run_key")


PER_SECOND, BURST = 20, 8


@query("t5_stream_fanout", f"""WITH RECURSIVE h AS (SELECT group_id AS key, block_index, sample_time, row_number() OVER (PARTITION BY group_id ORDER BY block_index) AS k FROM blocks),
f AS (SELECT key, k, sample_time, CAST({BURST * 1000 - 1000} AS BIGINT) AS tokens, TRUE AS shown FROM h WHERE k = 1
      UNION ALL SELECT h.key, h.k, h.sample_time, CASE WHEN least({BURST * 1000}, f.tokens + (h.sample_time - f.sample_time) * {PER_SECOND}) >= 1000 THEN -1000 ELSE 0 END + least({BURST * 1000}, f.tokens + (h.sample_time - f.sample_time) * {PER_SECOND}),
                       least({BURST * 1000}, f.tokens + (h.sample_time - f.sample_time) * {PER_SECOND}) >= 1000 FROM f JOIN h ON h.key = f.key AND h.k = f.k + 1)
SELECT key, count(*) AS stored, count(*) FILTER (WHERE shown) AS shown, count(*) FILTER (WHERE NOT shown) AS dropped FROM f GROUP BY 1""", "blocks")
def _(v):
    """Every block is stored; the display takes what its budget allows, and what it drops is counted."""
    stored, shown = stateful.stream_fanout(_block_stream(v).select("block_index", "group_id", "machine_id", "sample_time"), shared_dir(v.spark), PER_SECOND, BURST)
    key = blocks.continuity_key().alias("key")
    told = stored.groupBy(key).agg(F.count("*").alias("stored"), F.max("dropped").alias("dropped"))
    return told.join(shown.groupBy(key).agg(F.count("*").alias("shown")), "key", "left").select("key", "stored", F.coalesce("shown", F.lit(0)).alias("shown"), "dropped")


@query("t6_stream_report", "SELECT key, blocks, bytes FROM (SELECT group_id AS key, row_number() OVER b AS blocks, CAST(sum(buffer_count) OVER b AS BIGINT) AS bytes FROM blocks WINDOW b AS (PARTITION BY group_id ORDER BY block_index)) WHERE blocks % 32 = 0", "blocks")
def _(v):
    return stateful.drain(stateful.stream_report(_block_stream(v)), shared_dir(v.spark)).drop("batch")


# SQL access


def _sql(v: Views, text: str) -> DataFrame:
    """A statement over the views and functions of ``sql_access``, whose names begin with rec_."""
    rates = v.spark.sql(STATS_CHANNELS, totals=v.totals)
    sql_access.register(v.spark, "rec_", samples=v.samples, totals=v.totals, requests=v.requests, records=v.chunks, channels=rates)
    return v.spark.sql(text)


@query("sql_channel_envelope", _envelope_sql("samples", FLOOR), "samples", "requests", "totals")
def _(v):
    return _sql(v, "SELECT * FROM rec_channel_envelope()")


@query("sql_channel_stats", ORACLES["a5_channel_stats"])
def _(v):
    return _sql(v, "SELECT * FROM rec_channel_stats()")


@query("sql_overlap_records", ORACLES["j5_overlap_records"])
def _(v):
    return _sql(v, "SELECT * FROM rec_overlap_records(256)")


WIDEST = "SELECT device_id, channel, bucket, maximum - minimum AS spread FROM ({}) WHERE req_id = 0 QUALIFY row_number() OVER (PARTITION BY device_id, channel ORDER BY maximum - minimum DESC, bucket) = 1"


@query("sql_widest_buckets", WIDEST.format(sql(_envelope_sql("samples", BOUNDARY), "samples", "requests", "totals")))
def _(v):
    """The functions within a statement of the user's own."""
    return _sql(v, """SELECT device_id, channel, bucket, spread FROM (
        SELECT *, maximum - minimum AS spread, row_number() OVER (PARTITION BY device_id, channel ORDER BY maximum - minimum DESC, bucket) AS place
        FROM rec_channel_envelope('boundary') WHERE req_id = 0) WHERE place = 1""")
