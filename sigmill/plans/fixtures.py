"""Views over the driver's tables in the shapes that the operators take; the same text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigmill.operators.ranks import with_positions
from sigmill.plans.shared import materialise, once

#: In order of use: a view may name the tables and the views before it.
VIEWS = {
    "samples": """
SELECT CAST(user_id % 3 AS INT) AS device_id, event_type AS channel,
       CAST(row_number() OVER (PARTITION BY user_id % 3, event_type ORDER BY event_id) - 1 AS BIGINT) AS sample_idx,
       ts, CAST(day(ts) AS INT) AS seg_id, value
FROM {events}""",
    "blocks": """
SELECT vec_id AS block_index, label AS group_id, label AS machine_id,
       CASE WHEN vec_id % 10 = 0 THEN 21 ELSE 5 END AS message_type,
       vec_id * 16 AS total_data_count, 16 AS data_count_per_channel, 256 AS buffer_count,
       CASE WHEN vec_id % 2 = 0 THEN 'SampleInterleavedFloat32' ELSE 'ChannelContiguousFloat32' END AS layout,
       1704067200000 + vec_id * 16 AS sample_time, embedding AS payload
FROM {embeddings}""",
    "odd_blocks": """
SELECT block_index, CASE WHEN block_index % 7 = 0 THEN -1 ELSE group_id END AS group_id, machine_id, message_type, total_data_count,
       CASE WHEN block_index % 11 = 0 THEN 0 WHEN block_index % 5 = 0 THEN 12 ELSE data_count_per_channel END AS data_count_per_channel,
       CASE WHEN block_index % 13 = 0 THEN 0 ELSE buffer_count END AS buffer_count, layout, sample_time,
       CASE WHEN block_index % 17 <> 0 THEN payload END AS payload
FROM {blocks}""",
    "channels": """
SELECT d.device_id, c.channel_id, c.channel_id AS local_data_index, c.channel_id AS data_index,
       concat('AI00', CAST(c.channel_id + 1 AS VARCHAR(3))) AS name, 'raw' AS unit, CAST(1000 AS DOUBLE) AS sample_rate
FROM (SELECT DISTINCT label AS device_id FROM {embeddings}) d
CROSS JOIN (VALUES (0), (1), (2), (3)) AS c(channel_id)""",
    "chunks": """
SELECT device_id, channel, CAST(floor(sample_idx / 64.0) AS BIGINT) AS chunk_seq,
       min(sample_idx) AS sample_start, count(*) AS sample_count,
       min_by(value, sample_idx) AS first, max_by(value, sample_idx) AS last, min(value) AS minimum, max(value) AS maximum
FROM {samples} GROUP BY 1, 2, 3""",
    "totals": "SELECT device_id, channel, count(*) AS n FROM {samples} GROUP BY device_id, channel",
    "groups": "SELECT device_id, channel, CAST(row_number() OVER (ORDER BY device_id, channel) - 1 AS INT) AS group_id FROM {totals}",
    "requests": """
SELECT n.device_id, n.channel, r.req_id, CAST(floor(n.n * r.f0) AS BIGINT) AS start_sample,
       CAST(CASE WHEN r.req_id = 3 THEN 1 ELSE floor(n.n * r.f1) END AS BIGINT) AS sample_count, r.buckets
FROM {totals} n
CROSS JOIN (VALUES (0, 0.0, 1.0, 100), (1, 0.25, 0.5, 20), (2, 1.5, 0.5, 20), (3, 0.5, 0.0, 8)) AS r(req_id, f0, f1, buckets)""",
    "devices": """
SELECT s_suppkey AS device_id, concat('10.0.0.', CAST(s_nationkey AS VARCHAR(9))) AS ip_address,
       s_acctbal AS sample_rate, s_suppkey % 7 <> 0 AS online
FROM {supplier}""",
    "selections": """
SELECT DISTINCT v.view_id, s.device_id, s.channel FROM {samples} s
JOIN (VALUES (1, 0), (2, 1), (2, 0)) AS v(view_id, device_id) ON s.device_id = v.device_id""",
    "points": """
SELECT device_id, channel, CAST(floor(sample_idx / 4.0) AS BIGINT) AS point_idx, min_by(value, sample_idx) AS first, max_by(value, sample_idx) AS last,
       min(value) AS minimum, max(value) AS maximum
FROM {samples} GROUP BY 1, 2, 3""",
    "noisy": """
SELECT device_id, channel, sample_idx, CASE WHEN sample_idx % 97 = 5 THEN CAST('NaN' AS DOUBLE) WHEN sample_idx % 89 = 7 THEN CAST('Infinity' AS DOUBLE)
       WHEN sample_idx % 83 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE value END AS value
FROM {samples}""",
    "records": """
SELECT device_id, channel, CAST(chunk_seq % 3 AS INT) AS segment, CAST(chunk_seq AS BIGINT) AS record_seq, sample_start, sample_count, CAST(sample_count * 4 AS BIGINT) AS original_length,
       CAST(CASE WHEN chunk_seq % 4 = 0 THEN sample_count * 4 ELSE sample_count * 2 + chunk_seq % 5 END AS BIGINT) AS payload_length,
       CAST(CASE WHEN chunk_seq % 8 = 0 THEN 5 WHEN chunk_seq % 4 = 0 THEN 3 ELSE 2 END AS INT) AS flags, 'Zstd' AS codec, 'Delta1' AS preprocessor,
       CAST(2 + chunk_seq % 2 AS INT) AS version, 1704067200000 + sample_start * (10 + device_id % 2) AS sample_time, CAST(sample_count AS BIGINT) AS block_samples
FROM {chunks}""",
    "audit": """
SELECT g.group_id, CAST(c.chunk_seq AS BIGINT) AS block_index, 1000 + c.sample_start AS total_data_count, c.sample_count AS data_count_per_channel, c.sample_count * 4 AS buffer_count
FROM {chunks} c JOIN {groups} g ON g.device_id = c.device_id AND g.channel = c.channel
UNION ALL SELECT CAST(99 AS INT), CAST(900 AS BIGINT), CAST(0 AS BIGINT), CAST(16 AS BIGINT), CAST(64 AS BIGINT)""",
}


def _needs(name: str) -> list[str]:
    """The view and those that it is made of, in order."""
    body = VIEWS[name]
    below = [v for v in VIEWS if f"{{{v}}}" in body]
    return list(dict.fromkeys([x for v in below for x in _needs(v)] + [name]))


def samples(events: DataFrame) -> DataFrame:
    """The view ``samples`` as a stored table, as recordings have it: ranked in spans, so that no window holds a whole channel."""
    rows = events.selectExpr("CAST(user_id % 3 AS INT) AS device_id", "event_type AS channel", "event_id", "ts", "CAST(day(ts) AS INT) AS seg_id", "value")
    placed = with_positions(rows, ["device_id", "channel"], "event_id", "sample_idx")
    return materialise(placed.select("device_id", "channel", "sample_idx", "ts", "seg_id", "value"))


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view, or a table of that name; views that are ``made`` already are taken as they are."""
    made = {} if made is None else made
    if name not in made:
        if name == "samples":
            made[name] = once(spark, f"{sf_dir}/events.parquet", "samples", lambda: samples(view(spark, sf_dir, "events", made)))
        elif name in VIEWS:
            body = VIEWS[name]
            made[name] = spark.sql(body, **{n: view(spark, sf_dir, n, made) for n in [*VIEWS, "events", "embeddings", "supplier"] if f"{{{n}}}" in body})
        else:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return made[name]


def sql(body: str, *views: str) -> str:
    """DuckDB SQL over the named views."""
    names = sorted({x for v in views for x in _needs(v)}, key=list(VIEWS).index)
    own = [f"{n} AS ({VIEWS[n].format_map(_Bare())})" for n in names]
    body = body.strip()
    if not own:
        return body
    head = next((h for h in ("WITH RECURSIVE ", "WITH ") if body.startswith(h)), "")
    return (head or "WITH ") + ",\n".join(own) + (",\n" + body[len(head) :] if head else "\n" + body)


class _Bare(dict):
    def __missing__(self, key: str) -> str:
        return key
