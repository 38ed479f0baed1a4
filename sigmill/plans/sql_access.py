"""The operators from SQL text: views of a recording and table functions over them.

The functions are SQL functions, so Spark plans a query with them as if their
bodies stood in it: filters reach the scans, and joins are reordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Views that a recording has, and the columns that the functions take from them.
TABLES = {
    "samples": ["device_id", "channel", "sample_idx", "value"],
    "totals": ["device_id", "channel", "n"],
    "requests": ["device_id", "channel", "req_id", "start_sample", "sample_count", "buckets"],
    "records": ["device_id", "channel", "chunk_seq", "sample_start", "sample_count"],
    "channels": ["device_id", "channel", "sample_rate"],
}

#: By name: arguments, returned columns, and body; {p} is the prefix of views and functions.
FUNCTIONS = {
    "bucket_floor": ("i BIGINT, n BIGINT, b BIGINT", "BIGINT", "greatest(0L, least(b - 1, CAST(CAST(i AS DOUBLE) / n * b AS BIGINT)))"),
    "bucket_boundary": ("i BIGINT, n BIGINT, b BIGINT", "BIGINT", "((i + 1) * b - 1) DIV n"),
    "clipped_requests": (
        "", "TABLE (device_id INT, channel STRING, req_id INT, start_sample BIGINT, n BIGINT, b BIGINT)",
        """SELECT device_id, channel, req_id, start_sample, n, least(greatest(1L, CAST(buckets AS BIGINT)), n) FROM (
           SELECT r.device_id, r.channel, r.req_id, r.start_sample, r.buckets, least(r.sample_count, t.n - r.start_sample) AS n
           FROM {p}requests r JOIN {p}totals t ON t.device_id = r.device_id AND t.channel = r.channel) WHERE n > 0 AND start_sample >= 0""",
    ),
    "channel_envelope": (
        "rule STRING DEFAULT 'floor'", "TABLE (device_id INT, channel STRING, req_id INT, bucket BIGINT, first DOUBLE, last DOUBLE, minimum DOUBLE, maximum DOUBLE)",
        """SELECT g.device_id, g.channel, g.req_id, g.bucket, coalesce(f.first, 0), coalesce(f.last, 0), coalesce(f.minimum, 0), coalesce(f.maximum, 0)
           FROM (SELECT device_id, channel, req_id, explode(sequence(0L, b - 1)) AS bucket FROM {p}clipped_requests()) g
           LEFT JOIN (SELECT device_id, channel, req_id, bucket, min_by(value, sample_idx) AS first, max_by(value, sample_idx) AS last,
                             CASE WHEN isnan(min_by(value, sample_idx)) THEN double('NaN') ELSE min(nanvl(value, NULL)) END AS minimum, CASE WHEN isnan(min_by(value, sample_idx)) THEN double('NaN') ELSE max(nanvl(value, NULL)) END AS maximum
                      FROM (SELECT s.device_id, s.channel, r.req_id, s.sample_idx, s.value,
                                   CASE WHEN rule = 'floor' THEN {p}bucket_floor(s.sample_idx - r.start_sample, r.n, r.b) ELSE {p}bucket_boundary(s.sample_idx - r.start_sample, r.n, r.b) END AS bucket
                            FROM {p}samples s JOIN {p}clipped_requests() r ON s.device_id = r.device_id AND s.channel = r.channel AND s.sample_idx >= r.start_sample AND s.sample_idx < r.start_sample + r.n)
                      GROUP BY device_id, channel, req_id, bucket) f
           ON f.device_id = g.device_id AND f.channel = g.channel AND f.req_id = g.req_id AND f.bucket = g.bucket""",
    ),
    "channel_stats": (
        "", "TABLE (device_id INT, channel STRING, sample_rate DOUBLE, samples BIGINT, minimum DOUBLE, maximum DOUBLE, peak_to_peak DOUBLE, half_amplitude DOUBLE)",
        """SELECT c.device_id, c.channel, CAST(c.sample_rate AS DOUBLE), coalesce(samples, 0L), coalesce(low, 0), coalesce(high, 0), coalesce(high - low, 0), coalesce(high - low, 0) / 2
           FROM {p}channels c LEFT JOIN (SELECT device_id, channel, count(*) AS samples, min(value) AS low, max(value) AS high FROM {p}samples
                                         WHERE NOT isnan(value) AND abs(value) < double('Infinity') GROUP BY device_id, channel) f ON f.device_id = c.device_id AND f.channel = c.channel""",
    ),
    "overlap_records": (
        "width BIGINT", "TABLE (device_id INT, channel STRING, req_id INT, chunk_seq BIGINT)",
        """SELECT r.device_id, r.channel, r.req_id, c.chunk_seq
           FROM (SELECT *, explode(sequence(start_sample DIV width, (start_sample + sample_count - 1) DIV width)) AS bin FROM {p}requests WHERE sample_count > 0) r
           JOIN (SELECT *, explode(sequence(sample_start DIV width, (sample_start + sample_count - 1) DIV width)) AS bin FROM {p}records WHERE sample_count > 0) c
           ON c.device_id = r.device_id AND c.channel = r.channel AND c.bin = r.bin AND c.sample_start + c.sample_count > r.start_sample AND c.sample_start < r.start_sample + r.sample_count
           WHERE r.bin = greatest(r.start_sample, c.sample_start) DIV width""",
    ),
}


def register(spark: SparkSession, prefix: str = "", **tables: DataFrame) -> list[str]:
    """Makes views of ``tables`` (by the names of ``TABLES``) and the functions that these suffice for; returns the functions' names.

    All are temporary: the session's own, and replaced when registered again.
    """
    for name, df in tables.items():
        df.select(*TABLES[name]).createOrReplaceTempView(f"{prefix}{name}")
    made = []
    for name, (arguments, kind, body) in FUNCTIONS.items():
        needed = [t for t in TABLES if f"{{p}}{t} " in body or f"{{p}}{t}\n" in body]
        below = [f for f in FUNCTIONS if f"{{p}}{f}(" in body]
        if all(t in tables for t in needed) and all(f in made for f in below):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {kind} RETURN {body.format(p=prefix)}")
            made.append(name)
    return made
