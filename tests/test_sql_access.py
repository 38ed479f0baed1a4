"""The operators from SQL text."""

import pytest
from pyspark.sql import functions as F

from sigmill.operators import envelope
from sigmill.plans import sql_access


@pytest.fixture(scope="module")
def registered(spark):
    values = [(0, "a", i, float((i * 37) % 11)) for i in range(200)] + [(1, "b", i, float("nan") if i in (0, 50) else float(i)) for i in range(90)]
    samples = spark.createDataFrame(values, "device_id int, channel string, sample_idx long, value double")
    totals = samples.groupBy("device_id", "channel").agg(F.count("*").alias("n"))
    requests = spark.createDataFrame([(0, "a", 0, 0, 200, 7), (0, "a", 1, 150, 500, 20), (1, "b", 2, 0, 90, 3), (1, "b", 3, 95, 5, 3), (0, "a", 4, 3, 1, 0)], "device_id int, channel string, req_id int, start_sample long, sample_count long, buckets int")
    records = envelope.chunk_summary(samples, 16)
    made = sql_access.register(spark, "t_", samples=samples, totals=totals, requests=requests, records=records, channels=totals.withColumn("sample_rate", F.lit(10.0)))
    assert made == list(sql_access.FUNCTIONS)
    return samples, totals, requests, records


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("rule", ["floor", "boundary"])
def test_envelopes(spark, registered, rule):
    samples, totals, requests, _ = registered
    assert rows(spark.sql(f"SELECT * FROM t_channel_envelope('{rule}')")) == rows(envelope.channel_envelope(samples, requests, totals, rule))


def test_overlaps_and_statistics_in_a_statement(spark, registered):
    samples, _, requests, records = registered
    got = spark.sql("SELECT r.req_id, count(*) AS chunks, any_value(s.samples) AS samples FROM t_overlap_records(32) r JOIN t_channel_stats() s USING (device_id, channel) GROUP BY 1")
    want = envelope.overlap_records(requests, records, 32).groupBy("req_id").count()
    assert {(r.req_id, r.chunks) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert {r.req_id: r.samples for r in got.collect()} == {0: 200, 1: 200, 2: 88, 4: 200}


def test_filters_reach_the_scan(spark, registered, tmp_path):
    registered[0].write.parquet(f"{tmp_path}/samples")
    sql_access.register(spark, "p_", samples=spark.read.parquet(f"{tmp_path}/samples"), channels=registered[1].withColumn("sample_rate", F.lit(1.0)))
    plan = spark.sql("SELECT * FROM p_channel_stats() WHERE device_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(device_id,1)" in plan


def test_only_what_the_tables_suffice_for(spark, registered):
    assert sql_access.register(spark, "s_", samples=registered[0]) == ["bucket_floor", "bucket_boundary"]
