import gzip
import hashlib
import io

import duckdb
import pytest

from sigmill.llm import warc


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, u, h in rows], "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS origin")


BIG, OTHER = "é<p>" * 400, "x" * 70_000
ROWS = [(1, "http://a/\r\nb", BIG), (2, "http://b", BIG), (3, None, BIG), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", OTHER), (9, "u", OTHER + "y"), (9, "u", OTHER + "y"), (10, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 300), (None, "u", BIG), (11, "u", OTHER)]


def expected(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if j is not None and (g or "").encode() == data]
        again = i is not None and len(data) >= 1000 and max(same) > i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None, None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment", [200, 16 << 10])
def test_round_trip(spark, tmp_path, segment):
    path = f"file://{tmp_path}/archive"
    warc.write_archives(pages_of(spark, ROWS), path, segment=segment)
    got = warc.read_archives(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.problem) for r in got), key=repr) == expected(ROWS)


def test_repeated_rows_in_many_parts(spark, tmp_path):
    rows = [(i % 3 or None, "u", BIG) for i in range(90)] + [(7, "v", BIG)] * 20
    path = f"file://{tmp_path}/archive"
    warc.write_archives(pages_of(spark, rows).repartition(7), path)
    got = warc.read_archives(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.problem) for r in got), key=repr) == expected(rows)


def test_sql_gives_the_same(spark, tables):
    rows = sorted({r[0]: r for r in ROWS if r[0] is not None}.values())
    path = tables(pages=(rows, "page_id long, url string, html string"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, warc.op6_warc(spark, path).select(names).collect())) == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({warc.OP6_SQL})").fetchall())


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_archives(pages_of(spark, []), path)
    assert warc.read_archives(spark, path).collect() == []


def test_broken_archives_are_told(spark, tmp_path):
    digest = hashlib.sha1(OTHER.encode()).hexdigest()
    parts = list(warc.records(1, "u", OTHER.encode(), digest, "0.1", None, None, segment=20_000))
    lost, wrong = parts[:1] + parts[2:], [p.replace(b"xxxx", b"xxzx", 1) for p in warc.records(2, "u", OTHER.encode(), digest, "0.1", None, None, segment=1 << 20)]
    short = [p for p in warc.records(3, "u", OTHER.encode(), digest, "0.1", None, None, segment=20_000)][:-1]
    orphan = list(warc.records(4, "u", b"", digest, "0.1", 77, "0.1"))
    tmp_path.joinpath("a.warc.gz").write_bytes(gzip.compress(b"".join(p + b"\r\n\r\n" for p in [*lost, *wrong, *reversed(short), *orphan])))
    got = {r.page_id: r.problem for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert got[1].startswith("segments") and got[2] == "digest" and "bytes" in got[3] and got[4] == "refers to nothing"


def test_chunked_framing():
    for body in (b"", b"a", b"\r\n" * 5000, bytes(range(256)) * 100):
        assert warc.unchunked(warc.chunked(body)) == body
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_parse_reads_any_archive():
    data = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\n\r\n\r\n\r\n\r\n"
    assert [b for _, b in warc.parse(io.BytesIO(data))] == [b"\r\n\r\n"]
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc")))
