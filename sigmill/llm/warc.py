"""WARC archives written and read by Spark, with segmented records and chunked HTTP bodies.

Records are written by Spark's text sink, whose line separator is the blank
line that ends a WARC record, and are read as whole archives of bounded size.
A record longer than ``SEGMENT_BYTES`` is cut: continuation records name their
origin and count on; the last gives the total length. The reader decodes
whole records where it finds them, and only segments go through a shuffle, by
the id of their origin.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.llm.common import chunks, materialise, shared_dir, table

SEGMENT_BYTES = 16 << 10
HTTP_CHUNK = 4096
#: Payloads from this size on are written once, and revisited.
REVISIT_BYTES = 1000
RECORDS_PER_FILE = 5000
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str, copy: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{copy}')}>"


def chunked(body: bytes, size: int = HTTP_CHUNK) -> bytes:
    """The body in HTTP chunked framing."""
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of chunked framing; chunk extensions and trailers are passed over. Broken framing is an error."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError(f"chunk at byte {at} does not end where it says")
        out.append(framed[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: str, refers_to: int | None, first: str | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page, without the blank line that ends each."""
    own = record_id(page_id, digest, copy)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    uri = "".join(c for c in url or "about:blank" if c.isprintable() and c != " ")
    fields = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("X-Page-ID", page_id)]
    sha1 = f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, first)), ("WARC-Payload-Digest", sha1), ("Content-Type", "application/http;msgtype=response")], http)
        return
    block = http + chunked(payload)
    fields = [("WARC-Type", "response"), *fields, ("WARC-Payload-Digest", sha1), ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment:
        yield _record(fields, block)
        return
    cuts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield _record([*fields, ("WARC-Segment-Number", 1)], cuts[0])
    for n, cut in enumerate(cuts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}:{n}')}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n)]
        yield _record([*more, ("WARC-Segment-Total-Length", len(block) if n == len(cuts) else None)], cut)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record of an archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        yield fields, block


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message, out of its chunked framing if it has one."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = [x.partition(b":") for x in head.lower().split(b"\r\n")[1:]]
    return unchunked(body) if any(k.strip() == b"transfer-encoding" and b"chunked" in v for k, _, v in fields) else body


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit: int = REVISIT_BYTES, segment: int = SEGMENT_BYTES) -> None:
    """Writes gzip-compressed archives of all pages to the folder ``path``, which must not exist.

    Of equal payloads of at least ``revisit`` bytes, the page of the largest id
    is the response and the others revisit it. A page without an id is always a
    response. A null payload is empty. Rows that repeat id and payload are all
    written; with the largest id all of them are responses.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary"))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.spark_partition_id().alias("part")).withColumn("digest", F.sha1("payload"))
    large = base.filter((F.octet_length("payload") >= revisit) & F.col("page_id").isNotNull()).groupBy("page_id", "digest").agg(F.min("part").alias("part"))
    shared = large.groupBy("digest").agg(F.max(F.struct("page_id", "part")).alias("last"), F.min("page_id").alias("least")).filter("least < last.page_id")
    again = large.join(shared, "digest").filter("page_id < last.page_id").select("page_id", "digest", F.col("last.page_id").alias("refers_to"), F.concat(F.col("last.part"), F.lit(".1")).alias("first"))
    # rows that repeat id and payload are numbered in the part of the input they come from, so that no group of them meets in one task
    copy = F.concat("part", F.lit("."), F.row_number().over(Window.partitionBy("page_id", "digest", "part").orderBy("url")))
    rows = base.join(again, ["page_id", "digest"], "left").withColumn("copy", copy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "payload", 4 << 20):
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "copy", "refers_to", "first")]
            yield pa.RecordBatch.from_pydict({"record": pa.array([r for row in zip(*cols) for r in records(*row, segment)], pa.binary())})

    out = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_FOUND = "origin string, seg int, total long, warc_type string, page_id long, refers string, said string, bytes long, digest string, block binary"
_DONE = "record_id string, page_id long, warc_type string, refers string, payload_bytes long, payload_digest string, said string, problem string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, problem): a row for each response and revisit in the archives.

    Segments are put together by origin and order; the total length, the
    framing and the digest that the record states are verified, and ``problem``
    says what is wrong (null: nothing; then size and digest are those of the
    full payload). Of a revisit they are those of the record it refers to.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FOUND.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())))):
                    number = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                    origin = f.get("warc-segment-origin-id", f["warc-record-id"])
                    total = int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None
                    known = [origin, number, total, f["warc-type"], int(f["x-page-id"]) if "x-page-id" in f else None, f.get("warc-refers-to"), f.get("warc-payload-digest")]
                    if f["warc-type"] == "response" and number is None:
                        body = payload_of(block)
                        rows.append((*known, len(body), hashlib.sha1(body).hexdigest(), None))
                    elif f["warc-type"] in ("response", "continuation"):
                        rows.append((*known, None, None, block))
                        size += len(block)
                    elif f["warc-type"] == "revisit":
                        rows.append((*known, None, None, None))
                    if size > 4 << 20 or len(rows) >= 5000:
                        yield _batch(rows, names, _FOUND)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names, _FOUND)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(scan, _FOUND)
    first = lambda c: F.max(c).alias(c)  # noqa: E731  all but one of them are null
    whole = found.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("seg", "block")))).alias("segments"),
        F.max(F.when(F.col("warc_type") != "continuation", F.col("warc_type"))).alias("warc_type"),
        *map(first, ("total", "page_id", "refers", "said", "bytes", "digest")),
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _DONE.split(", ")]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                size, digest, problem = r["bytes"], r["digest"], None
                if r["segments"] or r["warc_type"] is None:
                    block, numbers = b"".join(s["block"] for s in r["segments"]), [s["seg"] for s in r["segments"]]
                    if numbers != list(range(1, len(numbers) + 1)) or r["warc_type"] is None:
                        problem = f"segments {numbers}"
                    elif r["total"] != len(block):
                        problem = f"{len(block)} of {r['total']} bytes"
                    else:
                        try:
                            body = payload_of(block)
                            size, digest = len(body), hashlib.sha1(body).hexdigest()
                        except ValueError as e:
                            problem = str(e)
                if digest and r["said"] and base64.b32decode(r["said"].partition(":")[2]).hex() != digest:
                    problem = "digest"
                rows.append((r["origin"], r["page_id"], r["warc_type"], r["refers"], size, digest, r["said"], problem))
            yield _batch(rows, names, _DONE)

    done = materialise(whole.mapInArrow(join, _DONE))
    response = done.filter("warc_type = 'response' or warc_type is null").select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "problem")
    of = done.filter("warc_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest", F.col("said").alias("is"), F.col("problem").alias("theirs"))
    problem = F.when(F.col("refers_to").isNull(), "refers to nothing").when(F.col("said") != F.col("is"), "digest").otherwise(F.col("theirs"))
    revisit = done.filter("warc_type = 'revisit'").select("page_id", "refers", "said").join(of, "refers", "left")
    return response.unionByName(revisit.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to", problem.alias("problem")))


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], names: list[str], schema: str) -> pa.RecordBatch:
    kinds = [_TYPES[x.split()[1]] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives by ``write_archives`` and read back by ``read_archives``; see there for nulls, ties, repeated rows and empty tables."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS most FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < most THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < most THEN most END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM m
"""
