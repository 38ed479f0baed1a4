"""Vector codes by product quantisation, fitted by Lloyd's rounds on members that stay where they are.

Vectors are cut into parts. The parts live in partitions by (position, entry,
salt): an owner holds members of one entry and updates it from them, without a
shuffle but for its sums. When a round assigns the parts anew, those that keep
their entry stay in their partition and only the others move, in one shuffle of
the same partitioning, into which the union of both falls.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm.common import materialise, shared_dir, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Of a partition's members, about, and of those that are worked on at once.
PARTITION_BYTES, BLOCK_BYTES = 32 << 20, 4 << 20
#: Least number of salts of an entry.
SALTS = 16
#: Parts whose distances to the entries are computed at once, times the entries and their components.
CELLS = 1 << 22

Codebooks = list[list[list[int]]]


class Codes(NamedTuple):
    codes: DataFrame
    codebooks: Codebooks


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): components as floor(scale * x), without vectors that are null or hold a null or non-finite component. A component beyond a long is an error."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    kept = rows.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    far = lambda x: F.abs(x * scale) >= float(1 << 62)
    return kept.withColumn("v", F.transform("v", lambda x: F.when(far(x), F.raise_error(F.lit("a component is beyond a long")).cast("long")).otherwise(F.floor(x * scale).cast("long"))))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width``; shorter lists are filled up with zeros."""
    size = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, ties to the lower index, and its squared distance. Large components are taken in Python's integers."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if most * most * max(1, parts.shape[1]) >= 1 << 60:
        parts, entries = parts.astype(object), entries.astype(object)
    at, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, CELLS // max(1, entries.size))
    for i in range(0, len(parts), step):
        gap = ((parts[i : i + step, None, :] - entries[None]) ** 2).sum(axis=2)
        if gap.dtype == object and gap.min(initial=0, axis=1).max(initial=0) >= 1 << 63:
            raise OverflowError("a distance is beyond a long")
        at.append(gap.argmin(axis=1))
        far.append(gap.min(axis=1).astype(np.int64))
    return np.concatenate(at), np.concatenate(far)


class Block(NamedTuple):
    """Members of a partition: parts of vectors, and the entry of their position's codebook that each is assigned to."""

    uid: np.ndarray
    position: np.ndarray
    entry: np.ndarray
    part: np.ndarray

    def take(self, rows: np.ndarray) -> Block:
        return Block(*(x[rows] for x in self))


def joined(blocks: Iterable[Block], limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The same members in blocks of about ``limit`` bytes."""
    held, size = [], 0
    for block in blocks:
        held.append(block)
        size += block.part.nbytes + 24 * len(block.uid)
        if size >= limit:
            yield Block(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield Block(*map(np.concatenate, zip(*held)))


def assign(block: Block, codebooks: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each member and its squared distance."""
    entry, far = np.zeros(len(block.uid), np.int32), np.zeros(len(block.uid), np.int64)
    for p in np.unique(block.position):
        own = block.position == p
        entry[own], far[own] = nearest(block.part[own], np.array(codebooks[p], np.int64).reshape(len(codebooks[p]), block.part.shape[1]))
    return entry, far


def owners(block: Block, partitions: int) -> np.ndarray:
    """The partition of each member by its (position, entry, salt). An entry has as many salts as it can use: all members of one position can be its."""
    salt = (block.uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(max(SALTS, partitions))
    key = (block.position.astype(np.uint64) << np.uint64(32)) + block.entry.astype(np.uint64)
    mixed = (key + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
    return ((mixed + salt) % np.uint64(partitions)).astype(np.int64)


def dealt(block: Block, partitions: int) -> Iterator[tuple[int, Block]]:
    """The members by their partitions."""
    to = owners(block, partitions)
    order = np.argsort(to, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        if len(rows):
            yield int(to[rows[0]]), block.take(rows)


def settled(rows: DataFrame, codebooks: Codebooks, width: int, partitions: int) -> RDD:
    """(partition, Block) records of all parts of the (uid, v) ``rows``, each in the partition of its first entry."""
    parts = len(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step := max(1, BLOCK_BYTES // (8 * parts * max(1, width)))):
                batch = whole.slice(at, step)
                cut = _matrix(batch.column("v"), parts * width).reshape(batch.num_rows * parts, width)
                block = Block(np.repeat(batch.column("uid").to_numpy(), parts), np.tile(np.arange(parts, dtype=np.int32), batch.num_rows), np.zeros(len(cut), np.int32), cut)
                block = block._replace(entry=assign(block, codebooks)[0])
                out = [(to, *(x.tobytes() for x in b)) for to, b in dealt(block, partitions)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), *[pa.binary()] * 4])], ["to", *Block._fields])

    def unpacked(row: tuple) -> tuple[int, Block]:
        uid, position, entry, part = (np.frombuffer(x, k) for x, k in zip(row[1:], (np.int64, np.int32, np.int32, np.int64)))
        return row[0], Block(uid, position, entry, part.reshape(len(uid), width))

    return rows.select("uid", "v").mapInArrow(run, "to long, uid binary, position binary, entry binary, part binary").rdd.map(unpacked).partitionBy(partitions)


def migrated(members: RDD, codebooks: Codebooks, partitions: int) -> RDD:
    """``members`` by their new entries: those that keep theirs stay where they are, only the others are shuffled to their new owners.

    Both have one partitioning, so their union is a union of each partition's own.
    """

    def run(records: Iterator[tuple[int, Block]]) -> Iterator[tuple[int, tuple[bool, Block]]]:
        for block in joined(b for _, b in records):
            entry, _ = assign(block, codebooks)
            moves = entry != block.entry
            block = block._replace(entry=entry)
            for to, part in dealt(block.take(np.flatnonzero(~moves)), partitions):
                yield to, (True, part)
            for to, part in dealt(block.take(np.flatnonzero(moves)), partitions):
                yield to, (False, part)

    seen = members.mapPartitions(run, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
    stay = seen.filter(lambda r: r[1][0]).mapValues(lambda v: v[1])
    # not by filter(), which would let Spark take the movers for partitioned already
    move = seen.mapPartitions(lambda records: ((to, block) for to, (stays, block) in records if not stays)).partitionBy(partitions)
    return stay.union(move)


def updated(members: RDD, codebooks: Codebooks, exact: bool) -> Codebooks:
    """Each entry as the floored mean of its members; one without members stays.

    Owners add up their own members first; what is collected are the entries.
    """
    entries = len(codebooks[0])

    def sums(records: Iterator[tuple[int, Block]]) -> Iterator[tuple[tuple[int, int], tuple[int, np.ndarray]]]:
        found: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for block in joined(b for _, b in records):
            of = block.position.astype(np.int64) * entries + block.entry
            order = np.argsort(of, kind="stable")
            part = block.part[order].astype(object) if exact else block.part[order]
            begins = np.concatenate(([0], np.flatnonzero(np.diff(of[order])) + 1))
            counts = np.diff(np.append(begins, len(of)))
            for at, n, s in zip(begins, counts, np.add.reduceat(part, begins, axis=0) if part.shape[1] else part[begins]):
                key = divmod(int(of[order[at]]), entries)
                m, t = found.get(key, (0, 0))
                found[key] = (m + int(n), t + s)
        yield from found.items()

    out = [list(book) for book in codebooks]
    for (position, entry), (n, s) in members.mapPartitions(sums).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), 8).collect():
        out[position][entry] = [int(x) // n for x in s]
    return out


def coded(members: RDD, codebooks: Codebooks, spark: SparkSession) -> DataFrame:
    """(uid, position, entry, d): the last assignment."""

    def last(records: Iterator[tuple[int, Block]]) -> Iterator[tuple[bytes, ...]]:
        for block in joined(b for _, b in records):
            entry, far = assign(block, codebooks)
            yield tuple(bytearray(x.tobytes()) for x in (block.uid, block.position, entry, far))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, k)) for x, k in zip(row, (np.int64, np.int32, np.int32, np.int64))], ["uid", "position", "entry", "d"])

    packed = spark.createDataFrame(members.mapPartitions(last), "uid binary, position binary, entry binary, d binary")
    return packed.mapInArrow(unpack, "uid long, position int, entry int, d long")


def fit_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, partition_bytes: int = PARTITION_BYTES) -> Codes:
    """(vec_id, label, code, error) for a (vec_id, label, v) table of whole vectors, and the final codebooks.

    A vector is cut into ``parts`` equal consecutive parts; where lengths differ
    or do not divide evenly, vectors count as filled up with zeros to the least
    length that does. The entries start as the parts of the vectors of the
    smallest ids (nulls last; among rows that repeat an id, the smaller vector
    first); with fewer vectors than entries there are as many entries as
    vectors. Every row is coded, repeated ones and those without an id too. No
    rows give no rows.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    rows = materialise(vectors.select("vec_id", "label", "v", F.monotonically_increasing_id().alias("uid")))
    size = lambda x: F.coalesce(x, F.lit(0))
    n, longest, most = rows.agg(F.count("*"), size(F.max(F.size("v"))), size(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))))).first()
    width = -(-longest // parts)
    first = [list(r.v) + [0] * (parts * width - len(r.v)) for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]  # as many as entries
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]
    if not n:
        return Codes(rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books)
    partitions = max(spark.sparkContext.defaultParallelism, -(-n * parts * (8 * width + 16) // partition_bytes))
    held: list[RDD] = []
    for r in range(rounds):
        members = migrated(held[-1], books, partitions) if held else settled(rows, books, width, partitions)
        members.persist(StorageLevel.MEMORY_AND_DISK).checkpoint()
        books = updated(members, books, most * n >= 1 << 62)
        if held:
            held[-1].unpersist()
        held.append(members)
    places = coded(held[-1], books, spark).select("uid", F.struct("position", F.lower(F.lpad(F.hex("entry"), 2, "0")).alias("e")).alias("at"), "d")
    codes = places.groupBy("uid").agg(F.array_sort(F.collect_list("at")).alias("at"), F.sum("d").alias("error"))  # a vector's parts
    out = materialise(rows.drop("v").join(codes, "uid").select("vec_id", "label", F.array_join(F.transform("at", lambda x: x["e"]), "").alias("code"), "error"))
    held[-1].unpersist()
    return Codes(out, books)


def digest(codebooks: Codebooks) -> str:
    """SHA-256 of all components by part, entry and place, in decimal and joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for entry in book for x in entry).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """(vec_id, label, code, error) rows with ``label_error``, the error of all rows of the label; null is a label too."""
    rows = codes
    sums = materialise(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings in 8 parts of 16 entries after 6 rounds; see ``whole_vectors`` and ``fit_codes`` for nulls, ties, repeated rows and empty tables."""
    codes, books = fit_codes(whole_vectors(table(spark, sf_dir, "embeddings")))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds as common table expressions, each materialised as it is used by the next assignment and update."""
    steps = [f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE}.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, pos, v[pos * (len(v) // {PARTS}) + 1 : (pos + 1) * (len(v) // {PARTS})] AS part FROM v, range({PARTS}) r(pos)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY row_number() OVER (ORDER BY vec_id) <= {ENTRIES}),
c0 AS MATERIALIZED (SELECT pos, entry, part AS book FROM p JOIN first USING (vec_id))"""]
    near = "SELECT vec_id, pos, arg_min(entry, gap) AS entry, min(gap[1]) AS d FROM (SELECT vec_id, pos, entry, [CAST(list_sum(list_transform(list_zip(part, book), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT), entry] AS gap FROM p JOIN c{r} USING (pos)) GROUP BY 1, 2"
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        steps.append(f"""m{r} AS (SELECT pos, entry, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.pos, a.entry, unnest(part) AS x, generate_subscripts(part, 1) AS i FROM a{r} a JOIN p USING (vec_id, pos)) GROUP BY 1, 2, 3),
c{r + 1} AS MATERIALIZED (SELECT c.pos, c.entry, coalesce(b.book, c.book) AS book FROM c{r} c LEFT JOIN (SELECT pos, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS book FROM m{r} GROUP BY 1, 2) b ON b.pos = c.pos AND b.entry = c.entry)""")
    steps.append(f"""z AS ({near.format(r=ROUNDS)}),
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY 1),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos, entry, i)) AS codebooks_sha256 FROM (SELECT pos, entry, unnest(book) AS x, generate_subscripts(book, 1) AS i FROM c{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), h""")
    return ",\n".join(steps)


OP12_SQL = _sql()
