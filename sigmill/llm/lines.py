"""Line deduplication within one word edit, by a deletion-neighbourhood join.

A line is its words (ASCII letters in lower case, runs of ASCII white space
between words). Two lines match if they are equal, or if one word inserted,
deleted or replaced turns one into the other and the longer has five words or
more (a similarity of 0.8 or more). A line goes if an earlier line matches it;
earlier is by doc_id, then line number.

Every variant of a line with one word left out is hashed. Lines with a word
replaced share a variant with the same gap; a line with a word more has the
shorter line among its variants. Both cases need only the earliest line of
each key, so no group is expanded into pairs.

Lines within one edit share their first or their last half. Halves that occur
in two different lines are marked in a bitmap of fixed size, and only lines
with a marked half emit variants: chance hits cost time and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from sigmill.llm.common import chunks, free_names, materialise, table

MIN_WORDS = 5
#: log2 of the bits that mark shared halves (8 MB, sent to every task).
MARK_BITS = 26
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Lines remembered by a task, so that copies emit their variants once.
_SEEN = 100_000


def half_keys(words: list[bytes]) -> list[int]:
    """Keys of the first and last halves by which lines within one edit of this one can meet it, as signed longs.

    Two keys for the edits that leave this line no longer than the other, then
    two for those in which it has the word more (from five words on).
    """
    n, out = len(words), []
    for c in (n, n - 1):  # the shorter line's length
        if c >= MIN_WORDS - 1:
            h = c // 2
            out.append(xxhash.xxh64_intdigest(b" ".join(words[:h]), 2 * c))
            out.append(xxhash.xxh64_intdigest(b" ".join(words[n - c + h :]), 2 * c + 1))
    return [k - (1 << 64) if k >> 63 else k for k in out]


def _mix(x: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    x = (x ^ np.uint64(salt) if isinstance(salt, int) else x ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def variant_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of the line with each word replaced by a gap, with each word left out, and of the line itself."""
    n = len(words)
    h = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in words), np.uint64, n)
    power = np.full(n, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)])
    left_out = before[:-1] + (before[-1] - before[1:]) * np.uint64(_INVERSE)
    salt = np.arange(n, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(n << 1 | 1)
    return _mix(left_out, salt).view(np.int64), _mix(left_out, 2).view(np.int64), int(_mix(before[-1:], 2).view(np.int64)[0])


def within_one_edit(a: bytes, b: bytes) -> bool:
    """Whether one word inserted, deleted or replaced makes the lines equal."""
    x, y = a.split(b" "), b.split(b" ")
    if len(x) < len(y):
        x, y = y, x
    if len(x) - len(y) > 1 or len(x) < MIN_WORDS:
        return x == y
    i = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), len(y))
    return x[i + 1 :] == y[i + (len(x) == len(y)) :]


def line_hash(line: bytes) -> tuple[int, int]:
    """128 bits that stand for a line, as two signed longs."""
    low, high = np.frombuffer(xxhash.xxh3_128_digest(line, 1), np.int64).tolist()
    return low, high


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(doc_id, key of the document, line number, words) of each line that has words."""
    for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "dk", "text"))):
        for at, line in enumerate((text or b"").lower().split(b"\n")):
            if words := line.split():
                yield doc, key, at, words


def _lines(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            ids, keys, at, digests, halves = [], [], [], [], []
            for doc, key, i, words in _rows(batch):
                ids.append(doc)
                keys.append(key)
                at.append(i)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words), 1))
                halves.append(half_keys(words))
            hashes = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("doc_id").type), pa.array(keys, pa.int64()), pa.array(at, pa.int32()), *(pa.array(np.ascontiguousarray(hashes[:, i])) for i in (0, 1)), pa.array(halves, pa.list_(pa.int64()))],
                names=["doc_id", "dk", "line_no", "lh", "lh2", "halves"],
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, dk long, line_no int, lh long, lh2 long, halves array<long>")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits at the places of the keys (one column of longs); its size does not grow with the input."""
    slot = F.col(keys.columns[0]).bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    words = keys.select(F.shiftright(slot, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(31)).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << MARK_BITS - 5, np.uint32)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out


def _marks(lines: DataFrame) -> np.ndarray:
    """The halves that two different lines share."""
    return _bitmap(lines.select("lh", F.explode("halves").alias("half")).groupBy("half").agg(F.min("lh").alias("a"), F.max("lh").alias("b")).filter("a <> b").select("half"))


def _variants(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """Keys of the lines with a shared half; kind 0: with a gap, 1: with a word left out, 2: the line itself, with its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << MARK_BITS) - 1
        seen: dict[tuple, tuple] = {}
        for batch in chunks(batches, "text", 2 << 20):
            heads, keys, kinds, counts = [], [], [], []
            for doc, key, at, words in _rows(batch):
                shared = [bool(marks[(k & mask) >> 5] >> (k & 31) & 1) for k in half_keys(words)]
                if not any(shared):
                    continue
                joined = b" ".join(words)
                lh = line_hash(joined)
                order = (doc is None, doc, key, at) if doc is not None else (True, 0, key, at)
                if lh in seen and seen[lh] <= order:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen[lh] = order
                gap, out, own = variant_keys(words)
                n, before = len(words), len(keys)
                if n >= MIN_WORDS:  # a shared half leaves the edit to the other
                    keys.append(gap[n // 2 * (not shared[1]) : n if shared[0] else n // 2 * shared[1]])
                    keys.append(out[(n - 1) // 2 * (not shared[3]) : n if shared[2] else ((n - 1) // 2 + 1) * shared[3]])
                keys.append(np.array([own] * (shared[0] or shared[1]), np.int64))
                size = [len(k) for k in keys[before:]]
                kinds.append(np.repeat(np.array([0, 1, 2] if n >= MIN_WORDS else [2], np.int32), size))
                counts.append(sum(size))
                heads.append((doc, key, at, *lh, joined))
            if not heads:
                continue
            which = np.repeat(np.arange(len(heads)), counts)
            kind = np.concatenate(kinds)
            head = [pa.array([h[i] for h in heads], t) for i, t in enumerate((batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
            first = np.concatenate([[True], which[1:] != which[:-1]])[: len(which)]
            texts = pa.array([h[5] for h in heads], pa.binary()).take(pa.array(which, mask=~first))
            yield pa.RecordBatch.from_arrays([*(a.take(pa.array(which)) for a in head), pa.array(np.concatenate(keys)), pa.array(kind), texts], names=["doc_id", "dk", "line_no", "lh", "lh2", "key", "kind", "line"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, dk long, line_no int, lh long, lh2 long, key long, kind int, line binary")


def _meeting(found: DataFrame) -> DataFrame:
    """The rows of ``found`` whose key two different lines may have; others meet nothing."""
    marks = _bitmap(found.groupBy("key").agg(F.min("lh").alias("a"), F.max("lh").alias("b")).filter("a <> b").select("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("key").to_numpy() & ((1 << MARK_BITS) - 1)
            yield batch.filter(pa.array((marks[slot >> 5] >> (slot & 31).astype(np.uint32) & 1).astype(bool)))

    return found.mapInArrow(run, found.schema)


def _near(found: DataFrame) -> DataFrame:
    """(doc_id, dk, line_no) of lines that an earlier line within one edit precedes."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "dk", "line_no", "lh", "lh2").alias("at")
    rows = _meeting(found.drop("line")).select("key", "kind", order)
    first = (
        rows.groupBy("key")
        .agg(F.min(F.when(F.col("kind") == 2, F.col("at"))).alias("first_own"), F.min(F.when(F.col("kind") < 2, F.col("at"))).alias("first_var"))
        .filter("first_var is not null")
    )
    partner = F.when(F.col("kind") == 1, F.col("first_own")).otherwise(F.col("first_var"))
    pairs = rows.join(materialise(first), "key").withColumn("other", partner).filter("other < at and (other.lh <> at.lh or other.lh2 <> at.lh2)")
    pairs = pairs.select("at.lh", "at.lh2", "at.doc_id", "at.dk", "at.line_no", F.col("other.lh").alias("other"), F.col("other.lh2").alias("other2")).distinct()
    texts = found.filter("line is not null").groupBy("lh", "lh2").agg(F.first("line").alias("line"))
    both = pairs.join(texts, ["lh", "lh2"]).join(texts.select(F.col("lh").alias("other"), F.col("lh2").alias("other2"), F.col("line").alias("other_line")), ["other", "other2"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within_one_edit(a, b) for a, b in zip(batch.column("line").to_pylist(), batch.column("other_line").to_pylist())]
            yield batch.select(["doc_id", "dk", "line_no"]).filter(pa.array(good, pa.bool_()))

    return both.select("doc_id", "dk", "line_no", "line", "other_line").mapInArrow(verify, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, dk long, line_no int")


def _exact(lines: DataFrame) -> DataFrame:
    """(doc_id, dk, line_no) of lines of which an earlier copy exists."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "dk", "line_no")
    first = lines.groupBy("lh", "lh2").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("lh", "lh2", "first")
    return lines.join(materialise(first), ["lh", "lh2"]).filter(order > F.col("first")).select("doc_id", "dk", "line_no")  # as a table, so that Spark can split a common line's rows


def _without(docs: DataFrame, text_col: str, gone_col: str) -> DataFrame:
    """``docs`` without the lines whose numbers are in the column ``gone_col`` (null: none), n_lines and n_removed in its place."""
    at, gone = docs.columns.index(text_col), docs.columns.index(gone_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            texts, n_lines, n_removed = [], [], []
            for text, out in zip(batch.column(at).to_pylist(), batch.column(gone).to_pylist()):
                split = [] if text is None else text.split("\n")
                n_lines.append(len(split))
                n_removed.append(len(out or ()))
                if out:
                    dropped = set(out)
                    text = "\n".join(x for i, x in enumerate(split) if i not in dropped)
                texts.append(text)
            columns = batch.columns[:gone] + [pa.array(n_lines, pa.int32()), pa.array(n_removed, pa.int32())]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:gone], "n_lines", "n_removed"])

    schema = StructType([f for f in docs.schema if f.name != gone_col]).add("n_lines", IntegerType()).add("n_removed", IntegerType())
    return docs.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with later matching lines taken out of the text, and the columns n_lines and n_removed (int).

    The first line of each set of copies stays. Lines without words stay. A
    null text stays null (no lines, none removed), an empty one empty. Rows
    with equal id and text are one document and get the same result, each in a
    row of its own; null ids come after all others. A text that loses all its
    lines becomes empty. Other columns pass through; columns named n_lines or
    n_removed are replaced.
    """
    key = F.xxhash64(id_col, text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), key.alias("dk"), F.col(text_col).cast("binary").alias("text"))
    lines = materialise(_lines(own))
    found = materialise(_variants(own, _marks(lines)))
    gone = _exact(lines).unionByName(_near(found)).groupBy("doc_id", "dk").agg(F.collect_set("line_no").alias("gone"))
    kept = docs.drop("n_lines", "n_removed")
    id_, dk, out = free_names(kept, "id", "dk", "gone")
    gone = gone.withColumnsRenamed({"doc_id": id_, "dk": dk, "gone": out})
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (key == F.col(dk))
    return _without(kept.join(gone, same, "left").select(*kept.columns, out), text_col, out)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dedup_lines`` of all documents; see there for nulls, ties, repeated rows and empty tables."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs)
