"""SimHash near-duplicates through an inverted index of fingerprint bytes with count filtering.

A posting list of one byte position and value holds 1/256 of all fingerprints,
so tallying from such lists is quadratic. The index is therefore keyed by three
positional bytes of a 64-bit word of the fingerprint.

``NARROW``: two 64-bit fingerprints with at most three differing bits agree in
at least five of their eight bytes, and of any five positions three lie in the
same half: eight keys a fingerprint lose no pair.

``WIDE``: for texts that are alike to 0.8, an angle at which 15 % of the bits
differ, no number of agreeing bytes is guaranteed. Its fingerprints have 24
words; of each word, a text's five surest bytes (those whose bits' votes were
least close) give ten keys, as just these bytes agree between near-duplicates.
The README has the measured share of pairs that meet.

Pairs that meet are tallied by their shared positional bytes; those with the
guaranteed minimum go on to the bit count, and under ``WIDE`` to the Jaccard
similarity of their shingles. Every text of a posting list first meets the
list's least one. Lists whose texts are one component by then, as those of
large groups of copies, are done; the rest have all pairs across components
compared, in blocks, and give a minimum spanning forest, not all links. Where
similarity decides, a pair whose place in the forest a closer pair took, which
then failed, stays unlinked: bits and similarity would have to disagree. (To
compare lists again without the pairs that failed takes as many rounds as a
text has neighbours just under the similarity.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.llm.common import chunks, free_names, map_arrow, materialise, own_columns, table
from sigmill.llm.components import connected_components

SEED = 42
#: Fingerprints of one posting list that are compared at once.
BLOCK = 4096
#: Postings that a task makes, about: what it counts of them fits its memory.
POSTS = 1 << 22
#: Bits with each byte value, as eight counters of eight bits in one word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_TRIPLES = list(combinations(range(8), 3))
_MASKS = np.array([sum(1 << p for p in t) for t in _TRIPLES], np.uint8)


@dataclass(frozen=True)
class Scheme:
    """Words of a shingle, whether repeats count, 64-bit words of a fingerprint, differing bits of a link, surest bytes of a word (0: the triples of both halves), Jaccard similarity of a link (0: the bits decide)."""

    shingle: int
    repeats: bool
    words: int
    bits: int
    surest: int
    jaccard: float

    @property
    def shared(self) -> int:
        """Positional bytes that two linked fingerprints share at least; a posting list guarantees three."""
        return max(3, 8 * self.words - self.bits)

    def check(self) -> None:
        if self.bits < 0 or (not self.surest and self.bits > 3):
            raise ValueError("bits must be 0 to 3: the triples of the halves guarantee no more")


NARROW = Scheme(shingle=3, repeats=True, words=1, bits=3, surest=0, jaccard=0.0)
#: Texts with a Jaccard similarity of 0.8 have an expected share of differing bits of acos(2 * 0.8 / 1.8) / pi, or 0.152; three standard deviations more.
WIDE = Scheme(shingle=5, repeats=False, words=24, bits=int(24 * 64 * 0.152 + 3 * (24 * 64 * 0.152 * 0.848) ** 0.5), surest=5, jaccard=0.8)


def shingle_hashes(text: bytes | None, scheme: Scheme) -> np.ndarray:
    """Hashes of the runs of words; of all words if there are fewer; none without words."""
    words = (text or b"").lower().split()
    if len(words) <= scheme.shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(scheme.shingle))))
    digest = xxhash.xxh64_intdigest
    out = np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(words) - scheme.shingle + 1)
    return out if scheme.repeats else np.unique(out)


def signature(text: bytes | None, scheme: Scheme = NARROW) -> tuple[np.ndarray, np.ndarray]:
    """A fingerprint (bytes, the least first; a bit is 1 if it is in over half the hashes; no words: zero), and for each word the mask of bytes that the index takes."""
    hashes = shingle_hashes(text, scheme)
    n, ones = len(hashes), np.zeros(64 * scheme.words, np.int64)
    salt = np.arange(scheme.words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, n, 1020):
        x = hashes[at : at + 1020, None]
        if scheme.words > 1:
            x = (x ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
        lanes = _LANES[np.ascontiguousarray(x).view(np.uint8)]
        ones += np.add.reduceat(lanes, np.arange(0, len(x), 255), axis=0).view(np.uint8).reshape(-1, len(ones)).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    if not scheme.surest:
        return bits, np.full(scheme.words, 255, np.uint8)
    margin = np.abs(2 * ones - n) / np.sqrt(max(1, n))
    doubt = -np.log1p(-0.5 * np.exp(-1.9 * margin)).reshape(-1, 8, 8).sum(axis=2)  # about the chance that a bit flips between texts alike to 0.8
    sure = np.argsort(doubt, axis=1, kind="stable")[:, : scheme.surest]
    return bits, np.bitwise_or.reduce(np.uint8(1) << sure.astype(np.uint8), axis=1)


def fingerprint(text: bytes | None) -> int:
    return int(signature(text)[0].view(np.uint64)[0])


def signatures(docs: DataFrame, scheme: Scheme = NARROW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sig, mask, digest of the text): one row for each row of ``docs``."""
    rows = own_columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("binary"), F.lit(b"")))

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        known = {t: tuple(x.tobytes() for x in signature(t, scheme)) for t in set(texts)}
        found = [known[t] for t in texts]
        return {"doc_id": batch.column("doc_id"), "sig": pa.array([s for s, _ in found], pa.binary()), "mask": pa.array([m for _, m in found], pa.binary()), "digest": batch.column("digest")}

    return map_arrow(rows.withColumn("digest", F.md5("text")), run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, sig binary, mask binary, digest string")


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) bytes of a binary column whose values all have that width."""
    column = column.cast(pa.binary())
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[column.offset * width : (column.offset + len(column)) * width].reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)


def postings(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """(node, key): the keys of each of ``nodes`` (node, sig, mask), which are dealt out so that no task makes many more than ``POSTS``."""
    take = np.array([all(p < 4 for p in t) or all(p > 3 for p in t) for t in _TRIPLES]) if not scheme.surest else np.ones(len(_TRIPLES), bool)
    at, masks = np.array(_TRIPLES)[take], _MASKS[take]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                sig = _bytes(part.column("sig"), 8 * scheme.words).reshape(part.num_rows, scheme.words, 8)
                row, word, triple = np.nonzero((_bytes(part.column("mask"), scheme.words)[:, :, None] & masks) == masks)
                key = word * len(masks) + triple
                for j in range(3):
                    key = key << 8 | sig[row, word, at[triple, j]]
                yield pa.RecordBatch.from_pydict({"node": part.column("node").take(pa.array(row)), "key": pa.array(key)})

    keys = scheme.words * len(list(combinations(range(scheme.surest), 3))) if scheme.surest else len(at)
    tasks = -(-nodes.count() * keys // POSTS)
    lean = nodes.select("node", "sig", "mask")
    return (lean.repartition(tasks, "node") if tasks > 1 else lean).mapInArrow(run, "node long, key long")


def distances(a: np.ndarray, b: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Differing bits of rows of two arrays of signatures; 2**15 for pairs whose tally of shared positional bytes is under the guaranteed minimum."""
    x = a ^ b
    out = np.bitwise_count(np.ascontiguousarray(x).view(np.uint64)).sum(axis=1, dtype=np.int16)
    if scheme.shared > 3:  # a posting list guarantees three
        out[(x == 0).sum(axis=1) < scheme.shared] = np.iinfo(np.int16).max
    return out


def forest(sig: np.ndarray, comp: np.ndarray, scheme: Scheme) -> list[tuple[int, int]]:
    """A minimum spanning forest, by bits, of the links among the rows of ``sig`` whose ``comp`` differs (Prim's algorithm)."""
    n, edges = len(sig), []
    nearest, to = np.full(n, np.iinfo(np.int16).max, np.int16), np.zeros(n, np.int64)
    rest = np.arange(n)
    while len(rest) and (comp[rest] != comp[rest[0]]).any():
        j = int(rest[nearest[rest].argmin()])
        if nearest[j] <= scheme.bits:
            edges.append((int(to[j]), j))
        same = comp[rest] == comp[j]
        members, rest = rest[same], rest[~same]
        for m in members.tolist():
            d = distances(sig[rest], sig[m][None], scheme)
            closer = d < nearest[rest]
            nearest[rest[closer]], to[rest[closer]] = d[closer], m
    if len(rest) and nearest[rest].min() <= scheme.bits:
        j = int(rest[nearest[rest].argmin()])
        edges.append((int(to[j]), j))
    return edges


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def similar(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], scheme: Scheme) -> DataFrame:
    """Those of ``pairs`` (src, dst) whose texts have the scheme's Jaccard similarity of shingles; ``texts`` gives each of some nodes with its text, once."""
    pairs = materialise(pairs)
    ends = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()

    def read(batch: pa.RecordBatch) -> dict:
        found = [shingle_hashes(t, scheme).tobytes() for t in batch.column("text").to_pylist()]
        return {"node": batch.column("node"), "found": pa.array(found, pa.binary())}

    sets = materialise(map_arrow(texts(ends), read, "node long, found binary"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "a"):
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("a", "b"))
            yield batch.select(["src", "dst"]).filter(pa.array([jaccard(x, y) >= scheme.jaccard for x, y in zip(a, b)], pa.bool_()))

    both = pairs.join(sets.withColumnsRenamed({"node": "src", "found": "a"}), "src").join(sets.withColumnsRenamed({"node": "dst", "found": "b"}), "dst")
    return both.select("src", "dst", "a", "b").mapInArrow(verify, "src long, dst long")


def links(nodes: DataFrame, scheme: Scheme = NARROW, texts: Callable[[DataFrame], DataFrame] | None = None, block: int = BLOCK) -> DataFrame:
    """(src, dst): links among ``nodes`` (node, sig, mask; signatures distinct) by which all pairs that meet and link are connected.

    A scheme with a Jaccard similarity needs the nodes' ``texts``, as ``similar`` does.
    """
    scheme.check()
    posts = postings(nodes, scheme)
    lists = posts.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).filter("n > 1")
    met = materialise(posts.join(lists, "key"))
    of = nodes.select("node", "sig")

    def count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = distances(_bytes(batch.column("a"), 8 * scheme.words), _bytes(batch.column("b"), 8 * scheme.words), scheme) <= scheme.bits
            yield batch.select(["src", "dst"]).filter(pa.array(good))

    sure = (lambda pairs: similar(pairs, texts, scheme)) if scheme.jaccard else (lambda pairs: pairs)
    pairs = met.filter("node <> head").select(F.col("node").alias("src"), F.col("head").alias("dst")).distinct()
    both = pairs.join(of.withColumnsRenamed({"node": "src", "sig": "a"}), "src").join(of.withColumnsRenamed({"node": "dst", "sig": "b"}), "dst")
    first = materialise(sure(both.select("src", "dst", "a", "b").mapInArrow(count_bits, "src long, dst long")))
    root = connected_components(first)
    placed = met.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.filter("n > 2").groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key")
    cells = (
        placed.join(mixed, "key", "left_semi")
        .withColumn("nb", F.ceil(F.col("n") / block))
        .withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
        .filter("nb = 1 or b <> other")
        .select("key", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "node", "root")
        .join(of, "node")
        .select("key", "i", "j", "node", "root", "sig")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
            if (found := np.array(forest(sig, rows[:, 4], scheme), np.int64).reshape(-1, 2)).size:
                ends = rows[:, 3][found]
                yield pa.RecordBatch.from_pydict({"src": ends.max(axis=1), "dst": ends.min(axis=1)})

        head, parts, sigs = None, [], []
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]]).astype(np.int64)
            if not len(rows):
                continue
            sig = _bytes(batch.column("sig"), 8 * scheme.words)
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            for part, part_sig in zip(np.split(rows, cuts), np.split(sig, cuts)):
                if (h := tuple(part[0, :3].tolist())) != head:
                    if head:
                        yield from out(np.concatenate(parts), np.concatenate(sigs))
                    head, parts, sigs = h, [], []
                parts.append(part)
                sigs.append(part_sig)
        if head:
            yield from out(np.concatenate(parts), np.concatenate(sigs))

    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    stars = root.filter("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst"))  # what the first links joined
    return stars.unionByName(sure(dealt.mapInArrow(run, "src long, dst long").distinct()))


def _hex(scheme: Scheme):
    """The fingerprint's bytes in hex, the greatest first."""
    return F.concat(*(F.hex(F.substring("sig", p, 1)) for p in range(8 * scheme.words, 0, -1)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = NARROW) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    Documents whose fingerprints differ in at most ``scheme.bits`` bits, and
    whose shingles have the similarity that the scheme asks for, are linked; ``component_id`` is the smallest id reachable. Null and empty texts
    have fingerprint zero. Rows that repeat an id get a row each; a null id gets
    the component of its fingerprint, and is itself no candidate for
    ``component_id`` (null if no member has an id). Other columns are not read.
    """
    scheme.check()
    rows = materialise(signatures(docs, scheme, id_col, text_col))
    found = rows.groupBy("sig").agg(F.min("mask").alias("mask"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "digest")).alias("first"))
    nodes = materialise(found.withColumn("node", F.monotonically_increasing_id()))
    own = own_columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("binary"), F.lit(b""))).withColumn("digest", F.md5("text"))

    def texts(some: DataFrame) -> DataFrame:
        """A text of each of ``some`` nodes: that of one document, however many share it."""
        wanted = nodes.join(some, "node", "left_semi").select("node", F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest"))
        return own.join(wanted, F.col("digest").eqNullSafe(F.col("first_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "text").dropDuplicates(["node"])

    roots = connected_components(links(nodes, scheme, texts))
    placed = nodes.select("sig", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("sig", "component_id")
    return rows.join(named, "sig").select("doc_id", F.lower(_hex(scheme)).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = WIDE) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their component, unchanged.

    Of rows with that id and the same text one stays. Rows without an id stay,
    as no id can stand for them.
    """
    groups = near_duplicates(docs, id_col, text_col, scheme)
    id_, text, copy = free_names(docs, "id", "text", "copy")
    first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(id_)).distinct()
    row = F.row_number().over(Window.partitionBy(id_col, text).orderBy(F.lit(1)))
    kept = docs.join(first, F.col(id_col) == F.col(id_), "left_semi").withColumn(text, F.sha2(F.col(text_col).cast("binary"), 256)).withColumn(copy, row).filter(F.col(copy) == 1)
    return kept.select(docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all documents by 64-bit fingerprints; see there for nulls, ties, repeated rows and empty tables."""
    return near_duplicates(table(spark, sf_dir, "documents"))
