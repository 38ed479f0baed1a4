"""Benchmark decontamination: a BM25 index of the test items, queried with every passage by block-max WAND.

A score is a share: BM25 of passage and item over BM25 of the item with itself,
so one threshold fits items of any length. Passages are windows of words of
twice the longest item's length, a window beginning at each such length, so
every copy of an item lies whole in a window. Words are in lower
case, ASCII punctuation and white space between them.

The index holds the test items, never the corpus. Its size is checked: a
benchmark is cut in shards, and a pass over the corpus takes as many of them as
``PASS_BYTES`` allow; larger benchmarks take more passes. Frequencies and mean
length are those of all items, so the cut changes no score.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm.common import chunks, filter_arrow, materialise, own_columns, table

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score from which a passage is retrieved, and of its shingles from which it is a leak.
MIN_SCORE, MIN_OVERLAP = 0.7, 0.8
SHINGLE = 5
BLOCK = 4
#: Bytes of test items in one shard of the index, and in the shards that one pass over the corpus takes.
SHARD_BYTES, PASS_BYTES = 2 << 20, 8 << 20

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


_PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_PUNCTUATION).split()


def shingles(words: list[bytes], n: int = SHINGLE) -> set[tuple]:
    """Runs of ``n`` words; of a shorter text the whole."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer: the last sentence is the answer; a single sentence is both."""
    parts = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    if len(parts) < 2:
        return (parts or [[]])[0], (parts or [[]])[0]
    return [w for p in parts[:-1] for w in p], parts[-1]


def part_shingles(words: list[bytes]) -> set[tuple]:
    """What is looked for of a question or an answer: its shingles; of one with less than twice a shingle's words, the words."""
    return shingles(words, SHINGLE if len(words) >= 2 * SHINGLE else 1)


class Index:
    """Postings by term, items in order of length, in blocks of ``BLOCK`` items with the greatest impact of each term.

    Impacts are shares of the item's own score, so items of like length have
    like impacts and block maxima are tight.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int] | None = None, n_items: int | None = None, mean: float | None = None):
        """``df``, ``n_items`` and ``mean``: items that have a word, all items and their mean length; those of ``items`` where not given."""
        docs = sorted(((words_of(t), i, t) for i, t in items), key=lambda x: (len(x[0]), x[1]))
        self.ids = [i for _, i, _ in docs]
        self.longest = max([16, *(len(w) for w, _, _ in docs)])
        if df is None:
            df, n_items, mean = Counter(x for w, _, _ in docs for x in set(w)), len(docs), sum(len(w) for w, _, _ in docs) / max(1, len(docs))
        mean = mean or 1.0
        idf = {w: np.log(1 + (n_items - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        self.term = {w: k for k, w in enumerate(sorted(df))}
        self.lists: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for d, (words, _, _) in enumerate(docs):
            raw = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean)) for w, f in Counter(words).items()}
            own = sum(raw.values())
            for w, x in raw.items():
                self.lists.setdefault((self.term[w], d // BLOCK), []).append((d, x / own))
        self.max = {k: max(x for _, x in v) for k, v in self.lists.items()}
        keys = sorted(self.max)
        self.blocks = len(docs) // BLOCK + 1
        self.block = np.array([b for _, b in keys], np.int64)
        self.block_max = np.array([self.max[k] for k in keys])
        self.begin = np.searchsorted(np.array([t for t, _ in keys], np.int64), np.arange(len(self.term) + 1))
        self.parts = [(*map(part_shingles, question_answer(t)), shingles(w)) for w, _, t in docs]

    def bounds(self, cells: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """(n, blocks): for each cell the sum over its distinct terms of their greatest impact in the block."""
        cells, terms = np.divmod(np.unique(cells * len(self.term) + terms), len(self.term))
        first, count = self.begin[terms], np.diff(self.begin)[terms]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        where = np.repeat(cells, count) * self.blocks + self.block[at]
        return np.bincount(where, self.block_max[at], n * self.blocks).reshape(n, self.blocks)

    def search(self, terms: list[int], block: int, least: float) -> list[tuple[int, float]]:
        """(item, score) of all items in the block that score ``least`` or more for the distinct ``terms``: WAND."""
        heads = [[self.lists[t, block], 0, self.max[t, block]] for t in terms if (t, block) in self.lists]
        found = []
        while heads:
            heads.sort(key=lambda h: h[0][h[1]][0])
            bound, pivot = 0.0, None
            for postings, at, most in heads:
                bound += most
                if bound >= least:
                    pivot = postings[at][0]
                    break
            if pivot is None:
                break
            if heads[0][0][heads[0][1]][0] == pivot:
                score, past = 0.0, pivot + 1
                for postings, at, _ in heads:
                    if postings[at][0] != pivot:
                        break
                    score += postings[at][1]
                if score >= least:
                    found.append((pivot, score))
            else:
                past = pivot
            for h in heads:
                while h[1] < len(h[0]) and h[0][h[1]][0] < past:
                    h[1] += 1
            heads = [h for h in heads if h[1] < len(h[0])]
        return found

    def match(self, text: str, least: float, overlap: float) -> list[tuple[int, float, float, float, int]]:
        """(item id, score, question overlap, answer overlap, first word of the passage): the best passage of each verified item."""
        words = words_of(text)
        ids = np.fromiter(map(self.term.get, words, repeat(-1)), np.int64, len(words))
        hits = np.flatnonzero(ids >= 0)
        if not hits.size:
            return []
        step, n = self.longest, len(words) // self.longest + 2
        bound = self.bounds(hits // step, ids[hits], n)
        best: dict[int, tuple] = {}
        for k, block in np.argwhere(bound[:-1] + bound[1:] >= least).tolist():
            window = words[k * step : (k + 2) * step]
            for d, score in self.search(sorted({t for t in ids[k * step : (k + 2) * step].tolist() if t >= 0}), block, least):
                share = [_share(part, window) for part in self.parts[d]]
                if share[2] >= overlap and min(share[:2]) >= overlap / 2:
                    best[d] = max(best.get(d, (0.0,)), (score, share[0], share[1], k * step))
        return [(self.ids[d], *x) for d, x in sorted(best.items())]


def _share(part: set[tuple], words: list[bytes]) -> float:
    """Share of the part's shingles that the passage has; for a part shorter than a shingle, whether it has the part."""
    n = len(next(iter(part), ()))
    return len(part & shingles(words, n)) / len(part) if part else 1.0


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, word_at): each document and test item that leaked into it, once.

    All items of at least ``min_score`` are retrieved for every passage; of
    those, items count whose shingles of five words the passage has to
    ``min_overlap``, and question and answer each to half of that (a part of
    under ten words by its words). Null and
    empty texts match nothing, on either side; items without an id are left
    out; of items that repeat an id the first by text counts. Rows that repeat
    a document give their matches again. Other columns are not read.
    """
    own = own_columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema[item_col].dataType.simpleString()}, score double, question_overlap double, answer_overlap double, word_at int"
    out = None
    for shards in indexes(items, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], shards: list[Index] = shards) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "text"):
                texts = ((doc, text.decode("utf-8", "replace")) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if text)
                rows = [(doc, *m) for doc, text in texts for index in shards for m in index.match(text, min_score, min_overlap)]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("doc_id").type), pa.array(cols[1]), *(pa.array(c, pa.float64()) for c in cols[2:5]), pa.array(cols[5], pa.int32())], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "word_at"])

        found = own.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def indexes(items: DataFrame, item_col: str = "item_id", item_text: str = "text") -> Iterator[list[Index]]:
    """The index of the test items, in shards of about ``SHARD_BYTES`` of text, those of one pass together; one, perhaps empty, at least."""
    tests = own_columns(items, item_id=item_col, text=item_text).filter("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    size = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    rows = materialise(tests.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int")))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = [(shard, words_of(t.decode("utf-8", "replace"))) for shard, t in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist())]
            each = [(shard, w, len(ws) if i == 0 else 0) for shard, ws in found for i, w in enumerate(sorted(set(ws)))]
            cols = list(zip(*each)) or [(), (), ()]
            yield pa.RecordBatch.from_pydict({"shard": pa.array(cols[0], pa.int32()), "word": pa.array(cols[1], pa.binary()), "length": pa.array(cols[2], pa.int64())})

    terms = materialise(rows.select("shard", F.col("text").cast("binary").alias("text")).mapInArrow(words, "shard int, word binary, length long"))
    n_items, length = terms.agg(F.count_if(F.col("length") > 0), F.coalesce(F.sum("length"), F.lit(0))).first()
    df = terms.groupBy("word").agg(F.count("*").alias("df"))
    together = max(1, PASS_BYTES // SHARD_BYTES)
    for first in range(0, shards, together):
        part = F.col("shard").between(first, first + together - 1)
        of: dict[int, list] = {}
        for r in rows.filter(part).collect():  # about PASS_BYTES
            of.setdefault(r.shard, []).append((r.item_id, r.text))
        here = df.join(terms.filter(part).select("word").distinct(), "word", "left_semi")
        count = {bytes(r.word): r.df for r in here.collect()}  # words of those items
        out = []
        for shard in sorted(of) or [0]:
            mine = [(i, t) for i, t in of.get(shard, []) if words_of(t)]
            own = {w: count[w] for w in {w for _, t in mine for w in words_of(t)}}
            out.append(Index(mine, own, n_items, length / max(1, n_items)))
        yield out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """The rows of ``docs`` into which no item leaked, unchanged; what counts as a leak is as in ``leaks``."""
    for shards in indexes(items):

        def run(batch: pa.RecordBatch, shards: list[Index] = shards) -> pa.RecordBatch:
            return batch.filter(pa.array([not (text and any(index.match(text, min_score, min_overlap) for index in shards)) for text in batch.column(text_col).to_pylist()], pa.bool_()))

        docs = filter_arrow(docs, run, text_col)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``leaks`` of all test items into all documents; see there for nulls, ties, repeated rows and empty tables."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
