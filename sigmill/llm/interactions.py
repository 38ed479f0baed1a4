"""Audit of how quality filters overlap, in every order in which they can be applied.

Whether a text fails each of the filters is a bit; a part's documents are
counted by these bits (and again those of good quality, and toxic ones), so a
part is a tensor with an axis of two places, pass and fail, for each filter.
What a step of an order removes is a contraction: the filters before it select
pass on their axes, its own selects fail, those after it select all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm.common import materialise, table

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
WORD, MARKS = r"[^\x20\x09-\x0D]+", r"[#$%&*|]"
#: Counted for each part, along the second axis of the tensors.
KINDS = ["n", "good", "toxic"]
#: Parts whose tensors are contracted at once.
PARTS = 128

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def orders(letters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def selections(letters: str = FILTERS, this: tuple = FAIL, before: tuple = PASS, after: tuple = ALL) -> np.ndarray:
    """(step of an order, filter, place): what each step of every order selects along each filter's axis."""
    return np.array([[this if x == o[s] else before if x in o[:s] else after for x in letters] for o in orders(letters) for s in range(len(letters))], np.int64)


def contract(tensors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """(part, kind, step) counts of the documents that each step selects, from (part, kind, 2, 2, ...) tensors."""
    axes = "abcdefgh"[: tensors.ndim - 2]
    return np.einsum(f"pk{axes},{','.join('s' + x for x in axes)}->pks", tensors, *(chosen[:, i] for i in range(len(axes))))


def interactions(tensors: np.ndarray, letters: str = FILTERS) -> dict[str, np.ndarray]:
    """The audit's counts, each (part, step of an order), from (part, kind, 2, 2, ...) tensors of counts."""
    names = [o[s] for o in orders(letters) for s in range(len(letters))]
    removed = contract(tensors, selections(letters))
    failing = contract(tensors[:, :1], selections(letters, before=ALL))
    own = np.zeros((len(tensors), len(names)), np.int64)
    for x in letters:
        at = np.array([n == x for n in names])
        own[:, at] = removed[:, 0, at].sum(axis=1, keepdims=True)
    return {
        "kept": contract(tensors[:, :1], selections(letters, this=PASS))[:, 0], "removed": removed[:, 0], "redundant": failing[:, 0] - removed[:, 0],
        "unique_fails": contract(tensors[:, :1], selections(letters, after=PASS))[:, 0], "good_lost": removed[:, 1], "toxic_lost": removed[:, 2], "shapley": own,
    }


def own_failures(text: Column) -> list[Column]:
    """What a text fails by itself: A, B, C and D, as 0 and 1."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    rules = [n < LEAST_WORDS, distinct.cast("long") * 100 < n.cast("long") * DISTINCT_PERCENT, capitals.cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT, text.rlike(MARKS)]
    return [r.cast("int") for r in rules]


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, own, digest): a row for each document, ``own`` having bit i for the i-th of A, B, C, D."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bits = sum((F.shiftleft(x, i) for i, x in enumerate(own_failures(F.col("text")))), F.lit(0))
    return rows.select("doc_id", "part", bits.alias("own"), F.unhex(F.sha2("text", 256)).alias("digest"))


def pattern_counts(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """(part, pattern, n, good, toxic): documents by the bits of what they fail, E (a smaller id has the text) being bit 4.

    Only ids and digests of texts are shuffled; copies meet their smallest id in
    an aggregation, and the row that has it by a join on digest and id, so that
    a large group of copies is no task of its own.
    """
    rows = materialise(failures(docs, **columns))
    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    flagged = rows.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    later = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    long_sum = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long"))
    pattern = F.col("own") + F.shiftleft(later.cast("int"), 4)
    return flagged.groupBy("part", pattern.alias("pattern")).agg(F.count("*").alias("n"), long_sum("good").alias("good"), long_sum("bad").alias("toxic"))


def tensors_of(cells: list[list[dict]], filters: int) -> np.ndarray:
    """(part, kind, 2, 2, ...) counts from each part's cells; the first axis after the kinds is the first filter's."""
    flat = np.zeros((len(cells), len(KINDS), 1 << filters), np.int64)
    for p, part in enumerate(cells):
        for cell in part:
            flat[p, :, cell["pattern"]] += [cell[k] for k in KINDS]
    # the first filter is the lowest bit, which numpy has as its last axis
    return flat.reshape(len(cells), len(KINDS), *[2] * filters).transpose(0, 1, *range(filters + 1, 1, -1))


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), a row for each part, order and step.

    Null texts are empty ones, null sources are those of the empty name. Rows
    are counted, repeated ones too: those that share the smallest id of a text
    all pass E, as no smaller id has it. A row without an id passes E and has no
    labels. An id is good or toxic if any of its labels says so. No documents
    give no rows. Further columns are not looked at.
    """
    counts = pattern_counts(docs, labels, **columns)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("pattern", *KINDS)).alias("cells"))  # 32 at most
    steps = len(FILTERS)
    named = [(o, s + 1) for o in orders() for s in range(steps)]
    names = list(interactions(np.zeros((1, len(KINDS), *[2] * steps), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PARTS):
                batch = whole.slice(at, PARTS)
                found = interactions(tensors_of(batch.column("cells").to_pylist(), steps))
                keys = {
                    "part": pa.array(np.repeat(np.array(batch.column("part").to_pylist(), object), len(named)), pa.string()),
                    "filter_order": pa.array([o for o, _ in named] * batch.num_rows),
                    "step": pa.array(np.tile(np.array([s for _, s in named], np.int32), batch.num_rows)),
                }
                yield pa.RecordBatch.from_pydict(keys | {n: pa.array(found[n].ravel()) for n in names})

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names))


def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``audit`` of all documents by source; see there for nulls, ties, repeated rows and empty tables."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, w.doc_id, CAST(len(words) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT)
      + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
      + 16 * CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), FALSE) AS INT) AS pattern FROM w),
c AS (SELECT part, pattern, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT concat(a.name, b.name, c.name, d.name, e.name) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e
      WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM o, range(1, 6) AS r(step)),
t AS (SELECT part, filter_order, step, bit, sum(CASE WHEN pattern & before = 0 AND pattern & bit = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN pattern & before = 0 AND pattern & bit <> 0 THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN pattern & before <> 0 AND pattern & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN pattern = bit THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN pattern & before = 0 AND pattern & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN pattern & before = 0 AND pattern & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM t
"""
