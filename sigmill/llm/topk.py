"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Candidates and queries are dealt into blocks of bounded size; every pair of
blocks is one group. In it, each term (a component's place) has a posting list
of the candidates with a weight there; the queries that have the term scatter
its weighted postings into dense arrays of scores. Each group keeps the k best
for its queries, by partition selection; these merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.llm.common import materialise, table

SCALE, TOP = 256, 5
#: Components of a block of candidates, and of a block of queries, about.
COMPONENTS = 1 << 20
#: Queries, and candidates of one set of posting lists, whose scores are accumulated at once.
ROWS, LISTED = 32, 2048


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components as floor(scale * x); rows without an id, and vectors that are null or hold a null or non-finite component, are left out. A component beyond a long is an error."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(finite)
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")
    far = lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) >= float(1 << 63)
    return rows.select(F.col(id_col).alias("vec_id"), F.transform(vec_col, lambda x: F.when(far(x), F.raise_error(F.lit("a component is beyond a long")).cast("long")).otherwise(whole(x))).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    size = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Postings:
    """By term, the candidates that have a weight there and their weights; a list of over half of the candidates has them all (None)."""

    def __init__(self, candidates: np.ndarray):
        self.size = len(candidates)
        self.most = int(np.abs(candidates.astype(np.float64)).max(initial=0))
        self.lists = []
        for weights in np.ascontiguousarray(candidates.T):
            at = np.flatnonzero(weights)
            self.lists.append((None, weights) if 2 * len(at) > self.size else (at, weights[at]))

    def accumulate(self, queries: np.ndarray) -> np.ndarray:
        """Integer scores (queries, candidates). Sums that might pass a long are taken in Python's integers; a score that does is an error."""
        most = self.most * int(np.abs(queries.astype(np.float64)).max(initial=0)) * max(1, queries.shape[1])
        kind = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 62 else object
        scores = np.zeros((len(queries), self.size), kind)
        queries = queries.astype(kind)
        for term, (at, weights) in enumerate(self.lists):
            rows = np.flatnonzero(queries[:, term])
            if not len(rows) or not len(weights):
                continue
            if at is None and 2 * len(rows) > len(queries):
                scores += queries[:, term, None] * weights.astype(kind)
            elif at is None:
                scores[rows] += queries[rows, term][:, None] * weights.astype(kind)
            else:
                scores[rows[:, None], at] += queries[rows, term][:, None] * weights.astype(kind)
        if kind is object and any(abs(x) >= 1 << 63 for x in scores.ravel()):
            raise OverflowError("a score is beyond a long")
        return scores.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller id."""
    if len(scores) > k:
        among = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))][:k]


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) for a (vec_id, v) table of whole vectors and those of its rows that ask; a query's own row is no candidate.

    Vectors of different lengths are filled up with zeros. Every row is a
    candidate and, if it asks, a query of its own, rows that repeat an id
    included: each has its ranks from 1, and copies meet each other. Fewer than
    k candidates are all returned; no queries give no rows.
    """
    rows = materialise(vectors.withColumn("row", F.monotonically_increasing_id()).withColumn("asks", F.coalesce(is_query, F.lit(False))))
    n, asking, components = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    block = max(1, int(COMPONENTS * max(1, n) / max(1, components)))
    parts, asks = max(1, -(-n // block)), max(1, -(-asking // block))
    deal = lambda of, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(of)).cast("int")
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("row", "vec_id", "v", deal(parts, 0).alias("p"), grid(asks).alias("q"), F.lit(False).alias("ask"))
    queries = rows.filter("asks").select("row", "vec_id", "v", grid(parts).alias("p"), deal(asks, 1).alias("q"), F.lit(True).alias("ask"))

    def run(cell: pa.Table) -> pa.Table:
        cand, ask, out = cell.filter(pc.invert(cell["ask"])), cell.filter(cell["ask"]), []
        if cand.num_rows and ask.num_rows:
            width = max(max(t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)) for t in (cand, ask))
            c, q = _matrix(cand.column("v"), width), _matrix(ask.column("v"), width)
            postings = [Postings(c[i : i + LISTED]) for i in range(0, len(c), LISTED)]
            ids, own = cand.column("vec_id").to_numpy(), cand.column("row").to_numpy()
            asked, asked_rows = ask.column("vec_id").to_numpy(), ask.column("row").to_numpy()
            for at in range(0, len(q), ROWS):
                found = np.concatenate([p.accumulate(q[at : at + ROWS]) for p in postings], axis=1)
                for row, query, scores in zip(asked_rows[at : at + ROWS], asked[at : at + ROWS], found):
                    other = np.flatnonzero(own != row)
                    out += [(row, query, ids[j], scores[j]) for j in other[best(scores[other], ids[other], k)]]
        cols = list(zip(*out)) or [()] * 4
        return pa.table({n: pa.array(np.array(x, np.int64)) for n, x in zip(("row", "query_id", "vec_id", "score"), cols)})

    found = candidates.unionByName(queries).groupBy("p", "q").applyInArrow(run, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``top_k`` of all embeddings for those whose id is divisible by 50; see ``whole_vectors`` and ``top_k`` for nulls, ties, repeated rows and empty tables."""
    return top_k(whole_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
