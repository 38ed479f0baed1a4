import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.llm import topk


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS p", "3 AS score")


def rows(n=300, seed=1):
    rng = random.Random(seed)
    out = [(i, [rng.choice((0.0, 0.25, -0.5, rng.gauss(0, 1))) for _ in range(6)]) for i in range(n)]
    return out + [(400, None), (450, [1.0, None]), (500, [math.nan] * 6), (550, [math.inf] * 6), (600, []), (650, [1.0]), (700, out[0][1]), (701, out[0][1]), (None, [1.0] * 6), (0, [9.0] * 6), (33, [2.0] * 6), (33, [2.0] * 6)]


def brute(rows, k=5):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(good):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for j, (i, w) in enumerate(good) if j != at)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows):
    whole = topk.whole_vectors(vectors_of(spark, rows))
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(whole, F.expr("vec_id % 50 = 0")).collect())


def test_matches_brute_force(spark):
    assert run(spark, rows()) == brute(rows())


def test_many_blocks_and_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(topk, "COMPONENTS", 100)
    monkeypatch.setattr(topk, "ROWS", 2)
    assert run(spark, rows()) == brute(rows())
    few = [(0, [1.0, 2.0]), (50, [0.5, 0.5]), (1, [1.0, 1.0])]
    assert run(spark, few) == brute(few)
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []


def test_large_weights_stay_exact_and_too_large_scores_are_an_error():
    q, c = np.array([[1 << 40, 3]]), np.array([[1 << 20, 1], [1 << 20, 0]])
    assert topk.Postings(c).accumulate(q).tolist() == [[(1 << 60) + 3, 1 << 60]]
    far = np.array([[3 << 30] * 4])
    with pytest.raises(OverflowError):
        topk.Postings(far).accumulate(far)
    assert topk.Postings(np.array([[3 << 30, -3 << 30]])).accumulate(np.array([[3 << 30, 3 << 30]])).tolist() == [[0]]


def test_components_beyond_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="beyond a long"):
        run(spark, [(0, [1e30]), (1, [1.0])])


def test_zeros_have_no_postings():
    c = np.array([[0, 2, 0], [1, 0, 0], [0, 0, 0]])
    assert [(None if a is None else a.tolist(), w.tolist()) for a, w in topk.Postings(c).lists] == [([1], [1]), ([0], [2]), ([], [])]


def test_sql_gives_the_same(spark, tables):
    path = tables(embeddings=([r for r in rows() if r[1] and len(r[1]) == 6 and r[0] not in (0, 33, None)], "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.op9_topk(spark, path).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet/*.parquet')")
    assert got == sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.OP9_SQL})").fetchall())
