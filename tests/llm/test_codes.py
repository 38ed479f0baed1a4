import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from sigmill.llm import codes
from sigmill.llm.codes import Block, digest, fit_codes, nearest, whole_vectors, with_label_errors

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(n=400, width=16, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(7)]
    out = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 3 if rng.random() < 0.5 else i % 7]], i % 4 if i % 5 else None) for i in range(n)]
    out += [(1000, None, 1), (1001, [1.0] * (width - 1) + [None], 1), (1002, [math.nan] * width, 1), (1003, [math.inf] * width, 1)]
    return out + [(3, out[3][1], 0), (3, [5.0] * width, 0), (None, out[9][1], 2), (1004, [0.0] * width, None), (1005, out[0][1], 9)]


def brute(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds in plain integers; a Counter of (vec_id, code, error, label_error) rows and the codebooks."""
    good = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], la) for i, v, la in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in good), default=0) // parts)
    good = [(i, v + [0] * (parts * width - len(v)), la) for i, v, la in good]
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda part, book: min((gap(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in good:
                members.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(members[k]) for c in zip(*members[k])) if k in members else e for k, e in enumerate(books[p])]
    found = [(i, la, [near(x, books[p]) for p, x in enumerate(cut(v))]) for i, v, la in good]
    errors = {}
    for _, la, at in found:
        errors[la] = errors.get(la, 0) + sum(d for d, _ in at)
    flat = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(((i, "".join(f"{k:02x}" for _, k in at), sum(d for d, _ in at), errors[la]) for i, la, at in found), key=repr), hashlib.sha256(flat.encode()).hexdigest()


def run(spark, rows, **params):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS v", "2 AS uid", "'x' AS code", "3 AS error", "4 AS position")
    found, books = fit_codes(whole_vectors(df), **params)
    out = with_label_errors(found)
    return sorted(map(tuple, out.select("vec_id", "code", "error", "label_error").collect()), key=repr), digest(books)


def test_matches_brute_force(spark):
    assert run(spark, rows()) == brute(rows())


def test_many_partitions_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(codes, "CELLS", 100)
    assert run(spark, rows(150), partition_bytes=4000) == brute(rows(150))


def test_few_ragged_and_empty_vectors(spark):
    for some in ([(5, [1.0] * 8, 1), (2, [2.0] * 8, 1)], [(1, [1.0, 2.0, 3.0], None), (2, [], 1), (3, [0.5] * 19, 1)], [(1, [], 1), (2, [], None)]):
        assert run(spark, some) == brute(some)
    assert run(spark, []) == ([], digest([[] for _ in range(8)]))


def test_one_entry_may_hold_nearly_all(spark):
    """Copies are spread over an entry's salts, and members that stay in their partitions are not shuffled."""
    many = [(i, [1.0] * 8, 0) for i in range(16, 3000)] + [(i, [float(i)] * 8, 0) for i in range(16)]
    assert run(spark, many) == brute(many)
    block = Block(np.arange(3000), np.zeros(3000, np.int32), np.ones(3000, np.int32), np.zeros((3000, 1), np.int64))
    sizes = np.bincount(codes.owners(block, 8), minlength=8)
    assert sizes.max() < 2 * sizes.min()


def test_only_parts_that_change_entry_move(spark):
    vectors = whole_vectors(spark.createDataFrame(rows(), SCHEMA)).selectExpr("v", "coalesce(vec_id, -1) AS uid")
    first = [r.v for r in vectors.orderBy("uid", "v").limit(16).collect()]
    books = [[v[p * 2 : p * 2 + 2] for v in first] for p in range(8)]
    members = codes.settled(vectors, books, 2, 6)
    moved = [[list(np.array(e) + 500) for e in b] for b in books]
    after = codes.migrated(members, moved, 6)
    assert after.getNumPartitions() == 6 and after.partitioner == members.partitioner  # a union of each partition's own
    held = after.mapPartitionsWithIndex(lambda i, records: [(i, to, b) for to, b in records]).collect()
    for i, to, block in held:
        assert i == to and (codes.owners(block, 6) == i).all()
        assert (codes.assign(block, moved)[0] == block.entry).all()
    assert sum(len(b.uid) for _, _, b in held) == 8 * vectors.count()


def test_ties_go_to_the_lower_entry_and_large_numbers_are_exact():
    assert nearest(np.array([[0], [5]]), np.array([[1], [-1], [1]]))[0].tolist() == [0, 0]
    far = np.array([[1 << 31, 0]])
    assert nearest(far, np.array([[0, 1]]))[1].tolist() == [(1 << 62) + 1]
    with pytest.raises(OverflowError):
        nearest(np.array([[1 << 33]]), np.array([[0]]))


def test_sums_beyond_a_long(spark):
    big = [(i, [float(1 << 18) if i % 2 else -float(1 << 18)] * 8, 0) for i in range(40)]
    assert run(spark, big) == brute(big)


def test_components_beyond_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="beyond a long"):
        run(spark, [(1, [1e30] * 8, 1)])


def test_sql_gives_the_same(spark, tables):
    path = tables(embeddings=([r for r in rows() if r[0] not in (3, None)], SCHEMA))
    got = codes.op12_vector_codes(spark, path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet/*.parquet')")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({codes.OP12_SQL})").fetchall())
