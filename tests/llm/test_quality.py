import random

import numpy as np
import pytest

from sigmill.llm import quality


def make(i, good):
    rng = random.Random(i)
    if good:
        return ". ".join(" ".join(f"word{rng.randrange(900)}" for _ in range(9)) for _ in range(12)) + "."
    return "BUY NOW!!! " * rng.randrange(5, 40)


ROWS = [(i, make(i, i % 3 > 0)) for i in range(300)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(1, 1), (None, 1), (5, None), (9999, 0)], "doc_id long, label int")


def test_held_out_accuracy_and_edges(docs_of, labels):
    odd = [(None, make(1, True)), (400, None), (401, ""), (402, make(7, True) * 400), (3, make(3, False)), (3, make(3, False))]
    stats = quality.document_statistics(docs_of(ROWS + odd))
    got = quality.score(stats, quality.fit(stats, labels)).collect()
    assert len(got) == len(ROWS) + len(odd) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and 240 <= r.doc_id < 300]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 > 0) for r in held]) > 0.95


def test_normal_equations_match_a_direct_solution(docs_of, labels):
    stats = quality.document_statistics(docs_of(ROWS))
    model = quality.fit(stats, labels)
    one = {r.doc_id: r.label for r in labels.filter("label is not null and doc_id is not null").collect()}
    fold = {r.doc_id for r in stats.filter(f"pmod(xxhash64(doc_id, 3), {quality.FOLDS}) > 0").collect()}
    rows = [(r.x, one[r.doc_id]) for r in stats.collect() if r.doc_id in fold and r.doc_id in one]
    z, y = model.fourier(np.array([x for x, _ in rows])), np.array([v for _, v in rows], float)
    penalty = quality.RIDGE * np.diag([1.0] * quality.FEATURES + [1e-9]) + 1e-12 * np.eye(quality.FEATURES + 1)
    direct = np.linalg.solve(z.T @ z / len(y) + penalty, z.T @ y / len(y))
    assert np.allclose(z @ direct, z @ model.weights, atol=1e-6)
    assert (np.diff(model.level) >= 0).all()


def test_isotonic():
    assert np.allclose(quality.isotonic(np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.array([1, 1, 1, 2, 1.0])), [0.1, 0.3, 0.3, 0.3, 0.9])


def test_without_labels_or_rows(docs_of, labels):
    stats = quality.document_statistics(docs_of(ROWS[:5]))
    assert quality.fit(stats, labels.limit(0)) is None
    assert {r.score for r in quality.score(stats, None).collect()} == {0.5}
    none = quality.document_statistics(docs_of([]))
    assert quality.score(none, quality.fit(none, labels)).collect() == []
