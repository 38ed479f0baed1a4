import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.llm import lm

rng = random.Random(4)
VOCABULARY = [f"w{i}{e}" for i in range(60) for e in ("ed", "ing", "é", "s")]


def some(n, half):
    words = VOCABULARY[: len(VOCABULARY) // 2] if half else VOCABULARY[len(VOCABULARY) // 2 :]
    return " ".join(rng.choice(words) for _ in range(n))


LEARN = [(i, some(80, i % 2)) for i in range(60)] + [(90, None), (91, "")]
ALL = LEARN + [(100, some(50, 0)), (101, "never seen words"), (102, None), (None, "W1ED\x0bw1ed"), (103, some(9, 1)), (103, some(4, 1)), (104, "dup unseen w1ed"), (104, "dup unseen w1ed"), (105, some(20_000, 1))]


@pytest.fixture(scope="module")
def scored(docs_of):
    return lm.score_texts(docs_of(ALL), F.col("doc_id") < 95).collect()


def test_base_scores_match_brute_force(scored, monkeypatch):
    counts = Counter(w for _, t in LEARN for w in (t or "").encode().lower().split())
    n, v = sum(counts.values()) + len(LEARN), len(counts) + 1
    want = []
    for i, t in ALL:
        words = (t or "").encode().lower().split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((len(LEARN) + 1) / (n + v + 1))
        want.append((i, len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n, round(base, 6)))
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 and math.isfinite(r.score) for r in scored)


def test_rare_words_are_joined_alike(docs_of, scored, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 50)
    again = lm.score_texts(docs_of(ALL), F.col("doc_id") < 95).collect()
    key = lambda r: (repr(r.doc_id), r.n_tokens, round(r.base_score, 6))
    a, b = sorted(scored, key=key), sorted(again, key=key)
    assert [(r.doc_id, r.n_tokens, r.n_known) for r in a] == [(r.doc_id, r.n_tokens, r.n_known) for r in b]
    assert np.allclose([r.base_score for r in a], [r.base_score for r in b])


def fresh(classes):
    return lm.LogBilinear(classes.groups, classes.width, classes.share)


def test_probabilities_of_all_words_sum_to_one(spark, docs_of):
    counts = lm.word_counts(docs_of(LEARN).selectExpr("cast(text as binary) text"))
    classes = lm.Classes(counts, len(LEARN))
    model = fresh(classes)
    ctx = model.contexts(np.array([3, 5, 1, 0]))[:4]
    by_class = np.array([np.exp(model.log_probabilities(ctx, np.full(4, k))) for k in range(classes.size)])
    assert np.allclose(by_class.sum(axis=0), 1, atol=1e-4)
    assert np.allclose(by_class[classes.share == 0], 0)
    inside = np.zeros(classes.size)
    for place, k in enumerate(classes.of):
        inside[k] += 1.0 if classes.single[k] else (classes.count[place] + 1) / classes.group[k]
    inside[classes.end] = 1
    unknown = np.where(classes.single, 0, 1 / classes.group)
    assert np.allclose((inside + unknown)[classes.share > 0], 1)


def slow_score(model, classes, kinds):
    """Every position on its own, with a softmax over the groups and one over the group's classes."""
    total, before = 0.0, [len(model.r) - 1] * lm.CONTEXT
    for k in kinds.tolist():
        hat = np.append(sum(model.c[i].astype(float) * model.r[b] for i, b in enumerate(before)), 1.0)
        top, low = divmod(k, classes.width)
        for weights, chosen in ((model.g, top), (model.q[top * classes.width : (top + 1) * classes.width], low)):
            logit = weights.astype(float) @ hat
            total += logit[chosen] - np.log(np.exp(logit - logit.max()).sum()) - logit.max()
        before = [k, *before[:-1]]
    return total


def test_scores_match_brute_force(docs_of, scored):
    _, counts, classes, model = lm.fitted(docs_of(ALL), F.col("doc_id") < 95)
    count = {r.word: r.n for r in counts.collect()}
    want = []
    for i, t in ALL:
        if t and len(t) > 9000:
            continue
        kinds, words = classes.encode((t or "").encode())[1:]
        total = slow_score(model, classes, kinds) / math.log(10)
        for k, w in zip(kinds.tolist(), words):
            if not classes.single[k]:
                total += math.log10((count.get(bytes(w), 0) + 1) / classes.group[k])
        want.append((i, len(kinds), round(total, 1)))
    got = [(r.doc_id, r.n_tokens, round(r.score, 1)) for r in scored if r.n_tokens < 9000]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def learned(docs_of, size, parts=2, some_text=None):
    rows = [(i, some_text or some(80, i % 2) if i % 3 else "w1ed") for i in range(900)]
    docs = docs_of(rows).selectExpr("doc_id", "cast(text as binary) text", "true AS learns").repartition(parts)
    classes = lm.Classes(lm.word_counts(docs), 900)
    pieces = lm.pieces_of(sum(len(t) for _, t in rows), classes, size)
    return classes, lm.train(lm.with_rounds(lm.encode(docs, classes), pieces), classes, pieces)


@pytest.mark.parametrize("size", [1 << 22, 20_000])
def test_every_position_is_trained_on(docs_of, size):
    classes, after = learned(docs_of, size)
    kinds = classes.encode(some(400, 1).encode())[1]
    loss = lambda m: -m.log_probabilities(m.contexts(kinds), kinds).mean()
    assert after.trained == classes.tokens
    assert loss(after) < loss(fresh(classes)) - 0.2


def test_the_split_of_the_table_changes_nothing(docs_of):
    text = some(80, 1)
    (_, a), (_, b) = learned(docs_of, 20_000, 1, text), learned(docs_of, 20_000, 7, text)
    assert a.trained == b.trained and np.array_equal(a.flat(), b.flat())


def test_rounds_take_each_piece_once():
    for n in (0, 1, 2, 3, 7, 8, 110):
        assert [p for low, high in lm.rounds(n) for p in range(low, high)] == list(range(n))


def test_slopes_of_the_noise_contrastive_objective():
    share, chosen, k = np.array([0.5, 0.2, 0.3]), np.array([1, 0]), 8
    logit = np.array([[0.3, -0.2, 1.0], [-1.0, 0.5, 0.1]])

    def objective(x):
        data = lambda i, w: 1 / (1 + k * share[w] * np.exp(-x[i, w]))
        return sum(np.log(data(i, c)) + sum(k * share[w] * np.log(1 - data(i, w)) for w in range(3)) for i, c in enumerate(chosen))

    got = lm._off(logit.copy(), chosen, k * share)
    for i in range(2):
        for w in range(3):
            up, down = logit.copy(), logit.copy()
            up[i, w] += 1e-6
            down[i, w] -= 1e-6
            assert got[i, w] == pytest.approx((objective(up) - objective(down)) / 2e-6, abs=1e-6)


def test_nothing_to_learn_from_and_no_rows(docs_of):
    got = lm.score_texts(docs_of([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
    assert lm.score_texts(docs_of([]), F.lit(True)).collect() == []


def test_rounds_of_pieces_are_those_of_the_ranges(spark):
    ranges = lm.rounds(1000)
    rows = spark.range(1000).selectExpr("id AS dk", "true AS learns", "cast('x' AS binary) AS kinds")
    got = {r.dk: r["round"] for r in lm.with_rounds(rows, 1000).collect()}
    assert got == {p: k for k, (low, high) in enumerate(ranges) for p in range(low, high)}
    none = spark.createDataFrame([(5, None, b"x"), (6, False, b"x"), (7, True, None)], "dk long, learns boolean, kinds binary")
    assert {r["round"] for r in lm.with_rounds(none, 1000).collect()} == {-1}


def test_sums_of_a_vast_corpus_do_not_overflow(spark):
    """Weights of 10**13 tokens: sums beyond a long are added up exactly and give the mean."""
    from decimal import Decimal

    tokens, mean = 10**13, 3.25
    weight = tokens // 4096
    sums = [int(mean * weight * lm._UNIT)] * 300 + [weight, tokens]
    assert 300 * sums[0] > 1 << 63
    rows = spark.createDataFrame([(e, v) for _ in range(300) for e, v in ((0, sums[0]), (1, weight))], "entry int, value long")
    added = [r.value for r in rows.groupBy("entry").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).orderBy("entry").collect()]
    assert lm._mean([*added, Decimal(300 * tokens)])[:1].tolist() == [mean]


def test_few_tasks_and_early_sums_give_the_same_model(docs_of, monkeypatch):
    text = some(80, 1)
    a = learned(docs_of, 5_000, 2, text)[1]
    monkeypatch.setattr(lm, "TASKS", 1)
    monkeypatch.setattr(lm, "SUMMED", 1)
    b = learned(docs_of, 5_000, 2, text)[1]
    assert a.trained == b.trained and np.array_equal(a.flat(), b.flat())


def test_empty_classes_stay_out_of_the_sums():
    share = np.array([0.4, 0.3, 0.3, 0.0])
    model = lm.LogBilinear(2, 2, share)
    assert np.abs(model.flat()).max() < 100 and model.q[3, -1] == lm.EMPTY
    model.load(model.flat())
    assert model.q[3, -1] == lm.EMPTY and (model.q[:3, -1] > -10).all()


def test_slopes_by_class_are_those_of_single_entries():
    """A dimension at a time, without a bin for each entry of each vector; the same floats."""
    rng = np.random.default_rng(3)
    x, back, c = rng.integers(0, 40, (300, lm.CONTEXT)), rng.normal(size=(300, lm.DIM)).astype(np.float32), rng.normal(size=(lm.CONTEXT, lm.DIM)).astype(np.float32)
    entry = (x * lm.DIM)[:, :, None] + np.arange(lm.DIM)
    want = np.bincount(entry.ravel(), (back[:, None] * c).ravel(), 50 * lm.DIM).reshape(50, lm.DIM).astype(np.float32)
    assert np.array_equal(lm._by_class(x, back, c, 50), want)
