"""The registered queries on small tables, against brute force or the operators' own results."""

import re
import zlib

import numpy as np
import pytest

from sigmill.llm import quality
from sigmill.llm.registry import QUERIES

from .test_decontaminate import ITEMS, filler
from .test_lines import brute as brute_lines
from .test_quality import ROWS as QUALITY_ROWS
from .test_simhash import slow_components, texts as near_texts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def documents(rows):
    return [(i, t, la, s, len(t or "")) for i, t, la, s in rows], DOCS


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_op1(spark, tables):
    rows = [(i, f"some words w{i % 5} w{i % 3} Here", "en", "s") for i in range(40)] + [(50, None, None, None), (51, "", "en", "s"), (None, "unseen W1", "en", "s")]
    got = QUERIES["op1_lm_scores"](spark, tables(documents=documents(rows))).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    learn = [t for i, t, _, _ in rows if crc(i) % 7 != 2]
    counts, n = {}, 0
    for t in learn:
        for w in [*words(t), "\n"]:
            counts[w] = counts.get(w, 0) + 1
            n += 1
    want = []
    for i, t, _, _ in rows:
        own = [*words(t), "\n"]
        want.append((i, crc(i) % 7 == 2, len(own), sum(w in counts for w in own), n, round(sum(np.log10((counts.get(w, 0) + 1) / (n + len(counts) + 1)) for w in own), 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_op2(spark, tables):
    words = {"aa": "banana kanada papaya", "bb": "strengst kwark schrift"}
    rows = [(i, " ".join([words[la]] * (3 + i % 4)), la, "s") for i in range(60) for la in [("aa", "bb")[i % 2]]]
    rows += [(90, None, None, "s"), (91, "123 !", "aa", "s"), (92, "kwark schrift", None, "s"), (None, "papaya kanada", None, "s")]
    got = {r.doc_id: r for r in QUERIES["op2_langid"](spark, tables(documents=documents(rows))).collect()}
    assert len(got) == len(rows) and all(got[i].held_out == (crc(i) % 4 == 2) and 0 <= got[i].score <= 1 for i, *_ in rows)
    assert all(got[i].lang_pred == la for i, _, la, _ in rows[:60]) and got[90].lang_pred == got[91].lang_pred == "und" and got[92].lang_pred == "bb" and got[None].lang_pred == "aa"


def test_op4(spark, tables):
    rows = list(enumerate(near_texts(20))) + [(900, None), (5, "a b"), (5, "a b"), (None, "a b")]
    path = tables(documents=documents([(i, t, "en", "s") for i, t in rows]))
    got = QUERIES["op4_simhash"](spark, path)
    assert found(got.select("doc_id", "fingerprint", "component_id")) == slow_components(rows)


def slow_quality(rows, labels):
    """Statistics, features, ridge, isotonic calibration and interpolation in one piece, without Spark."""
    known = {}
    for i, q, _ in labels:
        if i is not None and crc(i) % 3 != 1 and q in (0, 1):
            known[i] = min(q, known.get(i, 1))
    x = np.array([quality.statistics(t.encode() if t is not None else None) for _, t, *_ in rows])
    y = np.array([known.get(i, np.nan) for i, *_ in rows], float)
    return x, y


def test_op5_matches_a_direct_fit(spark, tables):
    rows = [(i, t, "en", "s") for i, t in QUALITY_ROWS] + [(400, None, "en", "s"), (401, "", "en", "s"), (3, QUALITY_ROWS[3][1], "en", "s"), (None, QUALITY_ROWS[1][1], "en", "s")]
    labels = [(i, int(i % 3 > 0) if i % 7 else 1 - int(i % 3 > 0), 0) for i in range(240)] + [(4, 0, 0), (None, 1, 0), (7, None, 0)]
    path = tables(documents=documents(rows), labels=(labels, "doc_id long, quality int, toxic int"))
    got = {}
    for r in QUERIES["op5_quality"](spark, path).collect():
        got.setdefault(r.doc_id, r)
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (crc(r.doc_id) % 3 == 1) and got[r.doc_id].score == r.score
    x, y = slow_quality(rows, labels)
    use = ~np.isnan(y)
    folds = {r.doc_id: r.fold for r in spark.createDataFrame([(i,) for i, *_ in rows if i is not None], "doc_id long").selectExpr("doc_id", f"pmod(xxhash64(doc_id, 3), {quality.FOLDS}) AS fold").collect()}
    fold = np.array([folds.get(i, -1) for i, *_ in rows])
    fourier = quality.Fourier(x[use].mean(axis=0), x[use].std(axis=0))
    fit = use & (fold > 0)
    z, size = fourier(x[fit]), quality.FEATURES + 1
    weights = np.linalg.solve(z.T @ z / fit.sum() + quality.RIDGE * np.diag([1.0] * quality.FEATURES + [1e-9]) + 1e-12 * np.eye(size), z.T @ y[fit] / fit.sum())
    raw = fourier(x) @ weights
    bins = np.floor((np.clip(raw, quality.LOW, quality.HIGH) - quality.LOW) * quality.BINS)
    own = use & (fold == 0)
    places = np.unique(bins[own])
    n, ones = (np.array([w[own & (bins == b)].sum() for b in places]) for w in (np.ones(len(rows)), np.nan_to_num(y)))
    level = _min_max(ones / n, n)
    want = np.interp(raw, quality.LOW + (places + 0.5) / quality.BINS, np.clip(level, 0.001, 0.999))
    assert np.allclose([got[i].score for i, *_ in rows], want, atol=1e-6)


def _min_max(value, weight):
    """Isotonic regression by its min-max formula."""
    mean = lambda a, b: np.average(value[a : b + 1], weights=weight[a : b + 1])
    k = len(value)
    return np.array([max(min(mean(a, b) for b in range(i, k)) for a in range(i + 1)) for i in range(k)])


def test_op7(spark, tables):
    one, two = ITEMS[0][1], ITEMS[1][1]
    rows = [(1, f"{filler(40)} {one} {filler(60)}", "en", "s"), (2, filler(200), "en", "s"), (3, two, "en", "s"), (4, None, "en", "s"), (None, two, "en", "s")]
    path = tables(documents=documents(rows), benchmark=(ITEMS, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontaminate"](spark, path).collect()}
    assert got == {(1, 1), (3, 2), (None, 2)}


def test_a_very_long_item_changes_nothing_for_the_others(spark, tables):
    rows = [(1, f"{filler(40)} {ITEMS[0][1]} {filler(60)}", "en", "s"), (2, filler(300), "en", "s"), (3, filler(30_000, 7), "en", "s")]
    long = (77, filler(20_000, 7))
    both = [tables(documents=documents(rows), benchmark=(items, "item_id long, text string")) for items in (ITEMS, [*ITEMS, long])]
    got = [{(r.doc_id, r.item_id) for r in QUERIES["op7_decontaminate"](spark, path).collect()} for path in both]
    assert got[0] == {(1, 1)} and got[1] == {(1, 1), (3, 77)}


def test_op10(spark, tables):
    rows = [(i, t) for i, t in ((1, "one line of several words here\nother words in another line"), (2, "one line of several words there\nkept line of its own words"), (3, None), (4, ""), (5, "other words in another line"), (2, "one line of several words there\nkept line of its own words"))]
    path = tables(documents=documents([(i, t, "en", "s") for i, t in rows]))
    got = QUERIES["op10_line_dedup"](spark, path).collect()
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got), key=repr) == sorted(((i, t, n) for i, t, n in brute_lines(rows)), key=repr)


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_docstrings(name):
    assert QUERIES[name].__doc__, f"{name} does not say what it gives"

