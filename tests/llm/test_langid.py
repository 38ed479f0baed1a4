import random
import zlib

import numpy as np
import pytest

from sigmill.llm import langid

STEMS = {"aa": ["ka", "mo", "ti", "re"], "bb": ["schu", "wir", "pfen", "ung"], "cc": ["ñe", "llo", "ción", "que"]}


def text(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    return langid.train([(text(lang, 60, i), lang) for lang in STEMS for i in range(30)])


def test_forward_backward_equals_enumeration():
    crf = langid.Crf(["a", "b"], [set(), set()])
    rng = np.random.default_rng(0)
    crf.t = rng.normal(size=(2, 2))
    scores = rng.normal(size=(1, 5, 2))
    mask = np.array([[True, True, True, True, False]])
    paths = [[(p >> i) & 1 for i in range(4)] for p in range(16)]
    weight = np.array([np.exp(sum(scores[0, i, y] for i, y in enumerate(p)) + sum(crf.t[p[i], p[i + 1]] for i in range(3))) for p in paths])
    weight /= weight.sum()
    post, pairs = crf.posteriors(scores, mask)
    for i in range(4):
        assert post[0, i, 1] == pytest.approx(sum(w for w, p in zip(weight, paths) if p[i]))
    for a in range(2):
        for b in range(2):
            assert pairs[a, b] == pytest.approx(sum(w * sum(p[i] == a and p[i + 1] == b for i in range(3)) for w, p in zip(weight, paths)))


def test_labels_words_of_code_switched_text(model):
    words = text("aa", 12, 900).split() + text("cc", 12, 901).split() + text("bb", 12, 902).split()
    found = langid.label_words(model, [words])[0].argmax(axis=1)
    assert (found == np.repeat([0, 2, 1], 12)).mean() > 0.9


def test_long_and_short_texts_are_labelled_alike_in_any_batch(model):
    texts = [text("aa", n, n).split() for n in (1, 63, 64, 65, 700)] + [[]] + [text("bb", 200, 4).split()]
    together = langid.label_words(model, texts)
    for t, p in zip(texts, together):
        alone = langid.label_words(model, [t])[0]
        assert p.shape == (len(t), 3) and np.allclose(p, alone)


def slow_posteriors(model, words):
    """Forward-backward in logarithms, word by word over the whole text."""
    e, t = model.emissions(words), model.t
    n, k = e.shape
    ahead, back = np.zeros((n, k)), np.zeros((n, k))
    ahead[0] = e[0]
    for i in range(1, n):
        ahead[i] = e[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + t, axis=0)
    for i in range(n - 2, -1, -1):
        back[i] = np.logaddexp.reduce(t + e[i + 1] + back[i + 1], axis=1)
    x = ahead + back
    return np.exp(x - np.logaddexp.reduce(x, axis=1, keepdims=True))


@pytest.mark.parametrize("n", [1, 2, 64, 65, 128, 129, 700])
def test_the_chain_runs_over_the_whole_text(model, n):
    words = (text("aa", 100, n) + " " + text("bb", 100, n) + " " + text("cc", 600, n)).split()[100 - n // 2 :][:n]
    other = text("bb", 70, 1).split()
    found = langid.label_words(model, [other, words, [], other])
    assert np.allclose(found[1], slow_posteriors(model, words), atol=1e-9)
    assert np.allclose(found[3], slow_posteriors(model, other), atol=1e-9)


def test_predictions_match_brute_force(docs_of, model):
    rows = [(i, f"{text(a, 20, i)}, {text(b, 5 * (i % 9), i)} {'ß' * (i % 100)}", None, "s") for i in range(60) for a, b in [(list(STEMS)[i % 3], list(STEMS)[i % 2])]]
    want = {}
    for i, t, *_ in rows:
        mean = slow_posteriors(model, langid.LETTERS.findall(t.lower())).mean(axis=0)
        want[i] = (model.labels[int(mean.argmax())], round(float(mean.max()), 9))
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(docs_of(rows), model).collect()} == want


def test_all_letters_of_a_long_run_count(model):
    same = "ka" * 20
    a, b = (model.emissions(langid.LETTERS.findall(same + x)) for x in ("mo" * 300, "schu" * 150))
    assert len(a) == len(b) == 16 and not np.allclose(a, b)
    assert "".join(langid.LETTERS.findall(same + "mo" * 300)) == same + "mo" * 300


def test_rows_without_an_id_and_rows_that_repeat_one_are_learned_from(docs_of):
    rows = [(None, text(lang, 25, i), lang, "s") for i in range(300) for lang in STEMS] + [(7, text("aa", 9, i), "aa", "s") for i in range(300)]
    assert len(langid.sample(docs_of(rows), 20)) == 60
    assert {r.lang_pred for r in langid.identify(docs_of(rows), langid.fitted(docs_of(rows))).collect()} == set(STEMS)
    assert len(langid.sample(docs_of([(7, "same text here", "aa", "s")] * 400), 20)) == 1
    assert [len(t) for t, _ in langid.sample(docs_of([(7, "long " * 30_000, "aa", "s")]))] == [langid.SAMPLE_CHARS]


def test_a_text_of_which_no_language_has_most_is_rejected(docs_of, model):
    mixed = " ".join(text(lang, 40, 77) for lang in STEMS)
    kept = langid.keep_identified(docs_of([(1, mixed), (2, text("aa", 40, 3)), (3, "12 34")]), model).collect()
    assert [r.doc_id for r in kept] == [2]


def test_edges(spark, docs_of, model):
    rows = [(1, text("aa", 30, 1)), (2, None), (3, ""), (4, "123 !? ²"), (5, text("bb", 20_000, 5)), (None, text("cc", 9, 2)), (1, text("aa", 30, 1)), (7, "x" * 5000)]
    got = langid.identify(docs_of(rows), model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by == {1: "aa", 2: "und", 3: "und", 4: "und", 5: "bb", None: "cc", 7: by[7]}
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.keep_identified(docs_of(rows), model, min_score=0.5)
    assert {1, 5, None} <= {r.doc_id for r in kept.collect()} <= {1, 5, None, 7}
    assert langid.identify(docs_of([]), model).collect() == []
    assert {r.lang_pred for r in langid.identify(docs_of(rows), None).collect()} == {"und"}


def test_held_out_accuracy(spark, docs_of):
    rows = [(i, text(lang, 25, i), lang, "s") for i in range(300) for lang in [list(STEMS)[i % 3]]]
    rows += [(1000, text("aa", 9, 1), None, "s")]
    docs = docs_of(rows)
    model = langid.fitted(docs)
    assert model.labels == ["aa", "bb", "cc"]
    truth = {i: lang for i, _, lang, _ in rows}
    held = [r for r in langid.identify(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98


def test_sample_is_bounded_and_only_of_labelled_rows(docs_of):
    docs = docs_of([(i, "a b", "aa" if i % 3 else None, "s") for i in range(500)] + [(501, None, "aa", "s")])
    assert len(langid.sample(docs, 20)) == 20
    assert langid.sample(docs_of([])) == []
