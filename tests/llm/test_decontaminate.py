import math
import random

from sigmill.llm import decontaminate as d

ITEMS = [(1, "What is the speed of light in vacuum near the old stone bridge? It is about three hundred thousand kilometres a second."), (2, "Single sentence item with quite a few words in it for the index to hold"), (3, None), (None, "no id here at all"), (4, ""), (5, "Which of these rivers is longest in the world? The Nile river is."), (6, "tiny item")]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS score")


def filler(n, seed=0):
    rng = random.Random(seed)
    return " ".join(f"f{rng.randrange(5000)}" for _ in range(n))


def test_finds_whole_and_reworded_items_anywhere(spark, docs_of):
    one, two, five = ITEMS[0][1], ITEMS[1][1], ITEMS[5][1]
    rows = [(i, f"{filler(at, i)} {one} {filler(500, i)}") for i, at in enumerate((0, 1, 15, 16, 17, 31, 32, 100, 1000))]
    rows += [(20, two.upper()), (21, two.replace(" ", "\n\t")), (22, one.replace("light", "LIGHT,") + "!"), (23, f"{five}\n{two}"), (24, "a tiny item here")]
    rows += [(30, filler(3000)), (31, None), (32, ""), (33, "What is the speed of light"), (34, one[:60] + filler(40)), (None, two), (35, two), (35, two)]
    got = sorted(((r.doc_id, r.item_id) for r in d.leaks(docs_of(rows), items(spark)).collect()), key=repr)
    assert got == sorted([(i, 1) for i in range(9)] + [(20, 2), (21, 2), (22, 1), (23, 5), (23, 2), (24, 6), (None, 2), (35, 2), (35, 2)], key=repr)
    kept = d.without_leaks(docs_of(rows), items(spark))
    assert sorted(r.doc_id for r in kept.collect()) == [30, 31, 32, 33, 34]


def test_search_equals_exhaustive_scoring():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    index = d.Index([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(40)])
    for _ in range(200):
        terms = sorted({index.term[w] for w in (rng.choice(words) for _ in range(rng.randrange(1, 25))) if w in index.term})
        for least in (0.2, 0.5, 0.8):
            full = {}
            for (t, _), postings in index.lists.items():
                if t in terms:
                    for doc, x in postings:
                        full[doc] = full.get(doc, 0) + x
            want = {doc for doc, x in full.items() if x >= least + 1e-9}
            got = {doc for b in range(index.blocks) for doc, _ in index.search(terms, b, least)}
            assert want <= got <= {doc for doc, x in full.items() if x >= least - 1e-9}


def brute(rows, items, step):
    """Every window against every item: BM25 of all terms, then the overlaps."""
    words = {i: d.words_of(t) for i, t in items if i is not None and t and d.words_of(t)}
    mean = sum(map(len, words.values())) / len(words)
    impact = {}
    for i, ws in words.items():
        raw = {}
        for w in set(ws):
            n, f = sum(w in x for x in words.values()), ws.count(w)
            raw[w] = math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        impact[i] = {w: x / sum(raw.values()) for w, x in raw.items()}
    out = {}
    for doc, text in rows:
        ws = d.words_of(text or "")
        for at in range(0, len(ws) + step, step):
            window = ws[at : at + 2 * step]
            for i, text_i in ((i, dict(items)[i]) for i in words):
                score = sum(x for w, x in impact[i].items() if w in window)
                question, answer = d.question_answer(text_i)

                def share(part, n):
                    have = {tuple(window[k : k + n]) for k in range(max(1, len(window) - n + 1))}
                    want = {tuple(part[k : k + n]) for k in range(max(1, len(part) - n + 1))}
                    return len(want & have) / len(want)

                parts = [share(p, 5 if len(p) >= 10 else 1) for p in (question, answer)]
                if score >= 0.7 and share(words[i], min(5, len(words[i]))) >= 0.8 and min(parts) >= 0.4:
                    out[doc, i] = max(out.get((doc, i), 0), round(score, 9))
    return out


def test_leaks_match_brute_force(spark, docs_of):
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(80)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    tests = [(i, f"{some(rng.randrange(3, 25))}? {some(rng.randrange(1, 12))}.") for i in range(30)] + [(40, "v1 v2"), (41, "v3")]
    rows = []
    for doc in range(120):
        words = tests[doc % 30][1].split()
        for _ in range(doc % 4):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((doc, f"{some(doc % 50)} {' '.join(words[: len(words) - doc % 3])} {some(40)}"))
    step = max(16, *(len(d.words_of(t)) for _, t in tests))
    want = brute(rows, tests, step)
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in d.leaks(docs_of(rows), items(spark, tests)).collect()}
    assert got == want and 30 < len({i for i, _ in want}) < 120


def test_an_item_with_a_short_answer_leaks_with_one_word_replaced(spark, docs_of):
    one = "Which of the many rivers that flow through the old town is the longest of all in the country? The Nile river is."
    rows = [(1, f"{filler(30)} {one.replace('Nile', 'Amazon')} {filler(30)}"), (2, f"{filler(30)} {one[:-4]} {filler(9)}")]
    assert {r.doc_id for r in d.leaks(docs_of(rows), items(spark, [(1, one)])).collect()} == {1, 2}


def test_shards_and_passes_find_the_same_with_the_same_scores(spark, docs_of, monkeypatch):
    docs = docs_of([(1, ITEMS[0][1]), (2, ITEMS[1][1]), (3, "clean text")])
    found = lambda: {(r.doc_id, r.item_id, round(r.score, 9)) for r in d.leaks(docs, items(spark)).collect()}
    whole = found()
    monkeypatch.setattr(d, "SHARD_BYTES", 50)
    monkeypatch.setattr(d, "PASS_BYTES", 100)
    passes = list(d.indexes(items(spark)))
    assert len(passes) > 1 and max(map(len, passes)) == 2
    assert found() == whole and {(x, y) for x, y, _ in whole} == {(1, 1), (2, 2)}
    assert [r.doc_id for r in d.without_leaks(docs, items(spark)).collect()] == [3]


def test_empty_tables(spark, docs_of):
    assert d.leaks(docs_of([]), items(spark)).collect() == []
    assert d.leaks(docs_of([(1, "a b c")]), items(spark, [])).collect() == []
    assert d.without_leaks(docs_of([(1, "a b c")]), items(spark, [])).count() == 1
