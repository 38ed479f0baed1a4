import random

import corpus_pipeline as pipeline
from sigmill.llm.common import materialise

from .test_lines import brute
from .test_mixing import expected as mixed
from .test_simhash import slow_similarity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "which of the seven hills near the harbour carries the oldest lighthouse still in use today"


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(f"word{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.choice('rstuv')}" for _ in range(n))


def corpus():
    rows = [(i, "\n".join(prose(40, f"{i}/{j}") for j in range(3)), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100, rows[3][1], "en", "s0"), (101, rows[4][1] + "\n" + rows[5][1].split("\n")[0], "en", "s1"), (102, "1234 !!", "en", "s1"), (103, None, None, None), (104, "", None, "s2")]
    rows += [(105, f"{prose(30, 'x')} {ITEM} {prose(30, 'y')}", None, "s0"), (106, prose(3000, "long"), "en", None), (None, prose(20, "no id"), "en", "s1"), (107, prose(4, "dup"), "en", "s2"), (107, prose(4, "dup"), "en", "s2")]
    words = prose(400, "near").split(" ")
    near = [" ".join(words), " ".join(["changed", *words[1:]])]
    return rows + [(110, "\n".join(near[0].split(" ")[i] + f" a{i} b c d" for i in range(5)), "en", "s0"), (120, near[0], "en", "s0"), (121, near[1] + " and some more words after it", "en", "s1")]


def lines_left(rows):
    out = []
    for d, text, gone in brute([(r.doc_id, r.text) for r in rows]):
        if gone == 0 or text.split():
            out.append((d, text))
    return sorted(out, key=repr)


def test_stages_do_what_brute_force_does(spark, tables):
    rows = [(i, t, la, s, len(t or "")) for i, t, la, s in corpus()]
    path = tables(documents=(rows, DOCS), benchmark=([(1, ITEM), (2, None)], "item_id long, text string"))
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        docs = materialise(stage(spark, docs, path))
        kept[name] = after = docs.collect()
        assert name == "mixing" or docs.columns == columns
        key = lambda rs: sorted(((r.doc_id, r.text) for r in rs), key=repr)
        if name == "language_id":
            assert key(after) == sorted([(i, t) for i, t, *_ in rows if any(map(str.isalpha, t or ""))], key=repr)
        elif name == "line_dedup":
            assert key(after) == lines_left(before)
            assert all(r.n_chars == len(r.text) for r in after)
            assert 100 not in {r.doc_id for r in after}
        elif name == "simhash_near_dedup":
            rows_left = sorted(((r.doc_id, r.text) for r in before if r.doc_id is not None), key=repr)
            later = {e for d, t in rows_left for e, u in rows_left if e > d and slow_similarity(t or "", u or "") >= 0.8}
            assert {r.doc_id for r in after} == {d for d, _ in rows_left} - later | {None}
            assert 121 in later
            assert sum(r.doc_id == 107 for r in after) == 1
        elif name == "benchmark_decontamination":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {105}
        else:
            assert sorted(((r.doc_id, r.source or "", r.copy) for r in after), key=repr) == mixed([(r.doc_id, r.text, r.source) for r in before])
    assert sorted(map(repr, (tuple(r) for r in pipeline.run(spark, path).select(columns).collect()))) == sorted(map(repr, (tuple(r[c] for c in columns) for r in kept["mixing"])))


def test_empty_documents(spark, tables):
    path = tables(documents=([], DOCS), benchmark=([(1, ITEM)], "item_id long, text string"))
    assert pipeline.run(spark, path).collect() == []


def test_columns_with_the_stages_own_names(spark, tables):
    """Columns of the documents that are called as the operators call theirs pass through every stage, and nothing else changes."""
    names = ["id", "dk", "gone", "text_", "copy_", "mix", "mix_key", "mix_u", "mix_n", "mix_run", "__text", "__id", "__dk", "__gone", "__copy", "__mix", "node", "sig", "mask", "digest", "key", "part", "line", "line_no", "lh", "score", "lang_pred", "item_id", "fp", "n_lines", "n_removed", "rate", "shuffle_key"]
    rows = [(i, t, la, s, len(t or "")) for i, t, la, s in corpus() if i is None or i > 90 or i < 12]
    path = tables(documents=(rows, DOCS), benchmark=([(1, ITEM)], "item_id long, text string"))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    wide = docs.selectExpr("*", *(f"'{n}' AS {n}" for n in names if n not in ("copy",)))
    for name, stage in pipeline.STAGES:
        docs, wide = materialise(stage(spark, docs, path)), materialise(stage(spark, wide, path))
        assert sorted(map(repr, docs.collect())) == sorted(map(repr, wide.select(docs.columns).collect()))
        if name != "mixing":
            assert wide.filter("__id <> '__id' or mix_u <> 'mix_u' or gone <> 'gone' or digest <> 'digest' or node <> 'node'").count() == 0
