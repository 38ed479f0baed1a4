import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest

from sigmill.llm import interactions
from sigmill.llm.interactions import audit, contract, selections, tensors_of

LABELS = "doc_id long, quality int, toxic int"


def words(rng, n, kinds):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def rows():
    rng = random.Random(5)
    texts = [words(rng, rng.choice((3, 49, 50, 80)), rng.choice((4, 1000))) + rng.choice(("", " #", " ABC" * 5, " A|B")) for _ in range(40)]
    out = [(i, rng.choice(texts), "en", rng.choice(("a", "b", None, ""))) for i in range(200)]
    long = " ".join(f"x{i}" for i in range(30_000))
    return out + [(300, None, "en", "a"), (301, "", "en", None), (302, "\x0b \n\t\x0c", "en", "a"), (303, "É" * 60, "en", "c"), (304, long, "en", "c"), (305, long, "en", "c"), (None, texts[0], "en", "a"), (5, out[5][1], "en", "b"), (5, out[6][1], "en", "b"), (0, out[0][1], "en", out[0][3])]


def labels():
    rng = random.Random(6)
    return [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 320, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, _, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {k for k, f in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t])) if f}
        docs.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            all_, gone = left, []
            for s, x in enumerate(order, 1):
                removed = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                out[part, "".join(order), s] = [len(left), len(removed), sum(x in d[1] for d in gone), sum(d[1] == {x} for d in all_), sum(d[2] for d in removed), sum(d[3] for d in removed)]
                gone = gone + removed
    for (part, order, s), v in out.items():
        x = order[s - 1]
        v.append(sum(out[part, o, o.index(x) + 1][1] for o in map("".join, permutations("ABCDE"))))
    return sorted((*k, *v) for k, v in out.items())


def run(spark, docs_of, docs, marks):
    df = docs_of(docs).selectExpr("*", "1 AS part", "2 AS pattern", "3 AS n", "4 AS good", "'5' AS digest", "6 AS is_first", "7 AS quality")
    found = audit(df, spark.createDataFrame(marks, LABELS).selectExpr("*", "'a' AS text", "'b' AS source", "1 AS bad"))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(map(tuple, found.collect()))


def test_matches_brute_force(spark, docs_of):
    assert run(spark, docs_of, rows(), labels()) == brute(rows(), labels())


def test_empty_tables_and_many_parts(spark, docs_of, monkeypatch):
    assert run(spark, docs_of, [], labels()) == []
    monkeypatch.setattr(interactions, "PARTS", 2)
    many = [(i, t, la, f"s{i % 9}") for i, t, la, _ in rows() if i is not None]
    assert run(spark, docs_of, many, []) == brute(many, [])


def test_contractions_select_pass_fail_or_all():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 9, (2, 3, 2, 2, 2))
    found = contract(t, selections("ABC"))
    names = [(o, s) for o in interactions.orders("ABC") for s in range(3)]
    assert found.shape == (2, 3, 18)
    assert (found[:, :, names.index(("ABC", 0))] == t[:, :, 1].sum(axis=(2, 3))).all()
    assert (found[:, :, names.index(("CAB", 1))] == t[:, :, 1, :, 0].sum(axis=2)).all()
    assert (found[:, :, names.index(("BCA", 2))] == t[:, :, 1, 0, 0]).all()


def test_tensor_axes_are_the_filters_in_order():
    found = tensors_of([[{"pattern": 1, "n": 5, "good": 2, "toxic": 1}], [{"pattern": 16 + 2, "n": 7, "good": 0, "toxic": 0}]], 5)
    assert found[0, :, 1, 0, 0, 0, 0].tolist() == [5, 2, 1] and found[1, 0, 0, 1, 0, 0, 1] == 7 and found.sum() == 15


@pytest.mark.parametrize("docs", [rows(), [(1, "a", "en", "s")]])
def test_sql_gives_the_same(spark, tables, docs):
    path = tables(documents=([(*r, 1) for r in docs], "doc_id long, text string, lang string, source string, n_chars long"), labels=(labels(), LABELS))
    got = interactions.op13_interactions(spark, path)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet/*.parquet')")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({interactions.OP13_SQL})").fetchall())
