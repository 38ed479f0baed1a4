import hashlib
import math

import duckdb

from sigmill.llm import mixing


def inverse_poisson(u, rate):
    k, total = 0, math.exp(-rate)
    while total <= u and rate:
        k += 1
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def expected(rows, weights=None, budget=1.0):
    size = {}
    for i, t, s in rows:
        size[s or ""] = size.get(s or "", 0) + len(t or "")
    w = {s: 1.0 for s in size} if weights is None else {s: weights.get(s, 0.0) for s in size}
    out = []
    for i, t, s in rows:
        s = s or ""
        rate = w[s] / (sum(w.values()) or 1) * budget * sum(size.values()) / size[s] if size[s] else 0.0
        u = int(hashlib.md5(f"17:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
        out += [(i, s, c) for c in range(1, inverse_poisson(u, rate) + 1)]
    return sorted(out, key=repr)


def run(docs_of, rows, **more):
    df = mixing.mix(docs_of([(i, t, "en", s) for i, t, s in rows]), **more)
    return df, sorted(((r.doc_id, r.source or "", r.copy) for r in df.collect()), key=repr)


ROWS = [(i, "x" * (i % 7 + 1), f"s{i % 3 if i % 2 else 0}") for i in range(400)] + [(None, "abc", None), (500, None, "s1"), (501, "", "void"), (7, "again", "s1"), (7, "again", "s1"), (502, "y" * 50_000, "long")]


def test_matches_brute_force(docs_of):
    assert run(docs_of, ROWS)[1] == expected(ROWS)


def test_weights_and_budget(docs_of):
    w = {"s0": 1.0, "s1": 3.0, "absent": 9.0}
    assert run(docs_of, ROWS, weights=w, budget=2.5)[1] == expected(ROWS, w, 2.5)
    assert run(docs_of, ROWS, weights={})[1] == []


def test_shares_come_close_to_the_weights(docs_of):
    rows = [(i, "word " * 20, "big" if i % 10 else "small") for i in range(4000)]
    got = run(docs_of, rows, weights={"big": 0.5, "small": 0.5})[1]
    small = sum(s == "small" for _, s, _ in got)
    assert 0.44 < small / len(got) < 0.56


def test_order_is_shuffled_and_repeatable(docs_of):
    df, _ = run(docs_of, ROWS)
    once, twice = ([(r.doc_id, r.copy) for r in d.collect()] for d in (df, run(docs_of, ROWS)[0]))
    assert once == twice
    assert once != sorted(once, key=repr)


def test_high_rate_and_empty_table(docs_of):
    assert run(docs_of, [])[1] == []
    rows = [(i, "ab", "rare") for i in range(3)] + [(9, "z" * 3000, "big")]
    assert run(docs_of, rows)[1] == expected(rows)


def test_very_high_rates(docs_of):
    rows = [(i, "a", "rare") for i in range(2)] + [(9, "z" * 9_000, "big")]
    df, got = run(docs_of, rows)
    assert got == expected_fast(rows)
    steps = mixing.poisson_steps(df.sparkSession.createDataFrame([("x", 4e6), ("y", 300.0), ("z", 0.0)], "source_key string, rate double")).collect()
    by = {r.source_key: r for r in steps}
    assert len(by["x"].steps) < 50_000 and by["x"].low > 3_900_000 and by["y"].low == 0 and by["z"].low == 0
    assert all(abs(r.steps[-1] - 1) < 1e-6 for r in steps)


def expected_fast(rows):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t)
    out = []
    for i, _, s in rows:
        rate = sum(size.values()) / len(size) / size[s]
        u = int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) / 16**13
        out += [(i, s, c) for c in range(1, inverse_by_logs(u, rate) + 1)]
    return sorted(out, key=repr)


def inverse_by_logs(u, rate):
    total, k = 0.0, 0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if total > u:
            return k
        k += 1


def test_columns_of_any_name_pass(docs_of):
    docs = docs_of([(i, "some text", "en", f"s{i % 2}") for i in range(20)]).selectExpr("*", "'a' AS steps", "5 AS n", "0.5 AS u", "'b' AS source_key", "'c' AS k", "7 AS low")
    found = mixing.mix(docs)
    assert set(docs.columns) <= set(found.columns)
    rows = found.collect()
    assert rows and all((r.steps, r.n, r.source_key, r.k, r.low) == ("a", 5, "b", "c", 7) for r in rows)


def test_sql_gives_the_same(spark, tables):
    docs = [(i, "word " * (i % 9), "en", None if i == 3 else f"s{i % 4}", 5 * (i % 9)) for i in range(200)] + [(900, "x" * 90_000, "en", "long", 90_000), (901, None, None, "void", 0)]
    path = tables(documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    names = ["doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({mixing.OP8_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, mixing.op8_mixing(spark, path).select(names).collect()))) == sorted(map(repr, want))


def test_plan_has_no_python(docs_of):
    plan = mixing.mix(docs_of(ROWS[:5]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
