import dataclasses
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from sigmill.llm import simhash
from sigmill.llm.components import connected_components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=repr)


def texts(n=60):
    rng = random.Random(3)
    words = [f"w{i}é" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice((1, 2, 3, 9, 150, 600)))] for _ in range(n)]
    near = []
    for b in base:
        c = list(b)
        c[rng.randrange(len(c))] = "Changed"
        near += [c, b]
    return [" ".join(x) for x in base + near]


def test_matches_brute_force(docs_of):
    rows = list(enumerate(texts())) + [(900, None), (901, ""), (902, " \t\n"), (903, "A b"), (904, "a\x0bB"), (5, "a b"), (5, "a b"), (None, "a b"), (None, "only here once more"), (905, "x " * 20_000)]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == slow_components(rows)


def nodes_of(spark, fps):
    rows = [(i, f.to_bytes(8, "little"), b"\xff") for i, f in enumerate(fps)]
    return spark.createDataFrame(rows, "node long, sig binary, mask binary")


@pytest.mark.parametrize("block", [2, 5])
def test_blocks_of_long_lists_lose_no_link(spark, block):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = list({base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(64)})
    roots = connected_components(simhash.links(nodes_of(spark, fps), block=block)).collect()
    assert {r.node for r in roots} == set(range(len(fps)))
    assert len({r.root for r in roots}) == 1


@pytest.mark.parametrize("block", [3, 4096])
def test_links_across_a_list_that_its_least_text_does_not_join(spark, block):
    rng = random.Random(6)
    low = rng.getrandbits(24)
    far = [low | rng.getrandbits(40) << 24 for _ in range(20)]  # all share three bytes, few link
    near = [f ^ (1 << 24 + i % 40) for i, f in enumerate(far)]
    fps = far + near
    want = {(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}
    roots = {r.node: r.root for r in connected_components(simhash.links(nodes_of(spark, fps), block=block)).collect()}
    assert want and all(roots[i] == roots[j] for i, j in want)
    assert len(set(roots.values())) == 20


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).collect() == []
    assert simhash.one_of_each(docs_of([])).count() == 0


def test_one_of_each_keeps_one_row(docs_of):
    long = " ".join(f"t{i}" for i in range(200))
    docs = docs_of([(3, long), (1, long), (1, long), (2, long + " more"), (7, "other words here"), (None, "x"), (9, None)])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 7, 9, None]


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (7, 7)], "src long, dst long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}


def test_more_bits_than_the_index_guarantees(docs_of):
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs_of([(1, "a")]), scheme=dataclasses.replace(simhash.NARROW, bits=4))


def slow_similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_copies_of_ordinary_length_go_and_others_stay(docs_of):
    rng = random.Random(8)
    rows, gone = [], set()
    for i in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range((100, 200, 500)[i % 3])]
        near, far = list(words), list(words)
        near[20] = "changed"
        for at in range(5, 95, 6):
            far[at] = f"other{i}"
        if i % 3:
            far[100:] = [f"rest{i}"] * (len(words) - 100)
        rows += [(i, " ".join(words)), (1000 + i, " ".join(near)), (2000 + i, " ".join(far))]
        gone.add(1000 + i)
    kept = {r.doc_id for r in simhash.one_of_each(docs_of(rows)).collect()}
    assert kept == {i for i, _ in rows} - gone


def test_no_link_under_the_similarity_and_most_links_above_it(docs_of):
    rng = random.Random(9)
    rows, near = [], {}
    for i in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(words)
        for _ in range(i % 6 + 1):
            other[rng.randrange(200)] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        near[i] = slow_similarity(rows[-2][1], rows[-1][1]) >= 0.8
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(rows), scheme=simhash.WIDE).collect()}
    found = {i: got[2 * i] == got[2 * i + 1] for i in near}
    assert not any(found[i] for i in near if not near[i])
    assert sum(found[i] for i in near if near[i]) >= 0.95 * sum(near.values())
    assert all(c // 2 == d // 2 for d, c in got.items())


def test_a_large_group_is_one_component(docs_of):
    words = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join([*words[:i], "x", *words[i + 1 :]])) for i in range(300)]
    assert {r.component_id for r in simhash.near_duplicates(docs_of(rows), scheme=simhash.WIDE).collect()} == {0}


def test_empty_and_null_under_the_wide_scheme(docs_of):
    assert simhash.near_duplicates(docs_of([]), scheme=simhash.WIDE).count() == 0
    kept = simhash.one_of_each(docs_of([(1, ""), (2, None), (3, "a b"), (4, "A  b"), (None, "x"), (5, "x " * 20_000)])).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == [1, 3, 5, None]


def test_copies_are_verified_once(spark, docs_of, monkeypatch):
    """Two near texts of many copies each are one pair."""
    words = [f"t{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(["other", *words[1:]])]
    rows = [(i, texts[i % 2]) for i in range(200)]
    asked, similar = [], simhash.similar

    def counted(pairs, texts, scheme):
        ends = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
        asked.append((pairs.count(), texts(ends).count()))
        return similar(pairs, texts, scheme)

    monkeypatch.setattr(simhash, "similar", counted)
    assert {r.component_id for r in simhash.near_duplicates(docs_of(rows), scheme=simhash.WIDE).collect()} == {0}
    assert asked[0] == (1, 2) and all(n <= 1 for n, _ in asked)


def test_columns_with_the_operators_own_names(docs_of):
    long = " ".join(f"t{i}" for i in range(200))
    docs = docs_of([(1, long), (2, long), (3, "x")]).selectExpr("*", "'a' AS id", "'b' AS id_", "'c' AS __text", "1 AS __copy", "'d' AS digest", "2 AS node", "'e' AS sig")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
