import random

from sigmill.llm import lines


def edit1(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if a == b:
        return True
    if max(len(a), len(b)) < 5:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = [], {}
    done = {}
    for i in order:
        doc, text = rows[i]
        if (doc, text) in done:
            out[i] = done[doc, text]
            continue
        kept, gone = [], 0
        for line in (text or "").split("\n"):
            words = line.encode().lower().split()
            if words and any(edit1(words, s) for s in seen):
                gone += 1
            else:
                kept.append(line)
            if words:
                seen.append(words)
        done[doc, text] = out[i] = (None if text is None else "\n".join(kept), gone)
    return sorted(((rows[i][0], *out[i]) for i in range(len(rows))), key=repr)


def check(docs_of, rows):
    got = lines.dedup_lines(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got), key=repr) == brute(rows)


def test_matches_brute_force(docs_of):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.choice((1, 2, 3, 4, 5, 6, 7, 12, 30)))] for _ in range(60)]

    def vary(b):
        b, i = list(b), rng.randrange(len(b))
        kind = rng.randrange(4)
        if kind == 1:
            b[i] = "new"
        elif kind == 2:
            del b[i]
        elif kind == 3:
            b.insert(i, rng.choice(words))
        return b

    docs = []
    for d in range(50):
        docs.append((d, "\n".join(" ".join(vary(rng.choice(base))) for _ in range(rng.randrange(1, 6)))))
    rng.shuffle(docs)
    check(docs_of, docs)


def test_edges(docs_of):
    long = " ".join(f"l{i}" for i in range(3000))
    check(docs_of, [(1, None), (2, ""), (3, "\n\n"), (4, "A b c d e\n\na B C d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "a b c d x"), (6, long), (7, long + " end"), (8, "a a a a a"), (9, "a a a a"), (10, "a a a a a a"), (11, "one\ttwo  three four five\r"), (12, "one two three four six")])


def test_template_lines_form_one_hot_group(docs_of):
    check(docs_of, [(i, f"page number {i} of the very same report") for i in range(200)])


def test_empty_table(docs_of):
    assert lines.dedup_lines(docs_of([])).collect() == []


def test_columns_pass_through(docs_of):
    docs = docs_of([(1, "a")])
    assert set(lines.dedup_lines(docs).columns) == {*docs.columns, "n_lines"}


def test_a_document_of_many_equal_lines(docs_of):
    text = "the very same line again\n" * 60_000 + "another line of the text"
    (row,) = [r for r in lines.dedup_lines(docs_of([(1, text)])).collect()]
    assert (row.text, row.n_lines, row.n_removed) == ("the very same line again\nanother line of the text", 60_001, 59_999)


def test_columns_of_the_operators_own_names_pass(docs_of):
    docs = docs_of([(1, "a b\na b"), (2, "a b")]).selectExpr("*", "'q' AS line_no", "'r' AS first", "array('s') AS gone")
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert (got[1].text, got[2].text) == ("a b", "")
    assert (got[1].line_no, got[1].first, got[1].gone, got[1].dk, got[1].lh) == ("q", "r", ["s"], "y", "z")
