import duckdb

from sigmill.llm import licenses

MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def test_rules_and_edges(docs_of):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, MIT), (2, f"Some prose\nmore prose {apache} no"), (3, f"Some prose.\n{apache}\nmore"), (4, f"{apache} Released under the MIT license! x"), (5, None), (6, ""),
        (7, "word " * 40_000 + ".\nLicensed under CC BY-NC 4.0."), (8, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
        (9, "released under the mit license that nobody knows"), (None, apache), (3, f"Some prose.\n{apache}\nmore"),
    ]
    got = sorted(((r.doc_id, r.licenses, r.n_sentences) for r in licenses.scan(docs_of(rows)).collect()), key=repr)
    assert got == sorted([(1, "MIT:text", 5), (3, "Apache-2.0:reference", 1), (4, "MIT:reference|Apache-2.0:reference", 2), (7, "CC-BY-NC-4.0:reference", 1), (8, "", 1), (None, "Apache-2.0:reference", 1), (3, "Apache-2.0:reference", 1)], key=repr)


def test_order_matters(docs_of):
    sentences = {"one": "a", "two": "b"}
    rules = [("L", "text", ["a", "b"])]
    got = licenses.scan(docs_of([(1, "One. Two."), (2, "Two. One."), (3, "One. other. Two."), (4, "One. One. Two. Two.")]), sentences=sentences, rules=rules).collect()
    assert {r.doc_id: r.licenses for r in got} == {1: "L:text", 2: "", 3: "L:text", 4: "L:text"}


def test_names_and_identifiers(docs_of):
    rows = [
        (1, "// SPDX-License-Identifier: LGPL-3.0-or-later\ncode"), (2, "This software is licensed under the BSD 3-Clause License."), (3, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        (4, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
        (5, "Released under the GNU GPL version 2."), (6, "All rights reserved."), (7, "licensed under a license of some kind."),
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan(docs_of(rows)).collect()}
    assert got[2] == "BSD-3-Clause:reference" and got[3] == "CC-BY-SA-4.0:reference" and got[5] == "GPL-2.0-only:reference" and got[6] == "LicenseRef-all-rights-reserved:reference" and 7 not in got
    assert got[1] == "LGPL-3.0-or-later:reference"
    assert got[4].startswith("MPL-2.0:")


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

{binary}

{endorse}

THIS SOFTWARE IS PROVIDED BY {holder} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""


def test_any_holder_and_bodies(docs_of):
    binary = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    endorse = "Neither the name of the {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    body = BSD.replace("1. ", "").format
    rows = [
        (1, body(binary=binary, endorse=endorse.format("Example Institute of Things"), holder="Example Institute AND OTHERS")),
        (2, body(binary=binary, endorse="", holder="ANY PERSON")),
        (3, "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n\nThe GNU General Public License is a free, copyleft license for software and other kinds of works."),
        (4, "The accompanying program is provided under the terms of this Eclipse Public License agreement."),
        (5, "Neither the name of the rose."),
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan(docs_of(rows)).collect()}
    assert got == {1: "BSD-3-Clause:text", 2: "BSD-2-Clause:text", 3: "GPL-3.0-only:body", 4: "EPL-2.0:body"}


def test_a_very_long_text(docs_of):
    text = "\n".join(["prose without a mark"] * 20_000) + "\n\n" + MIT
    assert [(r.doc_id, r.licenses) for r in licenses.scan(docs_of([(1, text), (2, text)])).collect()] == [(1, "MIT:text"), (2, "MIT:text")]


def test_every_rule_matches_its_own_sentences(docs_of):
    sentence = {}
    for text, name in licenses.SENTENCES.items():
        sentence.setdefault(name, text)
    rows = [(k, "\n\n".join(sentence[i] + "." for i in ids)) for k, (_, _, ids) in enumerate(licenses.RULES)]
    got = {r.doc_id: r.licenses.split("|") for r in licenses.scan(docs_of(rows)).collect()}
    for k, (name, kind, ids) in enumerate(licenses.RULES):
        first = next(k for n, k, i in licenses.RULES if n == name and f"|{'|'.join(i)}|" in f"|{'|'.join(ids)}|")
        assert f"{name}:{first}" in got[k]


def test_sql_gives_the_same(spark, tables):
    docs = [(1, MIT), (2, None), (3, ""), (4, "Some prose.\nReleased under the Apache License, Version 2.0.\nmore"), (5, "plain"), (6, "SPDX-License-Identifier: Apache-2.0\n\nMIT License. All rights reserved.")]
    path = tables(documents=(docs, "doc_id long, text string"))
    names = ["doc_id", "sentence_ids", "licenses", "n_sentences"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, licenses.op3_licenses(spark, path).select(names).collect())) == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({licenses.OP3_SQL})").fetchall())


def test_empty_table_and_plan(docs_of):
    df = licenses.scan(docs_of([]))
    assert df.collect() == []
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
