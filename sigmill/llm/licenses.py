"""Licence scan by sentence rules: known sentences become identifiers, sequences of identifiers match licence rules."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm.common import table

# Licences by their SPDX identifiers, and the names that a reference gives them (normalised as sentences are).
NAMES = {
    "MIT": ["mit license"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu gpl version 2", "gpl v2"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu gpl version 3", "gpl v3"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "lgpl v2 1"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "lgpl v3"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "agpl v3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license"],
    "ISC": ["isc license"],
    "Zlib": ["zlib license"],
    "BSL-1.0": ["boost software license version 1 0"],
    "Unlicense": ["unlicense"],
    "Artistic-2.0": ["artistic license 2 0"],
    "CC0-1.0": ["cc0 1 0", "creative commons zero v1 0 universal license", "cc0 1 0 universal public domain dedication"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"],
}
#: What a sentence that refers to a licence by name says before the name.
REFERENCES = ["licensed under", "released under", "distributed under", "this project is licensed under", "this work is licensed under", "this software is licensed under"]

# Sentences of public licences, normalised (lower case, other than letters and digits as one space).
TEXTS = {
    "the mit license mit": "mit-title",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "licensed under the apache license version 2 0 the license": "apache2-head",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2-grant",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "see the gnu affero general public license for more details": "agpl-see",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl-copy",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-copy",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu-verbatim",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-form",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-made",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertise",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc-liability",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": "zlib-origin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib-altered",
    "this notice may not be removed or altered from any source distribution": "zlib-notice",
    "boost software license version 1 0 august 17th 2003": "bsl1-title",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl1-grant",
    "distributed under the boost software license version 1 0": "bsl1-head",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-anyone",
    # bodies
    "apache license version 2 0 january 2004 http www apache org licenses": "apache2-title",
    "terms and conditions for use reproduction and distribution": "apache2-terms",
    "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document": "apache2-definition",
    "grant of copyright license": "apache2-copyright-grant",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form": "apache2-copyright",
    "grant of patent license": "apache2-patent-grant",
    "submission of contributions": "apache2-contributions",
    "this license does not grant permission to use the trade names trademarks service marks or product names of the licensor except as required for reasonable and customary use in describing the origin of the work and reproducing the content of the notice file": "apache2-marks",
    "unless required by applicable law or agreed to in writing licensor provides the work and each contributor provides its contributions on an as is basis without warranties or conditions of any kind either express or implied including without limitation any warranties or conditions of title non infringement merchantability or fitness for a particular purpose": "apache2-disclaimer",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "gpl3-preamble",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "the licenses for most software are designed to take away your freedom to share and change it": "gpl2-preamble",
    "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users": "gpl2-contrast",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software": "agpl3-preamble",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21-title",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below": "lgpl3-body",
    "mozilla public license version 2 0": "mpl2-title",
    "each contributor hereby grants you a world wide royalty free non exclusive license": "mpl2-grant",
    "covered software is provided under this license on an as is basis without warranty of any kind either expressed implied or statutory including without limitation warranties that the covered software is free of defects merchantable fit for a particular purpose or non infringing": "mpl2-warranty",
    "eclipse public license v 2 0": "epl2-title",
    "the accompanying program is provided under the terms of this eclipse public license agreement": "epl2-agreement",
    "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement": "epl2-acceptance",
    "do what the fuck you want to public license": "wtfpl-title",
    "you just do what the fuck you want to": "wtfpl-grant",
    "this work is dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}


def by_name(names: dict[str, list[str]] = NAMES, references: list[str] = REFERENCES) -> tuple[dict[str, str], list[tuple]]:
    """Sentences that refer to a licence by its name or its SPDX identifier, and their rules."""
    sentences, rules = {}, []
    for licence, known in names.items():
        sentences[f"spdx license identifier {_plain(licence)}"] = f"{licence}-ref"
        for name in known:
            article = "a" if name.startswith("creative commons") else "the"
            for reference in references:
                sentences |= {f"{reference} {name}": f"{licence}-ref", f"{reference} {article} {name}": f"{licence}-ref"}
        rules.append((licence, "reference", [f"{licence}-ref"]))
        if licence.endswith("-only"):  # the same identifier with later versions
            later = licence.replace("-only", "-or-later")
            sentences[f"spdx license identifier {_plain(later)}"] = f"{later}-ref"
            rules.append((later, "reference", [f"{later}-ref"]))
    return sentences, rules


def _plain(text: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


#: (licence, kind, sentences in order, nothing known between them); a text's first rule of a licence names its kind.
TEXT_RULES = [
    ("MIT", "text", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", "text", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", "notice", ["mit-title", "mit-grant"]),
    ("Apache-2.0", "text", ["apache2-head", "apache2-comply", "apache2-copy", "apache2-warranty", "apache2-see"]),
    ("Apache-2.0", "text", ["apache2-grant", "apache2-copy", "apache2-warranty", "apache2-see"]),
    ("Apache-2.0", "notice", ["apache2-grant"]),
    ("Apache-2.0", "notice", ["apache2-head"]),
    ("Apache-2.0", "body", ["apache2-title", "apache2-terms"]),
    ("Apache-2.0", "body", ["apache2-copyright-grant", "apache2-copyright"]),
    ("Apache-2.0", "body", ["apache2-copyright"]),
    ("Apache-2.0", "body", ["apache2-disclaimer"]),
    ("GPL-3.0-only", "body", ["gpl3-title", "gnu-verbatim", "gpl3-preamble"]),
    ("GPL-3.0-only", "body", ["gpl3-preamble"]),
    ("GPL-2.0-only", "body", ["gpl2-title", "gnu-verbatim", "gpl2-preamble", "gpl2-contrast"]),
    ("GPL-2.0-only", "body", ["gpl2-preamble", "gpl2-contrast"]),
    ("AGPL-3.0-only", "body", ["agpl3-title", "gnu-verbatim", "agpl3-preamble"]),
    ("AGPL-3.0-only", "body", ["agpl3-preamble"]),
    ("LGPL-3.0-only", "body", ["lgpl3-title", "gnu-verbatim", "lgpl3-body"]),
    ("LGPL-3.0-only", "body", ["lgpl3-body"]),
    ("LGPL-2.1-only", "body", ["lgpl21-title", "gnu-verbatim"]),
    ("MPL-2.0", "body", ["mpl2-grant"]),
    ("MPL-2.0", "body", ["mpl2-warranty"]),
    ("EPL-2.0", "body", ["epl2-title", "epl2-agreement"]),
    ("EPL-2.0", "body", ["epl2-agreement"]),
    ("GPL-3.0-or-later", "text", ["gpl3-later", "gpl-warranty", "gpl-see"]),
    ("GPL-3.0-or-later", "notice", ["gpl3-later"]),
    ("GPL-2.0-or-later", "text", ["gpl2-later", "gpl-warranty", "gpl-see"]),
    ("GPL-2.0-or-later", "notice", ["gpl2-later"]),
    ("AGPL-3.0-or-later", "text", ["agpl3-later", "gpl-warranty", "agpl-see"]),
    ("AGPL-3.0-or-later", "notice", ["agpl3-later"]),
    ("LGPL-2.1-or-later", "text", ["lgpl21-later", "lgpl-warranty", "lgpl-see"]),
    ("LGPL-2.1-or-later", "notice", ["lgpl21-later"]),
    ("LGPL-3.0-or-later", "text", ["lgpl3-later", "lgpl-warranty", "lgpl-see"]),
    ("LGPL-3.0-or-later", "notice", ["lgpl3-later"]),
    ("MPL-2.0", "text", ["mpl2-form", "mpl2-copy"]),
    ("MPL-2.0", "notice", ["mpl2-form"]),
    ("EPL-2.0", "notice", ["epl2-made"]),
    ("BSD-4-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise"]),
    ("BSD-3-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-2-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "mit-warranty"]),
    ("ISC", "text", ["isc-grant", "isc-warranty", "isc-liability"]),
    ("ISC", "text", ["isc-grant"]),
    ("0BSD", "text", ["0bsd-grant", "isc-warranty", "isc-liability"]),
    ("0BSD", "notice", ["0bsd-grant"]),
    ("Zlib", "text", ["zlib-warranty", "zlib-liability", "zlib-grant", "zlib-origin"]),
    ("Zlib", "notice", ["zlib-grant"]),
    ("BSL-1.0", "text", ["bsl1-title", "bsl1-grant"]),
    ("BSL-1.0", "notice", ["bsl1-head"]),
    ("Unlicense", "text", ["unlicense-grant", "unlicense-anyone"]),
    ("Unlicense", "text", ["unlicense-grant"]),
    ("WTFPL", "text", ["wtfpl-title"]),
    ("LicenseRef-public-domain", "reference", ["public-domain"]),
    ("LicenseRef-all-rights-reserved", "reference", ["all-rights-reserved"]),
]

_SENTENCES, _NAME_RULES = by_name()
SENTENCES = _SENTENCES | TEXTS
RULES = TEXT_RULES + _NAME_RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Sentences that name a holder, and what stands for any: only these words are put in its place.
HOLDERS = [
    ("^neither the name of .* nor the names of (its|their) contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    ("^this software is provided by .* as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    ("^in no event shall .* be liable for any direct indirect incidental", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental"),
    ("^in no event shall .* be liable for any claim damages", "in no event shall the authors or copyright holders be liable for any claim damages"),
]
#: Parts that the known sentences are looked up in, by hash.
BUCKETS = 64


def plain(piece: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(piece, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def without_holder(sentence: Column) -> Column:
    """The sentence with what stands for any holder. Few name one, and all of those begin alike."""
    named = sentence
    for pattern, holder in HOLDERS:
        named = F.regexp_replace(named, pattern, holder)
    begins = [F.startswith(sentence, F.lit(x)) for x in ("neither the name of ", "this software is provided by ", "in no event shall ")]
    return F.when(begins[0] | begins[1] | begins[2], named).otherwise(sentence)


def look_up(sentence: Column, sentences: dict[str, str]) -> Column:
    """The identifier of a normalised sentence, null if it is not known. Of the literal table only the part with the sentence's hash is searched."""
    parts: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for text, name in sentences.items():
        parts[zlib.crc32(text.encode()) % BUCKETS][text] = name
    pairs = lambda part: [F.lit(x) for pair in part.items() for x in pair] or [F.lit(""), F.lit(None).cast("string")]
    return F.try_element_at(F.get(F.array(*(F.create_map(*pairs(p)) for p in parts)), F.pmod(F.crc32(sentence.cast("binary")), F.lit(BUCKETS)).cast("int")), sentence)


def known_sentences(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A sentence ends at a mark and white space, or at an empty line; it may run
    over lines, so each of its lines is looked up as well. The colon of an SPDX
    identifier ends none. A holder's name within a sentence does not matter.
    """
    joined = F.regexp_replace(text, "(?i)(spdx-license-identifier):[ \\t]*", "$1 ")
    ended = F.regexp_replace(joined, "([.!?:;])[ \\t\\r\\n]+", "$1\n\n")
    runs = F.split(ended, "\\n[ \\t\\r]*\\n+")
    pieces = F.flatten(F.transform(runs, lambda s: F.when(F.instr(s, "\n") > 0, F.concat(F.array(s), F.split(s, "\n"))).otherwise(F.array(s))))
    # a step at a time, so that each is worked out once for a sentence
    named = F.transform(F.transform(pieces, plain), without_holder)
    return F.filter(F.transform(named, lambda s: look_up(s, sentences)), lambda x: x.isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple] = RULES) -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_sentences) for every row of ``docs`` with a known sentence.

    ``licenses`` lists ``licence:kind`` of the first rule that matches, for
    each licence, in the order of the rules; it is empty if sentences are known
    but no rule matches. Null and empty texts have no sentences and give no
    row. Repeated rows and null ids give rows of their own; other columns are
    not read.
    """
    table_of_rules = F.array(*(F.struct(F.lit(f"{name}:{kind}").alias("name"), F.lit(f"|{'|'.join(ids)}|").alias("ids")) for name, kind, ids in rules))
    found = docs.select(F.col(id_col).alias("doc_id"), known_sentences(F.col(text_col), sentences).alias("ids")).filter("size(ids) > 0")
    run = F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|"))
    hits = F.transform(F.filter(table_of_rules, lambda r: F.contains(run, r["ids"])), lambda r: r["name"])
    firsts = F.filter(hits, lambda h, i: ~F.exists(F.slice(hits, 1, i), lambda g: F.substring_index(g, ":", 1) == F.substring_index(h, ":", 1)))
    return found.select("doc_id", F.array_join("ids", "|").alias("sentence_ids"), F.array_join(firsts, "|").alias("licenses"), F.size("ids").alias("n_sentences"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan`` of all documents; see there for nulls, repeated rows and empty tables."""
    return scan(table(spark, sf_dir, "documents"))


_PLAIN = f"trim(regexp_replace(translate(p, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
_NAMED = _PLAIN
for _pattern, _holder in HOLDERS:
    _NAMED = f"regexp_replace({_NAMED}, '{_pattern}', '{_holder}')"
_JOINED = "regexp_replace(text, '(?i)(spdx-license-identifier):[ \\t]*', '\\1 ', 'g')"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items()) + "}"
_RULES = "[" + ", ".join(f"{{'name': '{n}:{k}', 'ids': '|{'|'.join(ids)}|'}}" for n, k, ids in RULES) + "]"

OP3_SQL = f"""
WITH runs AS (SELECT doc_id, unnest(string_split_regex(regexp_replace({_JOINED}, '([.!?:;])[ \\t\\r\\n]+', '\\1\n\n', 'g'), '\\n[ \\t\\r]*\\n+')) AS s,
                     generate_subscripts(string_split_regex(regexp_replace({_JOINED}, '([.!?:;])[ \\t\\r\\n]+', '\\1\n\n', 'g'), '\\n[ \\t\\r]*\\n+'), 1) AS i FROM documents),
pieces AS (SELECT doc_id, i, unnest(list_concat([s], CASE WHEN contains(s, '\n') THEN string_split(s, '\n') ELSE [] END)) AS p,
                  generate_subscripts(list_concat([s], CASE WHEN contains(s, '\n') THEN string_split(s, '\n') ELSE [] END), 1) AS j FROM runs),
ids AS (SELECT doc_id, i, j, ({_MAP})[{_NAMED}] AS id FROM pieces),
seqs AS (SELECT doc_id, string_agg(id, '|' ORDER BY i, j) AS sentence_ids, CAST(count(*) AS INTEGER) AS n_sentences FROM ids WHERE id IS NOT NULL GROUP BY doc_id),
hits AS (SELECT doc_id, sentence_ids, n_sentences, list_transform(list_filter({_RULES}, lambda r: contains('|' || sentence_ids || '|', r.ids)), lambda r: r.name) AS h FROM seqs)
SELECT doc_id, sentence_ids, n_sentences,
       array_to_string(list_filter(h, lambda x, i: len(list_filter(h[1:i - 1], lambda g: split_part(g, ':', 1) = split_part(x, ':', 1))) = 0), '|') AS licenses
FROM hits
"""
