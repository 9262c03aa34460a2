"""License scans by sentence rules.

A text is cut into lines at line ends and after sentence ends; in these, everything but letters and digits is one
space, so comment marks, quotes and boxes do not matter. A known licence sentence is found wherever it begins and
ends with a line, whatever lines it is wrapped into, with or without an enumerator before it; the longest known one is
taken. It becomes its identifier; other lines between two identifiers leave one gap. The runs of identifiers are then held
against ordered rules, each a sequence of identifiers; a rule takes its identifiers away, so that a longer licence is not
also reported as the shorter ones within it.

Known sentences and rules are parameters; their number is fixed by the caller, not by the data. Texts without any of
the words that known sentences have are not cut, as they could not contain one.

Defined cases: a null or empty text has no sentences and no licence; equal rows give equal rows; an empty
table gives an empty result; very long texts and sentences are scanned whole; further columns do not matter, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, text_or_empty


def plain(sentence: str) -> str:
    """A-Z lower-cased, everything but ASCII letters and digits as one space."""
    return re.sub("[^a-z0-9]+", " ", sentence.translate({c: c + 32 for c in range(65, 91)})).strip()


#: Public licences by SPDX name, and how notices call them.
NAMES = {
    "MIT": ("MIT License", "MIT"), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "ISC": ("ISC License",), "0BSD": ("Zero-Clause BSD License", "BSD Zero Clause License"), "Zlib": ("zlib License",), "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"), "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"), "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"), "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"), "Unlicense": ("Unlicense",), "WTFPL": ("WTFPL",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"), "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"), "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"), "OFL-1.1": ("SIL Open Font License, Version 1.1",), "Artistic-2.0": ("Artistic License 2.0",),
}
#: One-line notices; each may have "the" before the name.
NOTICES = ("Licensed under {}", "Released under {}", "Distributed under {}", "Published under {}", "Available under {}", "This work is licensed under {}", "This project is licensed under {}", "This software is licensed under {}", "This software is released under {}", "This file is licensed under {}", "This program is licensed under {}", "The code is licensed under {}", "License: {}", "Licence: {}")
#: Sentences of public licence texts and of the headers that they ask for.
SENTENCES = {
    "Apache:file": "you may not use this file except in compliance with the License.",
    "Apache:license": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "Apache:copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache:copy ": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "Apache:unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "Apache:see": "See the License for the specific language governing permissions and limitations under the License.",
    "Apache:foundation": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    "Apache:notice": "See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    "Apache:asf": 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License");',
    "MIT:grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT:grant ": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MIT-0:grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "MIT:keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT:keep ": "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    "MIT:asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "MIT:asis ": 'The software is provided "as is", without warranty of any kind',
    "MIT:liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD:use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD:source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD:binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD:name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD:asis": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "BSD:liable": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC:grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD:grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "ISC:asis": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "MPL:subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL:copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MPL:copy ": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense:free": "This is free and unencumbered software released into the public domain.",
    "Unlicense:anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib:asis": "This software is provided 'as-is', without any express or implied warranty.",
    "Zlib:liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "Zlib:grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL:file": "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
}
#: GNU headers differ in the work, the licence and its version.
GNU_WORKS = ("program", "library", "software", "file")
GNU = {"GPL": ("GNU General Public License", ("2", "3")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3")), "AGPL": ("GNU Affero General Public License", ("3",))}


def _known() -> dict[str, str]:
    """Normalised sentence -> identifier; blanks at the end of an identifier only keep the table's keys apart."""
    out = {plain(s): i.strip() for i, s in SENTENCES.items()}
    for spdx, names in NAMES.items():
        out[plain(f"SPDX-License-Identifier: {spdx}")] = f"{spdx}:notice"
        for name in names:
            for notice in NOTICES:
                for the in ("", "the "):
                    out.setdefault(plain(notice.format(the + name)), f"{spdx}:notice")
    for short, (name, versions) in GNU.items():
        out[plain(f"See the {name} for more details.")] = f"{short}:see"
        for work in GNU_WORKS:
            out[plain(f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.")] = "GNU:hope"
            out[plain(f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY")] = "GNU:hope"
            out[plain(f"You should have received a copy of the {name} along with this {work}.")] = f"{short}:copy"
            for v in versions:
                terms = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
                out[plain(terms + f"either version {v} of the License, or (at your option) any later version.")] = f"{short}-{v}:later"
                out[plain(terms + f"version {v} of the License.")] = f"{short}-{v}:only"
                out[plain(terms + f"version {v}.")] = f"{short}-{v}:only"
    for seen in ("If not, see <https://www.gnu.org/licenses/>.", "If not, see <http://www.gnu.org/licenses/>."):
        out[plain(seen)] = "GNU:site"
    return out


def _rules() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(licence, identifiers), tried in this order; the first takes its sentences."""
    out: list = [
        ("Apache-2.0", ("Apache:foundation", "Apache:notice", "Apache:asf", "Apache:file", "Apache:copy", "Apache:unless", "Apache:see")),
        ("Apache-2.0", ("Apache:license", "Apache:file", "Apache:copy", "Apache:unless", "Apache:see")), ("Apache-2.0", ("Apache:license", "Apache:file", "Apache:copy")),
        ("Apache-2.0", ("Apache-2.0:notice", "Apache:file", "Apache:copy")), ("Apache-2.0", ("Apache:license", "Apache:file")), ("Apache-2.0", ("Apache-2.0:notice", "Apache:file")),
        ("Apache-2.0", ("Apache:asf",)), ("Apache-2.0", ("Apache:license",)),
        ("MIT", ("MIT:grant", "MIT:keep", "MIT:asis", "MIT:liable")), ("MIT", ("MIT:grant", "MIT:keep", "MIT:asis")), ("MIT", ("MIT:grant", "MIT:keep")), ("MIT-0", ("MIT-0:grant", "MIT:asis")),
        ("BSD-3-Clause", ("BSD:use", "BSD:source", "BSD:binary", "BSD:name", "BSD:asis", "BSD:liable")), ("BSD-3-Clause", ("BSD:use", "BSD:source", "BSD:binary", "BSD:name")),
        ("BSD-2-Clause", ("BSD:use", "BSD:source", "BSD:binary", "BSD:asis", "BSD:liable")), ("BSD-2-Clause", ("BSD:use", "BSD:source", "BSD:binary")),
        ("ISC", ("ISC:grant", "ISC:asis")), ("ISC", ("ISC:grant",)), ("0BSD", ("0BSD:grant",)), ("MPL-2.0", ("MPL:subject", "MPL:copy")), ("MPL-2.0", ("MPL:subject",)),
        ("Unlicense", ("Unlicense:free", "Unlicense:anyone")), ("Unlicense", ("Unlicense:free",)), ("Zlib", ("Zlib:asis", "Zlib:liable", "Zlib:grant")),
    ]
    for short, (_, versions) in GNU.items():
        for v in versions:
            full = v if "." in v else f"{v}.0"
            for kind, name in (("later", f"{short}-{full}-or-later"), ("only", f"{short}-{full}-only")):
                begin = f"{short}-{v}:{kind}"
                out += [(name, (begin, "GNU:hope", f"{short}:see", f"{short}:copy", "GNU:site")), (name, (begin, "GNU:hope", f"{short}:see", f"{short}:copy")), (name, (begin, "GNU:hope", f"{short}:see")), (name, (begin, "GNU:hope")), (name, (begin,))]
    return tuple(out) + tuple((spdx, (f"{spdx}:notice",)) for spdx in NAMES)


KNOWN, RULES = _known(), _rules()
#: Every known sentence has one of these in its plain form.
KEYWORDS = ("licen", "under", "permi", "software", "redistribut", "warrant", "copyright", "mpl")
#: Stands for one or more unknown lines.
GAP = "|"
#: After these and white space, a line ends; a full stop within a number, such as 4.0, ends none.
SENTENCE_END = r"([.!?;:])[\x20\x09-\x0D]+"
_SEEN = "\x01"


def _one_of(sentences: list[list[str]]) -> str:
    """A pattern for any of the sentences up to the end of a line, the longest first; words stand in a tree by their beginnings."""
    below: dict[str, list[list[str]]] = {}
    for s in sentences:
        if s:
            below.setdefault(s[0], []).append(s[1:])
    ways = [word + ("$" if rest == [[]] else ("(?:[ \n]" + _one_of(rest) + "|$)" if [] in rest else "[ \n]" + _one_of(rest))) for word, rest in below.items()]
    return "(?:" + "|".join(ways) + ")"


def pattern(known: dict[str, str]) -> str:
    """Finds known sentences, as group 1, in lines of plain words; an enumerator may stand before them."""
    return "(?m)^(?:(?:[0-9]{1,2}|[a-z])[ \n])?(" + _one_of([s.split(" ") for s in known]) + ")"


def plain_lines(text: Column) -> Column:
    """The text's lines of plain words, without empty ones."""
    out = F.regexp_replace(ascii_lower(text), SENTENCE_END, "$1\n")
    out = F.regexp_replace(out, r"[^a-z0-9\n]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r" *\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def _code(identifiers: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in identifiers)


def scan(docs: DataFrame, known: dict[str, str] | None = None, rules=RULES) -> DataFrame:
    """doc_id, identifiers (runs of known sentences), found (licences, distinct, in rule order), n_sentences (known).

    ``known`` has identifiers by plain sentence. A text without a word of ``KEYWORDS`` is not cut, unless ``known`` has a sentence without one.
    """
    known = KNOWN if known is None else known
    ids = F.create_map(*[F.lit(x) for s, i in known.items() for x in (s, f"<{i}>")])
    seen = F.split(F.regexp_replace(plain_lines(text_or_empty()), pattern(known), f"{_SEEN}$1{_SEEN}"), _SEEN)
    # enumerators on a line of their own are no gap
    other = lambda part: F.regexp_replace(part, r"(?m)^(?:[0-9]{1,2}|[a-z])$", "").rlike("[a-z0-9]")
    run = F.array_join(F.transform(seen, lambda part, at: F.when(at % 2 == 1, F.element_at(ids, F.translate(part, "\n", " "))).when(other(part), F.lit(GAP)).otherwise(F.lit(""))), "")
    run = F.regexp_replace(F.regexp_replace(run, r"\|+", GAP), r"^\||\|$", "")
    words = KEYWORDS if all(any(k in s for k in KEYWORDS) for s in known) else ("",)
    lower = ascii_lower(text_or_empty())
    may = F.contains(lower, F.lit(words[0]))
    for k in words[1:]:
        may = may | F.contains(lower, F.lit(k))
    rows = docs.select("doc_id", F.when(may, run).otherwise(F.lit("")).alias("identifiers"))
    every = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_code(s)).alias("code")) for name, s in rules])
    start = F.struct(F.col("identifiers").alias("rest"), F.array().cast("array<string>").alias("found"))
    step = lambda a, r: F.struct(
        F.replace(a["rest"], r["code"], F.lit(GAP)).alias("rest"),
        F.when(F.contains(a["rest"], r["code"]), F.array_append(a["found"], r["name"])).otherwise(a["found"]).alias("found"),
    )
    names = F.array_distinct(F.aggregate(every, start, step)["found"])
    # most documents have none; the rules are tried on the others only
    names = F.when(F.col("identifiers") == "", F.array().cast("array<string>")).otherwise(names)
    return rows.select("doc_id", "identifiers", names.alias("found"), F.regexp_count("identifiers", F.lit("<")).cast("long").alias("n_sentences"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "identifiers", F.array_join("found", ",").alias("licenses"), "n_sentences")


def _oracle() -> str:
    ids = ", ".join(f"('{s}', '<{i}>')" for s, i in KNOWN.items())
    codes = ", ".join(f"('{name}', '{_code(s)}')" for name, s in RULES)
    return f"""
WITH RECURSIVE ids(s, id) AS (VALUES {ids}),
rules AS (SELECT row_number() OVER () AS k, name, code FROM (SELECT unnest([{", ".join(f"'{n}'" for n, _ in RULES)}]) AS name, unnest([{", ".join(f"'{_code(s)}'" for _, s in RULES)}]) AS code)),
docs AS (SELECT row_number() OVER () AS n, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
lines AS (SELECT n, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([.!?;:])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), ' *\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS t FROM docs),
parts AS (SELECT n, string_split(regexp_replace(t, '{pattern(KNOWN)}', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM lines),
each AS (SELECT n, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS pos FROM parts WHERE len(p) > 1),
coded AS (SELECT n, pos, CASE WHEN pos % 2 = 1 THEN (SELECT max(id) FROM ids WHERE ids.s = translate(each.s, chr(10), ' ')) WHEN regexp_matches(regexp_replace(s, '(?m)^(?:[0-9]{{1,2}}|[a-z])$', '', 'g'), '[a-z0-9]') THEN '|' ELSE '' END AS c FROM each),
runs AS (SELECT n, regexp_replace(regexp_replace(string_agg(c, '' ORDER BY pos), '\\|+', '|', 'g'), '^\\||\\|$', '', 'g') AS identifiers FROM coded GROUP BY n),
tried AS (SELECT n, identifiers, 0::BIGINT AS k, identifiers AS rest, []::VARCHAR[] AS found FROM runs
          UNION ALL SELECT n, identifiers, r.k, replace(rest, r.code, '|'), CASE WHEN instr(rest, r.code) > 0 AND NOT list_contains(found, r.name) THEN list_append(found, r.name) ELSE found END FROM tried t JOIN rules r ON r.k = t.k + 1)
SELECT d.doc_id, coalesce(t.identifiers, '') AS identifiers, coalesce(array_to_string(t.found, ','), '') AS licenses, coalesce(length(t.identifiers) - length(replace(t.identifiers, '<', '')), 0)::BIGINT AS n_sentences
FROM docs d LEFT JOIN tried t ON t.n = d.n AND t.k = {len(RULES)}
"""


OP7_SQL = _oracle()
