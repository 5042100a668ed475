"""License scans by Dice coefficient over word bigrams. DataFrame operations only.

A text is cut into segments at line ends and sentence ends. Its units are all runs of segments, so a notice is found on
one line, wrapped over many, behind comment marks and between other text. A unit's normalised words are compared to license
templates by the Dice coefficient of their bigram sets. A template is a candidate for a unit only if their sizes allow
the limit, and for a text only if the text holds as many of its bigrams as the smallest such unit must share. Before
any word is cut out, texts without an anchor word are passed over: anchors are chosen so that a unit without any of them
cannot share enough bigrams with any template.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE
from .line_quality import fence

LIMIT = 0.8
#: License notices as their publishers word them; fixed values.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "Apache-2.0-text": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
}

#: Notices that stand at the head of source files, and complete texts of the licenses that fit a screen.
WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, "
    "either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
    "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. "
    "You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
FULL_TEXTS = {
    "GPL-3.0-notice": GNU.format("General Public License", 3),
    "GPL-2.0-notice": GNU.format("General Public License", 2),
    "AGPL-3.0-notice": GNU.format("Affero General Public License", 3),
    "LGPL-2.1-notice": GNU.format("Lesser General Public License", 2.1),
    "Apache-2.0-full-notice": (
        TEMPLATES["Apache-2.0-text"] + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions '
        "and limitations under the License."
    ),
    "MPL-2.0-text": (
        TEMPLATES["MPL-2.0"] + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Zlib-full": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "MIT-full": (
        "MIT License Copyright (c) " + TEMPLATES["MIT-text"] + " The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-full": (
        TEMPLATES["ISC-text"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause-full": REDISTRIBUTION + WARRANTY,
    "BSD-3-Clause-full": (
        REDISTRIBUTION + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission. " + WARRANTY
    ),
}


A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER, WORD = str.maketrans(A_Z, a_z), re.compile("[a-z0-9.]*[a-z0-9]")


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a text after normalisation; one word stands for itself."""
    words = WORD.findall(text.translate(LOWER))
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}) if len(words) > 1 else words


def least_shared(n: int, limit: float = LIMIT) -> int:
    """The fewest bigrams that any unit reaching the limit shares with a template of n: that of the smallest such unit."""
    return math.ceil(round(n * limit / (2 - limit), 9))


def most_words(text: str, limit: float = LIMIT) -> int:
    """The words of the longest unit that is compared with a template: its own by the ratio of sizes that the limit allows."""
    return math.floor(round(len(WORD.findall(text.translate(LOWER))) * (2 - limit) / limit, 9))


def anchors(templates: dict[str, str], limit: float = LIMIT) -> list[str]:
    """Words such that bigrams without any of them are too few to reach the limit, for every template.

    Chosen one by one: the word in most bigrams of the templates that can still be reached without, ties by name.
    """
    chosen: list[str] = []
    while True:
        short = []
        for t in templates.values():
            own = [g.split() for g in bigrams(t)]
            free = [g for g in own if not set(g) & set(chosen)]
            if own and len(free) >= least_shared(len(own), limit):
                short.append(free)
        if not short:
            return sorted(chosen)
        counts: dict[str, int] = {}
        for free in short:
            for w in {w for g in free for w in g if len(w) > 3} or {w for g in free for w in g}:
                counts[w] = counts.get(w, 0) + sum(w in g for g in free)
        chosen.append(min(counts, key=lambda w: (-len(w) if len(w) > 5 else 0, -counts[w], w)))


def _any_word(words: list[str]) -> str:
    """A pattern for any of the words, A-Z as a-z, as a whole word. Words that begin alike share their beginning, so that
    a place in a text is tested once for all of them."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        ways = [re.escape(c) + pattern(x) for c, x in sorted(at.items()) if c]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)})" + "?" * ("" in at)

    return f"(?i)(?<![a-z0-9.])(?=[{''.join(sorted({w[0] for w in words}))}]){pattern(tree)}(?![a-z0-9])"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, limit: float = LIMIT) -> DataFrame:
    """(doc_id, license, score, unit) for each row of docs (doc_id, text; others ignored).

    license is the template with the highest score at limit or above, of ties the first by name, null without any;
    score (double) is its Dice coefficient rounded to 6 places. unit is the run of segments that matched, joined by
    spaces: of ties the one with the fewest segments that hold a word, then the first. Segments end at \\n and at white
    space after one of .!?:; and units are of at most `most_words` words for a template. Normalised: A-Z lower-cased,
    words of letters, digits and inner points. Null and empty texts have no license; repeated rows are judged alike;
    empty input gives no rows. Texts of any length are read whole; a text with a template's bigrams is compared with it
    from each segment that holds one, so that time grows with the text. Templates have two words or more.
    """
    templates = TEMPLATES | FULL_TEXTS if templates is None else templates
    grams = {k: bigrams(t) for k, t in sorted(templates.items())}
    if any(" " not in (g or [""])[0] for g in grams.values()):
        raise ValueError("a template has two words or more")
    c, text = F.col, F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.when(text.rlike(_any_word(anchors(templates, limit))), text).alias("t__"))
    cut = lambda x: F.split(x, f"(?<=[.!?:;])[{SPACE}]+", -1)
    rows = fence(rows, parts__=F.flatten(F.transform(F.split("t__", "\n", -1), cut))).drop("t__")
    shape = lambda x: F.regexp_extract_all(F.translate(x, A_Z, a_z), F.lit(WORD.pattern), F.lit(0))
    words = F.flatten(F.transform("parts__", lambda x, i: F.transform(shape(x), lambda w: F.struct(w.alias("w"), i.alias("p")))))
    rows = fence(rows, words__=words)
    two = F.transform(F.slice("words__", 1, F.greatest(F.size("words__") - 1, F.lit(0))), lambda x, i: F.concat(x["w"], F.lit(" "), F.get("words__", i + 1)["w"]))
    rows = fence(rows, two__=two)
    # bigrams of any template; for each template how many of its own the text holds
    known = F.array_intersect("two__", F.array(*map(F.lit, sorted(set().union(*grams.values())))))
    rows = fence(rows, known__=known)
    own = [F.array(*map(F.lit, g)) for g in grams.values()]
    fits = [F.when(F.size(F.array_intersect("known__", g)) >= least_shared(len(n), limit), F.lit(i)) for i, (g, n) in enumerate(zip(own, grams.values(), strict=True))]
    rows = fence(rows, may__=F.when(F.size("known__") > 0, F.array_compact(F.array(*fits)))).drop("known__")
    rows = rows.withColumn("may__", F.when(F.size("may__") > 0, c("may__")))
    # a segment is named by its first word; those without words are no part of any unit's bounds
    at = lambda name, i: F.get(name, i)
    starts = F.filter(F.sequence(F.lit(0), F.size("words__") - 1), lambda i: (i == 0) | (at("words__", i)["p"] != at("words__", i - 1)["p"]))
    rows = fence(rows, starts__=F.when(c("may__").isNotNull(), starts))
    rows = fence(rows, ends__=F.concat(F.slice("starts__", 2, F.size("starts__")), F.array(F.size("words__"))))
    sizes, most = [len(g) for g in grams.values()], [most_words(templates[k], limit) for k in grams]
    table, n_of, most_of, names = F.array(*own), F.array(*map(F.lit, sizes)), F.array(*map(F.lit, most)), F.array(*map(F.lit, grams))

    def units(t: Column) -> Column:
        """(score, license, segments, first, start, end) of the units of one text that reach the limit for template t."""
        g, n, longest = at(table, t), at(n_of, t), at(most_of, t)
        least = F.ceil(n * F.lit(round(limit / (2 - limit), 12)) - 1e-9).cast("int")
        first = F.filter(F.sequence(F.lit(0), F.size("starts__") - 1), lambda k: F.arrays_overlap(F.slice("two__", at("starts__", k) + 1, at("ends__", k) - at("starts__", k)), g))
        last = lambda k: F.filter(F.slice("ends__", k + 1, longest), lambda e: (e - at("starts__", k) > least) & (e - at("starts__", k) <= longest))

        def scored(k: Column, e: Column, i: Column) -> Column:
            b = F.array_distinct(F.slice("two__", at("starts__", k) + 1, e - at("starts__", k) - 1))
            return F.struct((-F.round(2.0 * F.size(F.array_intersect(b, g)) / (F.size(b) + n), 6)).alias("s"), at(names, t).alias("l"), at("starts__", k).alias("a"), e.alias("e"), k.alias("k"))

        return F.filter(F.flatten(F.transform(first, lambda k: F.transform(last(k), lambda e, i: scored(k, e, i)))), lambda x: x["s"] <= -limit)

    rows = fence(rows, found__=F.flatten(F.transform("may__", units))).drop("two__", "may__")
    rank = F.transform("found__", lambda x: F.struct(x["s"].alias("s"), x["l"].alias("l"), (F.array_position("ends__", x["e"]) - x["k"]).alias("n"), x["a"].alias("a"), x["e"].alias("e")))
    rows = fence(rows, best__=F.array_min(rank)).drop("found__", "starts__", "ends__")
    p, q = at("words__", c("best__.a"))["p"], at("words__", c("best__.e") - 1)["p"]
    unit = F.when(c("best__").isNotNull(), F.array_join(F.slice("parts__", p + 1, q - p + 1), " "))
    return rows.select("doc_id", c("best__.l").alias("license"), (-c("best__.s")).alias("score"), unit.alias("unit"))


def _oracle() -> str:
    """All units of texts that hold enough of a template's bigrams, without anchors."""
    given = TEMPLATES | FULL_TEXTS
    values = ", ".join("('{}', [{}], {})".format(k, ", ".join(f"'{g}'" for g in bigrams(t)), most_words(t)) for k, t in sorted(given.items()))
    return rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t FROM documents),
s AS (SELECT r, string_split_regex(regexp_replace(replace(t, chr(10), chr(1)), '([.!?:;])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), '\x01') parts FROM d),
l AS (SELECT r, unnest(parts) u, generate_subscripts(parts, 1) p FROM s),
w AS (SELECT r, p, regexp_extract_all(translate(u, '{A_Z}', '{a_z}'), '{WORD.pattern}') w FROM l),
v AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT a,
  row_number() OVER (PARTITION BY r ORDER BY p) k FROM w WHERE len(w) > 0),
x AS (SELECT r, flatten(list(w ORDER BY p)) w FROM v GROUP BY r),
y AS (SELECT r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) g FROM x),
t(license, h, most) AS (VALUES {values}),
c AS (SELECT y.r, g, license, h, most FROM y, t WHERE 2 * len(list_intersect(list_distinct(g), h)) * (2 - {LIMIT}) >= 2 * len(h) * {LIMIT} - 1e-9),
z AS (SELECT c.r, license, i.k, i.a, i.p p, j.p q, j.a + len(j.w) e, j.k - i.k + 1 n, list_distinct(g[i.a + 1:j.a + len(j.w) - 1]) b, h
  FROM c JOIN v i ON i.r = c.r JOIN v j ON j.r = c.r AND j.k >= i.k AND j.a + len(j.w) - i.a <= most),
f AS (SELECT *, round(2.0::DOUBLE * len(list_intersect(b, h)) / (len(b) + len(h)), 6) score FROM z WHERE len(b) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, license, n, a) rank FROM f WHERE score >= {LIMIT})
SELECT doc_id, license, score, array_to_string(parts[p:q], ' ') unit FROM d JOIN s ON d.r = s.r LEFT JOIN o ON d.r = o.r AND rank = 1
"""


ORACLE = _oracle()
