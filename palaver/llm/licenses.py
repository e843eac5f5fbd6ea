"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_totals, numbered, staged

# fixed values: the wording of public licences and of the notices that refer to them
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def _gnu(title: str, thing: str, version: int) -> tuple[str, ...]:
    """The header that the licences of this family ask for, by their name, their word for the work and their version."""
    head = f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    tail = f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {title} for more details."
    last = f"You should have received a copy of the {title} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."
    only = f"This work is licensed under the {title}, version {version}."
    title_page = f"{title} Version {version}. Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    return only, f"Licensed under the {title} version {version}.", head, f"{head}\n\n{tail}\n\n{last}", title_page


TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", _MIT.split("\n\n")[0], _MIT),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", _APACHE.split("\n\n")[0], _APACHE),
    "GPL-3.0": (*_gnu("GNU General Public License", "program", 3), "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only"),
    "GPL-2.0": (*_gnu("GNU General Public License", "program", 2), "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-only"),
    "AGPL-3.0": (*_gnu("GNU Affero General Public License", "program", 3), "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only"),
    "LGPL-3.0": (*_gnu("GNU Lesser General Public License", "library", 3), "SPDX-License-Identifier: LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-3.0-only"),
    "LGPL-2.1": (*_gnu("GNU Lesser General Public License", "library", 2), "Licensed under the GNU Lesser General Public License version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", _BSD_HEAD, _BSD_HEAD + _BSD_TAIL),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", _BSD_HEAD.split("\n\n")[0], _BSD_THIRD, _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC", _ISC.split("\n\n")[0], _ISC),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", _BSL.split("\n\n")[0], _BSL),
    "Zlib": ("Released under the zlib License.", "SPDX-License-Identifier: Zlib", _ZLIB),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", _UNLICENSE),
    "MPL-2.0": (_MPL.split(" If ")[0], "SPDX-License-Identifier: MPL-2.0", _MPL),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "Proprietary": ("All rights reserved.", "This file is proprietary and confidential; unauthorized copying is prohibited."),
}
# fixed values: words that say little in any text
_STOP = frozenset("a all an and any are as at be being but by can either even for following from have how if in into is it its may more must no not of on one or other our see should so such that the there this to under was we what which who will with would you your".split())
#: What every idf has besides the logarithm, the idf of numbers, which tell versions apart but stand in any text, and of
#: a term that no template has; and from where on a term is telling.
FLOOR, NUMBER, RARE, TELLING = 0.2, 1.0, 3.0, 1.5
#: Least cosine of a notice, and least share of a text's letters and digits in notices that makes it a licence file.
MIN_COSINE, FILE_SHARE = 0.6, 0.5
# patterns that mean the same here and in SQL
_WORD = r"[\p{L}\p{N}]+"
_MARK = r"(^|\n)[ \t]*(?:[#*;%>|!]+|//+|--+|/\*+|<!--+)[ \t]*"
_PARAGRAPH, _SENTENCE = r"\n[ \t]*(?:\n[ \t]*)+", r"([.!?;])[ \t]+"


def _words(text: str) -> list[str]:
    out, word = [], ""
    for ch in text.lower() + " ":
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def weights() -> tuple[list[tuple[str, int, str, float, float]], float]:
    """Rows (license, template, term, unit weight, idf) and the idf of a term that no template has.

    tf is 1 + ln(count); idf = ln((1 + T) / (1 + templates with the term)) + FLOOR over the T templates,
    FLOOR for stop words, and a fixed one for numbers.
    """
    texts = [(name, k, Counter(_words(t))) for name, ts in TEMPLATES.items() for k, t in enumerate(ts)]
    df = Counter(w for _, _, c in texts for w in c)
    idf = {w: FLOOR + (0 if w in _STOP else NUMBER if w.isdigit() else math.log((1 + len(texts)) / (1 + n))) for w, n in df.items()}
    rows = []
    for name, k, c in texts:
        v = {w: (1 + math.log(n)) * idf[w] for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        rows += [(name, k, w, x / norm, idf[w]) for w, x in v.items()]
    return rows, RARE


def leading_terms(min_cosine: float = MIN_COSINE) -> list[str]:
    """Terms of which every text with a cosine of `min_cosine` or more to some template has at least one.

    Of each template the terms with the telling ones first, until the rest has a norm below `min_cosine`: a text with
    none of them has at most that norm in common with the template.
    """
    vectors: dict[tuple[str, int], dict[str, float]] = {}
    for name, k, term, w, _ in weights()[0]:
        vectors.setdefault((name, k), {})[term] = w
    out = set()
    for v in vectors.values():
        rest = 1.0
        for term in sorted(v, key=lambda t: (-v[t], t)):
            if rest < min_cosine**2 - 1e-9:
                break
            out.add(term)
            rest -= v[term] ** 2
    return sorted(out)


def units(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(row, letters, nth, kind, terms) of (row, text): the parts of a text that may be a notice, as lists of words.

    Comment marks at line starts go first. Kind 0 is a sentence within a line, kind 1 a paragraph of lines joined to one
    where that is more than a sentence, kind 2 a sentence of such joined lines, kind 3 the text as a whole where it is
    more than a paragraph. Parts without a leading term are left out, and those that hold so many words which no
    template has that they can't reach the cosine: as (1 + ln c)^2 <= 1.5 c, what a part has in common with a template
    is at most 1.5 times the sum of idf^2 over its words that templates have, and each other word adds RARE^2 or more.
    """
    lead = leading_terms(min_cosine)
    idf = {t: x for _, _, t, _, x in weights()[0]}
    telling, plain = (sorted(t for t, x in idf.items() if (x >= TELLING) == k) for k in (True, False))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0))
    leads = lambda terms: F.exists(terms, lambda t: t.isin(lead))
    # most texts have no leading term at all and are read once; the others are cut up
    some = files.where(leads(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")))
    text = some.select("row", F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), _MARK, "$1").alias("t"))
    sentences = lambda c: F.split(F.regexp_replace(c, _SENTENCE, "$1\n"), "\n")
    joined = lambda c: F.translate(c, "\n", " ")
    kind = lambda k, c: F.transform(c, lambda u: F.struct(F.lit(k).alias("kind"), words(u).alias("terms")))
    text = text.withColumn("p", F.split("t", _PARAGRAPH))
    paragraphs = F.transform(F.filter("p", lambda u: u.rlike("\n|" + _SENTENCE)), joined)
    inside = F.flatten(F.transform(F.filter("p", lambda u: u.contains("\n")), lambda u: sentences(joined(u))))
    whole = F.filter(F.array(joined(F.col("t"))), lambda u: F.size("p") > 1)
    letters = F.aggregate(words(F.col("t")), F.lit(0), lambda a, x: a + F.length(x))
    count = lambda terms, own: F.size(F.filter(terms, lambda t: t.isin(own)))

    def reaches(terms):
        common = 1.5 * (max(idf.values()) ** 2 * count(terms, telling) + TELLING**2 * count(terms, plain))
        others = RARE**2 * F.size(F.array_distinct(F.filter(terms, lambda t: ~t.isin(telling + plain))))
        return common * (1 - min_cosine**2) >= others * min_cosine**2 - 1e-6

    every = F.concat(kind(0, sentences(F.col("t"))), kind(1, paragraphs), kind(2, inside), kind(3, whole))
    parts = text.select("row", letters.alias("letters"), F.posexplode(F.filter(every, lambda u: leads(u["terms"]))).alias("nth", "e"))
    return parts.select("row", "letters", "nth", "e.kind", "e.terms").where(reaches(F.col("terms")))


def notices(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(row, license, score, file_share) of (row, text): the best matching notice of every text that has one.

    Parts of the whole text (`units`) become TF-IDF vectors and are multiplied with the template vectors by a join on
    terms; the templates are a fixed table of some thousand rows. The best is the one with the most matching letters,
    score times letters of the part, then the first licence name. file_share is the share of the text's letters and
    digits in its notices, by the kind of part that has most.
    """
    rows, rare = weights()
    table = files.sparkSession.createDataFrame(rows, "license string, template int, term string, w double, idf double")
    part = ["row", "letters", "nth", "kind", "own"]
    terms = units(files, min_cosine).withColumn("own", F.length(F.array_join("terms", ""))).select(*part, F.explode("terms").alias("term"))
    tf = terms.groupBy(*part, "term").agg((1 + F.log(F.count("*"))).alias("tf"))
    idf = table.select("term", "idf").distinct()
    weighted = tf.join(F.broadcast(idf), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    norm = weighted.groupBy(*part).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "x"))).alias("v"))
    # the vector of one part is exploded against the templates; both sides stay sparse
    dots = norm.select(*part, "norm", F.explode("v").alias("e")).select(*part, "norm", F.col("e.term").alias("term"), F.col("e.x").alias("x"))
    dots = dots.join(F.broadcast(table.select("license", "template", "term", "w")), "term").groupBy(*part, "norm", "license", "template").agg((F.sum(F.col("x") * F.col("w"))).alias("dot"))
    scored = dots.withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= min_cosine)
    best = scored.groupBy(*part).agg(F.min(F.struct((-F.col("score") * F.col("own")).alias("s"), "license", "score")).alias("m"))
    kinds = best.groupBy("row", "letters", "kind").agg(F.min("m").alias("m"), F.sum("own").alias("own"))
    found = kinds.groupBy("row", "letters").agg(F.min("m").alias("m"), F.max("own").alias("own"))
    return found.select("row", F.col("m.license").alias("license"), F.col("m.score").alias("score"), F.least(F.lit(1.0), F.col("own") / F.col("letters")).alias("file_share"))


def scan(files: DataFrame, min_cosine: float = MIN_COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """One row per row of `files` (id, path, text): (id, path, own_license, score, license, origin, license_dir).

    A file whose text is mostly notices is a licence file of its directory; so is one whose name begins with license,
    licence, copying or notice and that has a notice. A file without a notice of its own takes the licence of the
    nearest directory above it, its own directory first. Each distinct directory is joined with its own ancestors once;
    files then take what their directory has, large directories by a broadcast. Of several licence files in one directory
    the one with the highest score, then the first licence name, counts.

    origin: own, inherited or none. Null text has no notice; a null path inherits nothing. Rows are told apart by a
    number of their own, so null ids and repeated rows are files like others. An empty table gives no rows.
    """
    path = F.coalesce("path", F.lit(""))
    base = files.select("id", "path", F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("dir"), F.lower(F.regexp_extract(path, "([^/]*)$", 1)).alias("name"), "text")
    base = numbered(base, "license-files")
    found = staged(notices(base.where("text is not null").select("row", "text"), min_cosine), "license-notices")
    own = base.drop("text").join(found, "row", "left").select("id", "path", "dir", "name", F.col("license").alias("own_license"), "score", "file_share")
    own = staged(own, "license-own")
    is_file = (F.col("file_share") >= file_share) | F.col("name").rlike("^(licen[sc]e|copying|notice)")
    granted = own.where(F.col("own_license").isNotNull() & F.col("path").isNotNull() & is_file).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("own_license").alias("l"))).alias("g"))
    granted = granted.select(F.col("dir").alias("up"), F.col("g.l").alias("granted"))
    heirs = F.col("own_license").isNull() & F.col("path").isNotNull()
    dirs = own.where(heirs).groupBy("dir").agg(F.count("*").alias("files"))
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(F.split("dir", "/")))).alias("depth")).withColumn("up", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = above.join(granted, "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "granted")).alias("n"))
    nearest = staged(dirs.join(nearest, "dir", "left").select("dir", "files", F.col("n.granted").alias("granted"), F.col("n.up").alias("license_dir")), "license-dirs")
    out = join_totals(own.where(heirs), nearest, "dir", "files").drop("files")
    none = F.lit(None).cast("string")
    out = out.unionByName(own.where(~heirs).withColumns({"granted": none, "license_dir": none}))
    origin = F.when(F.col("own_license").isNotNull(), "own").when(F.col("granted").isNotNull(), "inherited").otherwise("none")
    return out.select("id", "path", "own_license", "score", F.coalesce("own_license", "granted").alias("license"), origin.alias("origin"), "license_dir")


def scan_documents(docs: DataFrame) -> DataFrame:
    """The scan over documents, which have no path: source, hundreds of ids as directories, the id as file name."""
    path = F.concat_ws("/", F.lit(""), F.coalesce(F.col("source"), F.lit("unknown")), F.expr("cast(doc_id div 1000 as string)"), F.expr("cast(doc_id div 100 as string)"), F.col("doc_id").cast("string"))
    files = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
    return scan(files).withColumnRenamed("id", "doc_id")


def oracle() -> str:
    """The query's rows in DuckDB: every part of every text against every template, without leading terms or bounds."""
    rows, rare = weights()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quote(name)}, {k}, {quote(term)}, {w!r}::DOUBLE, {idf!r}::DOUBLE)" for name, k, term, w, idf in rows)
    mark, paragraph, sentence = (quote(p) for p in (_MARK, _PARAGRAPH, _SENTENCE))
    cut = lambda c: f"regexp_split_to_array(regexp_replace({c}, {sentence}, '\\1' || chr(10), 'g'), chr(10))"
    return f"""
        WITH w(license, template, term, w, idf) AS (VALUES {table}),
        d AS (SELECT doc_id, text, CASE WHEN doc_id IS NOT NULL THEN '/' || coalesce(source, 'unknown') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/' || doc_id END AS path,
                     CASE WHEN doc_id IS NOT NULL THEN '/' || coalesce(source, 'unknown') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) ELSE '' END AS dir, row_number() OVER () AS r FROM documents),
        t AS (SELECT r, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS letters, regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), {mark}, '\\1', 'g') AS t FROM d WHERE text IS NOT NULL),
        p AS (SELECT r, letters, unnest(regexp_split_to_array(t, {paragraph})) AS p FROM t),
        u AS (SELECT r, letters, 0 AS kind, unnest({cut('t')}) AS u FROM t
              UNION ALL SELECT r, letters, 1, translate(p, chr(10), ' ') FROM p WHERE regexp_matches(p, '\\n|' || {sentence})
              UNION ALL SELECT r, letters, 2, unnest({cut("translate(p, chr(10), ' ')")}) FROM p WHERE contains(p, chr(10))
              UNION ALL SELECT r, letters, 3, translate(t, chr(10), ' ') FROM t WHERE regexp_matches(t, {paragraph})),
        k AS (SELECT r, letters, kind, row_number() OVER () AS nth, regexp_extract_all(lower(u), '[\\p{{L}}\\p{{N}}]+') AS terms FROM u),
        e AS (SELECT r, letters, kind, nth, length(array_to_string(terms, '')) AS own, unnest(terms) AS term FROM k),
        f AS (SELECT r, letters, kind, nth, own, term, 1 + ln(count(*)) AS tf FROM e GROUP BY ALL),
        x AS (SELECT f.*, tf * coalesce(i.idf, {rare!r}::DOUBLE) AS x FROM f LEFT JOIN (SELECT DISTINCT term, idf FROM w) i USING (term)),
        n AS (SELECT nth, sqrt(sum(x * x)) AS norm FROM x GROUP BY nth),
        s AS (SELECT r, letters, kind, nth, own, license, template, round(sum(x * w) / any_value(norm), 9) AS score FROM x JOIN w USING (term) JOIN n USING (nth) GROUP BY ALL),
        b AS (SELECT r, letters, kind, nth, own, min({{'s': -score * own, 'license': license, 'score': score}}) AS m FROM s WHERE score >= {MIN_COSINE} GROUP BY ALL),
        q AS (SELECT r, letters, kind, min(m) AS m, sum(own) AS own FROM b GROUP BY ALL),
        g AS (SELECT r, min(m) AS m, least(1.0, max(own) / any_value(letters)) AS share FROM q GROUP BY r),
        o AS (SELECT d.doc_id, d.path, d.dir, g.m.license AS own_license, g.m.score AS score, g.share FROM d LEFT JOIN g USING (r)),
        l AS (SELECT dir AS up, min({{'s': -score, 'l': own_license}}).l AS granted FROM o WHERE own_license IS NOT NULL AND path IS NOT NULL AND share >= {FILE_SHARE} GROUP BY dir),
        a AS (SELECT dir, i, array_to_string(string_split(dir, '/')[:i], '/') AS up FROM (SELECT DISTINCT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS i FROM o WHERE path IS NOT NULL)),
        h AS (SELECT dir, max({{'i': i, 'up': up, 'granted': granted}}) AS n FROM a JOIN l USING (up) GROUP BY dir)
        SELECT doc_id, path, own_license, score, coalesce(own_license, h.n.granted) AS license,
               CASE WHEN own_license IS NOT NULL THEN 'own' WHEN h.n.granted IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
               CASE WHEN own_license IS NULL THEN h.n.up END AS license_dir
        FROM o LEFT JOIN h ON o.dir = h.dir AND o.own_license IS NULL AND o.path IS NOT NULL"""
