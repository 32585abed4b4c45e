"""License scans: TF-IDF cosine of headers and licence files to templates, inherited from the nearest directory."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chosen, hot_join, text_or_empty
from tidemark.session import materialize

#: Least cosine of a passage to a template.
THRESHOLD = 0.7
#: Names of files that declare the licence of their directory.
LICENCE_FILE = r"(?i)^(un)?(licen[sc]e|copying|copyright|notice)([._-].*)?$"

#: Notices of common licences, as (identifier, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. Licensed under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU_END = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
_GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."

#: Whole texts, the standard headers, and the titles of texts that are too long to be one passage.
TEXTS = (
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", _BSD + "1. " + _BSD_1 + "2. " + _BSD_2 + _BSD_END),
    ("BSD-2-Clause", _BSD + _BSD_1 + _BSD_2),
    ("BSD-3-Clause", _BSD + "1. " + _BSD_1 + "2. " + _BSD_2 + "3. " + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_1 + _BSD_2 + _BSD_3),
    ("BSD-3-Clause", _BSD),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", _GPL.format(2) + _GNU_END),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", _GPL.format(3) + _GNU_END),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _GPL.format(3).replace("General", "Lesser General") + _GNU_END.replace("General", "Lesser General")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", _GPL.format(3).replace("General", "Affero General") + _GNU_END.replace("General", "Affero General")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: Lines of a window.
WINDOWS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32)

#: A term: ``by-nc`` and ``2.0`` are one each.
TERM = r"[a-z]+(?:-[a-z0-9]+)*|[0-9]+(?:\.[0-9]+)*"


def terms_of(text: Column) -> Column:
    """Lower-case words and numbers of a passage."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def passages_of(text: Column) -> Column:
    """The lines of the whole text that have a letter or digit, without leading comment marks."""
    lines = F.filter(F.split(text, r"[\r\n]+"), lambda p: F.rlike(p, F.lit("[A-Za-z0-9]")))
    return F.transform(lines, lambda p: F.regexp_replace(p, r"(?i)^(?:[^a-z0-9]|(?:rem|dnl)\s)+", ""))


def windows_of(lines: Column, telling: Column, sizes: Sequence[int] = WINDOWS) -> Column:
    """Windows of following lines whose first or second line is telling; the last ones end with the text."""
    last = F.size(lines)
    at = F.filter(F.sequence(F.lit(1), last), lambda i: F.get(telling, i - 1) | ((i < last) & F.get(telling, i)))
    return F.flatten(F.transform(at, lambda i: F.transform(F.array(*[F.lit(n) for n in sizes]), lambda n: F.array_join(F.slice(lines, i, n), "\n"))))


def telling_terms(vectors: Sequence[tuple[str, dict[str, float]]], df: dict[str, int], threshold: float) -> list[str]:
    """Terms of which every passage at or over the threshold has one: by Cauchy and Schwarz the shared
    terms hold at least its square of a template's norm, so no passage does without all of a set that
    holds more than the rest. The terms in the fewest files make up the set."""
    out = set()
    for _, vector in vectors:
        held = 0.0
        for t in sorted(vector, key=lambda t: (df.get(t, 0), t)):
            if held > 1 - threshold**2 + 1e-9:
                break
            held += vector[t] ** 2
            out.add(t)
    return sorted(out)


def scan_licences(files: DataFrame, id_col: str, path: Column, text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, directory, own_license, own_score, license, license_from, inherited_from): the licence of each file.

    Every line of a whole text, windows of up to 32 following lines (comment
    marks stripped, empty lines left out, one of the first two lines telling),
    and the text of a licence file as a whole are compared with the templates
    and, at ``THRESHOLD`` at least, with ``TEXTS`` by the cosine of sparse
    TF-IDF vectors; idf comes from the number of files that hold each term of
    the templates, over all files, and other terms weigh as unseen ones. Lines
    without a telling term cannot reach the threshold. The best passage at or over the
    threshold gives the file's own licence (of equal scores the first
    identifier). Files without one take that of the nearest directory at or
    above their own that a licence file declares; ``license_from`` is
    ``header``, ``file`` (the file itself is a licence file), ``inherited`` or
    ``none``.

    ``path`` is an expression of ``files``. Null or empty texts have no licence
    of their own; a null path has no directory and inherits nothing; of several
    licence files in one directory the best score, then the first identifier
    holds; repeated rows stay; an empty table gives an empty one; other columns
    are left behind.
    """
    rows = files.select(files[f"`{id_col}`"].alias("id"), path.cast("string").alias("path"), files[f"`{text_col}`"].alias("text")).withColumn("text", text_or_empty("text"))
    kinds = [(templates, threshold), (TEXTS, max(threshold, THRESHOLD))]
    parsed = [[(k, re.findall(TERM, t.lower())) for k, t in kind] for kind, _ in kinds]
    vocabularies = [sorted({t for _, terms in kind for t in terms}) for kind in parsed]
    known = F.lit(sorted({t for v in vocabularies for t in v}))
    counted = rows.select(F.explode(F.array_intersect(terms_of(F.col("text")), known)).alias("term")).groupBy("term").count()
    n = rows.count()
    found = {r["term"]: r["count"] for r in counted.collect()}  # at most one row for each template term
    unseen = _idf(n, 0)

    telling, scorers = set(), []
    for kind, vocabulary, (_, least) in zip(parsed, vocabularies, kinds, strict=True):
        idf = {t: _idf(n, found.get(t, 0)) for t in vocabulary}
        # template weights, normalised: one small map for each template
        vectors = []
        for licence, terms in kind:
            weight = {t: terms.count(t) * idf[t] for t in terms}
            norm = sum(w * w for w in weight.values()) ** 0.5
            vectors.append((licence, {t: w / norm for t, w in weight.items()}))
        telling |= set(telling_terms(vectors, found, least))
        # one array of numbers for each term: idf, then its weight in every template
        table = F.create_map(*[x for t in vocabulary for x in (F.lit(t), F.lit([idf[t], *[v.get(t, 0.0) for _, v in vectors]]))])
        scorers.append((table, [k for k, _ in vectors], least))

    def scored(passage: Column) -> Column:
        """Best (score, licence) of one passage, over templates and whole texts."""
        terms = terms_of(passage)
        (table, names, _), (texts, text_names, least) = scorers
        whole = F.filter(F.array(_best(terms, texts, unseen, text_names)), lambda x: x["score"] >= least)
        return F.array_max(F.concat(F.array(_best(terms, table, unseen, names)), whole))

    name = F.element_at(F.split("path", "/"), -1)
    is_licence = F.coalesce(name.rlike(LICENCE_FILE), F.lit(False))
    known_telling = F.lit(sorted(telling))
    tells = lambda text: F.arrays_overlap(terms_of(text), known_telling)
    flagged = rows.withColumn("lines", F.when(tells(F.col("text")), passages_of(F.col("text"))).otherwise(F.array().cast("array<string>")))
    flagged = flagged.withColumn("tells", F.transform("lines", tells))
    single = F.filter("lines", lambda p, i: F.get("tells", i))
    passages = F.when(F.size(single) > 0, F.concat(single, F.when(F.size("lines") > 1, windows_of(F.col("lines"), F.col("tells"))).otherwise(F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))
    passages = F.when(is_licence & (F.size("lines") > 0), F.concat(passages, F.array("text"))).otherwise(passages)
    flagged = flagged.withColumn("passages", F.array_distinct(passages))
    best = F.array_max(F.transform("passages", scored))
    own = flagged.select(
        "id",
        "path",
        F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*$", "")).when(F.col("path").isNotNull(), "").alias("directory"),
        is_licence.alias("is_licence"),
        best.alias("best"),
    )
    holds = F.coalesce(F.col("best.score") >= threshold, F.lit(False))
    own = own.select("id", "path", "directory", "is_licence", F.when(holds, F.col("best.license")).alias("own_license"), F.when(holds, F.col("best.score")).alias("own_score"))
    own = materialize(own, "own-licences")  # the scores are read three times
    declared = own.where("is_licence and own_license is not null and directory is not null").groupBy("directory").agg(F.max(F.struct(F.round("own_score", 9).alias("s"), F.translate("own_license", _ASCII, _ASCII[::-1]).alias("k"), "own_license")).alias("d")).select(F.col("directory").alias("above"), F.col("d.own_license").alias("license"))
    # each distinct directory joins its ancestors; the longest path that declares something is the nearest
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    ancestors = own.where("directory is not null").select("directory").distinct().select("directory", F.explode(F.array_distinct(above)).alias("above"))
    nearest = hot_join(ancestors, declared, "above", "inner").groupBy("directory").agg(F.max_by(F.struct("license", "above"), F.length("above")).alias("from"))
    joined = hot_join(own, nearest, "directory")
    return joined.select(
        F.col("id").alias(id_col),
        "path",
        "directory",
        "own_license",
        "own_score",
        F.coalesce("own_license", F.col("from.license")).alias("license"),
        F.when(F.col("own_license").isNotNull() & F.col("is_licence"), "file").when(F.col("own_license").isNotNull(), "header").when(F.col("from").isNotNull(), "inherited").otherwise("none").alias("license_from"),
        F.when(F.col("own_license").isNull(), F.col("from.above")).alias("inherited_from"),
    )


#: To let a maximum choose the first of two names.
_ASCII = "".join(chr(c) for c in range(33, 127))


def _idf(n: int, df: int) -> float:
    return math.log((n + 1) / (df + 1)) + 1


def _best(terms: Column, table: Column, unseen: float, licences: list[str]) -> Column:
    """Best template of a passage: one walk over its sorted terms sums the squared norm and the dot product with each template."""
    size = len(licences)
    start = F.struct(F.lit("").alias("term"), F.lit(0.0).alias("tf"), F.lit(0.0).alias("norm"), F.array_repeat(F.lit(0.0), size).alias("dots"))

    def step(state: Column, term: Column) -> Column:
        entry = F.element_at(table, state["term"])
        weight = state["tf"] * F.coalesce(F.element_at(entry, 1), F.lit(unseen))
        dots = F.when(entry.isNull(), state["dots"]).otherwise(F.zip_with(state["dots"], F.slice(entry, 2, size), lambda d, w: d + w * weight))
        same = F.struct(state["term"].alias("term"), (state["tf"] + 1.0).alias("tf"), state["norm"].alias("norm"), state["dots"].alias("dots"))
        new = F.struct(term.alias("term"), F.lit(1.0).alias("tf"), (state["norm"] + weight * weight).alias("norm"), dots.alias("dots"))
        return F.when(term == state["term"], same).otherwise(new)

    def finish(state: Column) -> Column:
        norm = F.sqrt(state["norm"])
        named = F.zip_with(state["dots"], F.lit(licences), lambda d, k: F.struct(F.when(norm > 0, d / norm).otherwise(0.0).alias("score"), F.translate(k, _ASCII, _ASCII[::-1]).alias("rank"), k.alias("license")))
        return F.array_max(named)

    # the end mark closes the last run of equal terms
    return F.aggregate(F.concat(F.array_sort(terms), F.array(F.lit("~"))), start, step, finish)
