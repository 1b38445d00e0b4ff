"""License scans by canonical digest.

A text is put in canonical form (case, copyright lines, equivalent spellings,
punctuation, white space) and its SHA-256 is hash-joined to the digests of
known license texts, which pass through the same expressions. Four units of a
document are looked up as entire texts: the document, each paragraph, each line
and each run of consecutive paragraphs that begins with a known text's first word
and has its length. DataFrame functions only.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored, text_or_empty

#: License names and the wording of their notices or texts.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("ISC", "Licensed under the ISC License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Entire texts beyond KNOWN, and titles they stand under.
TEXTS = (
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>"""),
)
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"),
}
#: Short licenses in whole.
SHORT = (
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
)
#: Longer ones lie in files, named by their license; they are known up to this line, too, and from that one on.
FILES = tuple((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "texts").glob("*.txt")))
END, START = "END OF TERMS AND CONDITIONS", "TERMS AND CONDITIONS"


def _parts(name: str, text: str) -> list[tuple[str, str]]:
    """A file's text, and its terms without title and appendix."""
    head, end, _ = text.partition(END)
    terms = START + head.partition(START)[2]
    return [(name, text), *([(name, head + end), (name, head), (name, terms + end), (name, terms)] if end and START in head else [])]


ENTIRE = TEXTS + SHORT + tuple(x for x in KNOWN if "\n\n" in x[1])
#: KNOWN, the entire texts, and those under a title.
ALL = KNOWN + TEXTS + SHORT + tuple(p for f in FILES for p in _parts(*f)) + tuple((n, f"{t}\n\n{x}") for n, x in ENTIRE for t in TITLES.get(n, ()))

#: Spellings that count as the same, as (found, replacement).
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("https://", "http://"),
    ("&", " and "),
)
#: A copyright line may stand behind the signs of a comment.
COPYRIGHT_LINE = r"^[ \t\r]*(?:[#*;%!]+|/[/*]+|--+|<!--+)?[ \t]*(copyright|\(c\)|©)[^\n]*$"
#: All ASCII signs but letters, digits and line feeds; no-break space, typographic dashes, quotes, bullet, ellipsis and angle quotes.
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{A0}\x{AB}\x{BB}\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2022}\x{2026}]+"
PARAGRAPH_BREAK = r"\n(?: *\n)+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_lines(text: Column) -> Column:
    """Canonical form with its line feeds kept."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), "(?md)" + COPYRIGHT_LINE, "")
    for found, to in SPELLINGS:
        out = F.replace(out, F.lit(found), F.lit(to))
    return F.regexp_replace(out, PUNCTUATION, " ")


def flat(lines: Column) -> Column:
    """Canonical form of a whole text from its canonical lines."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known=ALL) -> DataFrame:
    """One row per digest: digest, license, chars, first (its first word). Wordings that coincide keep the smallest name."""
    rows = spark.createDataFrame(list(known), "license string, wording string").withColumn("wording", flat(canonical_lines(F.col("wording"))))
    return rows.groupBy(F.sha2("wording", 256).alias("digest")).agg(F.min("license").alias("license"), F.min(F.length("wording")).alias("chars"), F.min(first_word(F.col("wording"))).alias("first"))


def first_word(flat_text: Column) -> Column:
    return F.substring_index(flat_text, " ", 1)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once: a lambda's variable is not copied into each place it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(numbers: Column, chunk: int = 256) -> Column:
    """0 and the running sums of an array, by chunks, so that long ones don't grow an array element by element."""
    running = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.size(numbers) - 1, F.lit(0)), F.lit(chunk)), lambda i: running(F.slice(numbers, i + 1, chunk)))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0)))
        offsets = F.aggregate(totals, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.concat(F.array(F.lit(0)), F.flatten(F.zip_with(parts, F.slice(offsets, 1, F.size(parts)), lambda p, o: F.transform(p, lambda x: x + o))))

    return _let(pieces, joined)


def runs(paragraphs: Column, shapes: dict[str, list[int]]) -> Column:
    """Runs of consecutive paragraphs, joined, that may equal a known text: they begin with its first word and are as long.

    Ends that fit any start are found by one intersection with the places where
    paragraphs end, so long documents stay linear.
    """
    lengths = F.create_map(*[x for w, ns in sorted(shapes.items()) for x in (F.lit(w), F.array(*map(F.lit, ns)))])

    def joined(upto: Column) -> Column:
        starts = F.transform(paragraphs, lambda p, i: F.struct(first_word(p).alias("w"), i.alias("i"), F.get(upto, i).alias("at")))
        starts = F.filter(starts, lambda x: x["w"].isin(sorted(shapes)))
        wanted = F.flatten(F.transform(starts, lambda x: F.transform(lengths[x["w"]], lambda n: F.struct(x["i"].alias("i"), (x["at"] + n + 1).alias("end")))))
        return _let(wanted, lambda all_: _let(F.array_intersect(upto, F.transform(all_, lambda x: x["end"])), lambda met: F.transform(
            F.filter(all_, lambda x: F.array_contains(met, x["end"])),
            lambda x: F.array_join(F.slice(paragraphs, x["i"] + 1, F.array_position(upto, x["end"]).cast("int") - 1 - x["i"]), " "),
        )))

    return _let(_sums(F.transform(paragraphs, lambda p: F.length(p) + 1)), joined)


def cover(texts: list[str]) -> list[str]:
    """A few words of which every text holds one: where none of them stands, no run of paragraphs needs a look."""
    left, out = [set(re.findall("[a-z]{5,}", flat_text(t))) for t in texts], []
    while left:
        counts = Counter(w for t in left for w in t)
        out.append(max(counts, key=lambda w: (counts[w], len(w), w)))
        left = [t for t in left if out[-1] not in t]
    return out


def flat_text(text: str) -> str:
    """The spellings of a known text, in plain Python, as far as its words go."""
    out = text.lower()
    for found, to in SPELLINGS:
        out = out.replace(found, to)
    return out


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", known=ALL) -> DataFrame:
    """One row per document: doc_id, text_digest (of the canonical text),
    whole_license (null unless the whole text is a known one), n_hits (distinct
    known texts that are the document, a run of paragraphs or a line of it), licenses
    (their names, distinct, in order, comma-joined; empty without any).

    Null texts count as empty; the empty text matches nothing. Repeated rows
    are scanned each for itself, null identifiers included; other columns are
    ignored; an empty table gives an empty result.
    """
    book = known_digests(docs.sparkSession, known)
    shapes: dict[str, list[int]] = {}
    for r in book.select("chars", "first").distinct().collect():  # of the constant table
        shapes.setdefault(r["first"], []).append(r["chars"])
    lengths = sorted({n for ns in shapes.values() for n in ns})
    signs = cover([t for _, t in known])
    book = F.broadcast(book.drop("chars", "first"))
    body = text_or_empty(text)

    def units(lines: Column) -> Column:
        def all_(paragraphs: Column) -> Column:
            some = F.when((F.size(paragraphs) > 1) & lines.rlike("|".join(signs)), runs(paragraphs, shapes)).otherwise(F.array().cast("array<string>"))
            parts = F.concat(F.transform(F.concat(F.array(lines), F.split(lines, r"\n")), flat), paragraphs, some)
            # Only a unit as long as a known text can equal it: digests of the others are never looked up.
            return F.transform(F.array_distinct(F.filter(parts, lambda u: F.length(u).isin(lengths))), lambda u: F.sha2(u, 256))

        found = _let(F.filter(F.transform(F.split(lines, PARAGRAPH_BREAK), flat), lambda p: p != ""), all_)
        return F.struct(F.sha2(flat(lines), 256).alias("text_digest"), found.alias("units"))

    rows = docs.select(F.col(key).alias("doc_id"), F.sha2(body, 256).alias("raw"), _let(canonical_lines(body), units).alias("u"))
    table = stored(rows.select("doc_id", "raw", "u.text_digest", "u.units"), "units")
    found = table.select("doc_id", "raw", F.explode("units").alias("digest")).join(book, "digest")
    hits = found.groupBy(F.col("doc_id").alias("hit_id"), F.col("raw").alias("hit_raw")).agg(F.countDistinct("digest").alias("n_hits"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))
    whole = table.drop("units").join(book.withColumnsRenamed({"digest": "text_digest", "license": "whole_license"}), "text_digest", "left")
    return whole.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("raw") == F.col("hit_raw")), "left").select(
        "doc_id", "text_digest", "whole_license", F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), F.coalesce("licenses", F.lit("")).alias("licenses"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), {_quoted('(?m)' + COPYRIGHT_LINE)}, '', 'g')"
    for found, to in SPELLINGS:
        out = f"replace({out}, {_quoted(found)}, {_quoted(to)})"
    return f"regexp_replace({out}, {_quoted(PUNCTUATION)}, ' ', 'g')"


def _sql_flat(lines: str) -> str:
    return f"trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'))"


ORACLE = f"""
WITH book AS (
  SELECT {_sql_flat(_sql_canonical('wording'))} AS wording, license FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in ALL)}) AS v(license, wording)
), known AS (
  SELECT sha256(wording) AS digest, min(license) AS license FROM book GROUP BY 1
), shapes AS (
  SELECT DISTINCT split_part(wording, ' ', 1) AS first, length(wording) AS chars FROM book
), lines AS (
  SELECT doc_id, {_sql_canonical("coalesce(text, '')")} AS lines FROM documents
), paragraphs AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(lines, '{PARAGRAPH_BREAK}'), lambda x: {_sql_flat('x')}), lambda p: p <> '') AS ps FROM lines
), placed AS (
  SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM paragraphs WHERE len(ps) > 1
), ends AS (
  SELECT doc_id, i, split_part(p, ' ', 1) AS first, sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto, length(p) AS n FROM placed
), spans AS (
  SELECT DISTINCT a.doc_id, a.i AS i0, b.i AS i1 FROM ends a JOIN shapes s ON s.first = a.first JOIN ends b ON b.doc_id = a.doc_id AND b.upto = a.upto - a.n + s.chars WHERE b.i > a.i
), runs AS (
  SELECT s.doc_id, string_agg(p.p, ' ' ORDER BY p.i) AS unit FROM spans s JOIN placed p ON p.doc_id = s.doc_id AND p.i BETWEEN i0 AND i1 GROUP BY s.doc_id, i0, i1
), units AS (
  SELECT doc_id, lines AS unit FROM lines
  UNION ALL SELECT doc_id, unnest(ps) FROM paragraphs
  UNION ALL SELECT doc_id, unnest(string_split(lines, chr(10))) FROM lines
  UNION ALL SELECT doc_id, unit FROM runs
), hits AS (
  SELECT doc_id, count(DISTINCT digest)::BIGINT AS n_hits, array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses
  FROM units JOIN known ON digest = sha256({_sql_flat('unit')}) GROUP BY doc_id
)
SELECT l.doc_id, sha256({_sql_flat('lines')}) AS text_digest, k.license AS whole_license,
       coalesce(n_hits, 0)::BIGINT AS n_hits, coalesce(licenses, '') AS licenses
FROM lines l LEFT JOIN hits h USING (doc_id) LEFT JOIN known k ON k.digest = sha256({_sql_flat('lines')})
"""
