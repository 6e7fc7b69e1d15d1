"""Licence scan by digests of canonical texts.

A text is brought to a canonical form: case, punctuation, copyright lines, white space and equivalent spellings no
longer differ. Its digest is then looked up among those of known licence texts and notices. Looked up are whole
documents, their paragraphs and their lines, each as an entire unit: nothing is searched for inside a unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short licences and the usual notices, in any punctuation and case.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
    "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice appear in all copies."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
    'to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF '
    "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:"
)
_BSD_CLAUSES = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.",
]
_BSD_WARRANTIES = [
    f'THIS SOFTWARE IS PROVIDED BY THE {by} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    f"{no} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
    "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    for by in ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER")
    for no in ("COPYRIGHT HOLDER", "COPYRIGHT HOLDERS")
]
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
    "compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
    "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our "
    "heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future "
    "rights to this software under copyright law.\n\n"
    f"{_MIT_WARRANTY.replace('AUTHORS OR COPYRIGHT HOLDERS', 'AUTHORS')}\n\n"
    "For more information, please refer to <https://unlicense.org"
)
_MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
    "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)


def _gnu(licence: str, name: str, work: str, version: str) -> list[tuple[str, str, str]]:
    """The header of a GNU licence, and its first paragraph."""
    first = (
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the "
        f"Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )
    second = (
        f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    )
    third = f"You should have received a copy of the GNU {name} along with this {work}. If not, see <https://www.gnu.org/licenses/>."
    return [(licence, "header", f"{first}\n\n{second}\n\n{third}"), (licence, "header", first)]


KNOWN = [
    ("MIT", "text", f"{_MIT_GRANT}\n\n{_MIT_NOTICE}\n\n{_MIT_WARRANTY}"),
    ("MIT", "text", f"MIT License\n\n{_MIT_GRANT}\n\n{_MIT_NOTICE}\n\n{_MIT_WARRANTY}"),
    ("MIT", "text", f"The MIT License (MIT)\n\n{_MIT_GRANT}\n\n{_MIT_NOTICE}\n\n{_MIT_WARRANTY}"),
    ("MIT", "part", _MIT_GRANT),
    ("MIT", "part", _MIT_WARRANTY),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("ISC", "text", f"{_ISC_GRANT}\n\n{_ISC_WARRANTY}"),
    ("ISC", "text", f"ISC License\n\n{_ISC_GRANT}\n\n{_ISC_WARRANTY}"),
    ("ISC", "part", _ISC_WARRANTY),
    ("ISC", "notice", "Licensed under the ISC License."),
    ("Apache-2.0", "header", _APACHE_HEADER),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("MIT", "notice", "SPDX-License-Identifier: MIT"),
    *(
        (f"BSD-{n}-Clause", "text", title + "\n\n".join([_BSD_GRANT, *(f"{k if numbered else '*'} {c}" for k, c in enumerate(_BSD_CLAUSES[:n], 1)), warranty]))
        for n in (2, 3)
        for title in ("", f"BSD {n}-Clause License\n\n")
        for numbered in (True, False)
        for warranty in _BSD_WARRANTIES
    ),
    *(("BSD", "part", warranty) for warranty in _BSD_WARRANTIES),
    *(("Unlicense", "text", f"{_UNLICENSE}{end}>") for end in ("", "/")),
    ("MPL-2.0", "header", _MPL_HEADER),
    *_gnu("GPL-2.0", "General Public License", "program", "2"),
    *_gnu("GPL-3.0", "General Public License", "program", "3"),
    *_gnu("LGPL-2.1", "Lesser General Public License", "library", "2.1"),
    *_gnu("LGPL-3.0", "Lesser General Public License", "library", "3"),
    *((name.removesuffix("-only").removesuffix("-or-later"), "notice", f"SPDX-License-Identifier: {name}") for name in (
        "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Unlicense", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later",
        "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-NC-4.0",
    )),
]
#: Spellings that count as one, after case and punctuation are gone. Whole words.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("non infringement", "noninfringement"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"),
    ("http", "https"), ("per cent", "percent"), ("non commercial", "noncommercial"), ("favour", "favor"), ("organisation", "organization"),
]
#: A line that only states a copyright is dropped.
COPYRIGHT = r"(?:^|\n)[ \t]*(?:copyright|\(c\)|©)[^\n]*(?:\(c\)|©|[0-9]{4})[^\n]*|(?:^|\n)[ \t]*all rights reserved\.?[ \t]*(?=\n|$)"
#: Letters that every known text has, in a row within a word: units without any of them are no known text.
MARKS = "(?i)licen|permission|software"
SIGN = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"  # ASCII that is neither lower-case letter nor digit


def canonical(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), COPYRIGHT, "\n")
    c = F.concat(F.lit(" "), F.regexp_replace(c, SIGN, "  "), F.lit(" "))
    for one, other in SPELLINGS:  # words are two blanks apart, so neighbours do not share one
        c = F.replace(c, F.lit(f" {one.replace(' ', '  ')} "), F.lit(f" {other} "))
    return F.trim(F.regexp_replace(c, " +", " "))


def known(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """licence, form and digest of the known texts: a fixed table of a few rows, and those of ``texts``."""
    rows = spark.createDataFrame(KNOWN, "licence string, form string, text string")
    if texts is not None:
        given = texts.select("licence", "form", "text")
        rows = rows.unionByName(given.where(F.length(canonical(F.col("text"))) > 0))
    return rows.select("licence", "form", F.sha2(canonical(F.col("text")), 256).alias("digest")).distinct()


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per unit that is a known text: doc_id, unit (document, paragraph or line), place (from 0), licence, form.

    Null and empty texts, and units without letter or digit, give nothing. Repeated rows report each; other columns are
    not looked at. ``texts`` (licence, form, text) adds known texts; with it units are looked up whatever words they have.
    """
    lines, paragraphs = F.split("text", "\n"), F.split("text", r"\n[ \t]*\n")
    unit = lambda kind: lambda t, i: F.struct(F.lit(kind).alias("unit"), i.cast("int").alias("place"), t.alias("part"))
    units = F.concat(
        F.array(F.struct(F.lit("document").alias("unit"), F.lit(0).alias("place"), F.col("text").alias("part"))),
        F.transform(paragraphs, unit("paragraph")),
        F.transform(lines, unit("line")),
    )
    marks = (lambda c: c.rlike(MARKS)) if texts is None else (lambda c: F.length(c) > 0)
    marked = docs.where(marks(F.col("text"))).select("doc_id", "text")
    found = marked.select("doc_id", F.inline(F.filter(units, lambda u: marks(u["part"]))))
    found = found.select("doc_id", "unit", "place", F.sha2(canonical(F.col("part")), 256).alias("digest"))
    names = known(docs.sparkSession, texts)
    return found.join(F.broadcast(names) if texts is None else names, "digest").select("doc_id", "unit", "place", "licence", "form")
