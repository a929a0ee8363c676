"""Licence scans: texts in a canonical form, looked up by digest among known licences.

A document is looked up as a whole, by its lines and by its runs of paragraphs as long as a known text is. Each of
these entire texts is put into canonical form, and its digest is joined with the digests of the known texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.llm.common import ready, whole_text

# Spellings that count as the same word, as licence guidelines list them.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

# Public licence texts and the usual notices that name a licence, by identifier.
_MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
_GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE_LINK = """

For more information, please refer to <https://unlicense.org>"""
# Titles above licence texts; a passage of a document is looked up without them.
TITLES = (
    "MIT License", "ISC License", "BSD 2-Clause License", "BSD 3-Clause License", "zlib License", "Zero-Clause BSD", "BSD Zero Clause License",
)
KNOWN = (
    ("MIT", _MIT),
    ("MIT", _MIT.removeprefix("MIT License\n\n")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", _ISC.removeprefix("ISC License\n\n")),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("0BSD", _0BSD),
    ("0BSD", "Zero-Clause BSD\n\n" + _0BSD),
    ("0BSD", "BSD Zero Clause License\n\n" + _0BSD),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + _UNLICENSE_LINK),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", _GPL3),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("all-rights-reserved", "All rights reserved."),
)

# Lines that state a copyright (a wrapped line of a licence may begin with "copyright notice"), and links that differ in their scheme.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright[ \t]*(\(c\)|©|<|\[|[0-9]|:|by |the )|\(c\)|©)[^\n]*"
SECURE_LINK = "https://"
PLAIN_LINK = "http://"
NO_LETTER = "[^a-z0-9]+"
# Paragraphs of a passage; the longest known text without its title has five.
PASSAGE = 6
PARAGRAPH_BREAK = r"\n[ \t\r]*\n"


def uncredited(text: Column) -> Column:
    """In lower case, without copyright lines."""
    return F.regexp_replace(F.lower(text), COPYRIGHT_LINE.replace("(?m)", "(?md)"), "")


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one space for all else than letters and digits, one spelling."""
    out = F.replace(uncredited(text), F.lit(SECURE_LINK), F.lit(PLAIN_LINK))
    out = F.trim(F.regexp_replace(out, NO_LETTER, " "))
    for other, usual in EQUIVALENT:
        out = F.regexp_replace(out, rf"\b{other}\b", usual)
    return out


def titled(text: str) -> bool:
    return text.split("\n\n")[0] in TITLES


def _worded_paragraphs(text: Column) -> Column:
    """(place, part) of the paragraphs that have words in canonical form, place counting all paragraphs."""
    parts = F.transform(F.split(text, PARAGRAPH_BREAK, -1), lambda part, place: F.struct(place.alias("place"), part.alias("part")))
    return F.filter(parts, lambda x: uncredited(x["part"]).rlike("[a-z0-9]"))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(license_id, digest, first_word, titled) of the known texts, each digest once."""
    texts = spark.createDataFrame([(i, t, titled(t)) for i, t in known], "license_id string, text string, titled boolean")
    forms = texts.select("license_id", canonical(F.col("text")).alias("form"), "titled")
    return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(
        F.min("license_id").alias("license_id"),
        F.min(F.substring_index("form", " ", 1)).alias("first_word"),
        F.min("titled").alias("titled"),
    )


def _may_begin(known: DataFrame) -> list[str]:
    """The words with which a text can begin that is known in canonical form: its first word in any spelling."""
    first = {r.first_word for r in known.select("first_word").distinct().collect()}
    spelled = {other.split()[0] for other, usual in EQUIVALENT if usual.split()[0] in first}
    return sorted(first | spelled | ({"https"} if "http" in first else set()))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text that is a known licence: id, unit (text, paragraph, passage, line), place, license_id, digest.

    `known` is (license_id, digest, first_word, titled), a fixed list. Texts that begin with none of the
    first words cannot be in it and are not brought into canonical form. The whole text is looked up, its paragraphs
    of several lines if it has more than one paragraph, and its lines if it has more than
    one. If the whole text is not known, every run of 2 to PASSAGE paragraphs with words is looked up as well (passage,
    at the place of its first paragraph; known texts with a title are found by the text below the title). Null and
    empty texts match nothing, an empty table gives no row. Null or repeated ids and rows give their own rows.
    Other columns are ignored.
    """
    ready(docs.sparkSession)
    text = F.col("_text")
    lines, paragraphs = F.split(text, "\n", -1), F.split(text, PARAGRAPH_BREAK, -1)

    def units(name: str, parts: Column) -> Column:
        return F.transform(parts, lambda part, place: F.struct(F.lit(name).alias("unit"), place.alias("place"), part.alias("part")))

    begin, digests = _may_begin(known), [r.digest for r in known.select("digest").collect()]

    def begins(part: Column, words: list[str]) -> Column:
        return F.regexp_extract(uncredited(part), "[a-z0-9]+", 0).isin(words)

    # A passage begins where a paragraph does that can open a text without a title.
    opening = _may_begin(known.filter("NOT titled"))
    worded = _worded_paragraphs(text)

    def passages(x: Column, at: Column) -> Column:
        lengths = F.filter(F.sequence(F.lit(2), F.lit(PASSAGE)), lambda n: at + n <= F.size(worded))
        return F.when(begins(x["part"], opening), lengths).otherwise(F.filter(lengths, lambda n: F.lit(False)))

    def passage(x: Column, at: Column, n: Column) -> Column:
        run = F.transform(F.slice(worded, at + 1, n), lambda y: y["part"])
        return F.struct(F.lit("passage").alias("unit"), x["place"].alias("place"), F.array_join(run, "\n\n").alias("part"))

    runs = F.flatten(F.transform(worded, lambda x, at: F.transform(passages(x, at), lambda n: passage(x, at, n))))
    whole = F.when(begins(text, begin), F.sha2(canonical(text), 256).isin(digests)).otherwise(False)
    none = F.filter(units("line", F.array(F.lit(""))), lambda x: F.lit(False))
    several = F.filter(units("paragraph", paragraphs), lambda x: F.contains(x["part"], F.lit("\n")))
    all_units = F.concat(
        units("text", F.array(text)),
        F.when(F.size(paragraphs) > 1, several).otherwise(none),
        F.when((F.size(paragraphs) > 1) & ~whole, runs).otherwise(none),
        F.when(F.size(lines) > 1, units("line", lines)).otherwise(none),
    )
    rows = (
        docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
        .select("_id", F.explode(all_units).alias("_unit"))
        .filter(begins(F.col("_unit.part"), begin))
        .select("_id", "_unit.unit", F.col("_unit.place").cast("long").alias("place"), canonical(F.col("_unit.part")).alias("_canonical"))
        .filter("_canonical <> ''")
        .select("_id", "unit", "place", F.sha2("_canonical", 256).alias("digest"))
    )
    found = rows.join(F.broadcast(known.drop("first_word")), "digest").filter("unit <> 'passage' OR NOT titled")
    return found.select(F.col("_id").alias(id_col), "unit", "place", "license_id", "digest")
