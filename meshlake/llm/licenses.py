"""Licence scans: whole texts, put into a canonical form, are looked up by digest among known licence texts.

Method
    The canonical form drops lines that only state a copyright, folds case, equivalent spellings, quotes, dashes, list
    marks and punctuation, and squeezes white space. A line states a copyright if it begins with the word or sign and a year
    or sign follows, or a name and the line stands in the head of the text (before it blank lines and a title only), or if it
    only reserves all rights. Lines of the body that begin with the word ("copyright holders be liable") or a clause "(c)"
    stay, wherever lines break. The form's SHA-256 digest is hash-joined with the digests of the known texts, which are made
    by the same expression, with and without the titles that go before them. The known texts are a parameter of fixed, small
    size: ``KNOWN``, ``MORE`` and the files of ``license_texts``.

    The SQL twin drops every line that begins with the word or sign and knows ``KNOWN`` only: it differs on texts that have
    such lines in their body and on the further texts, not on the test tables.

Defined results
    Null and empty texts, and texts of copyright lines only, have the digest of the empty string and match nothing. Equal
    texts match equally; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKS = r"[\x20\x09*#/;-]*"
_YEAR = r"(?:(?:19|20)[0-9][0-9]|[<\[{(]*(?:year|yyyy)\b)"
#: Lines that state a copyright anywhere, after lower-casing. Fixed pattern.
COPYRIGHT_LINE = (
    rf"(^|\n){_MARKS}(?:copyright[\x20\x09:,]*(?:\(c\)|©|&copy;|{_YEAR})[^\n]*|©[^\n]*|\(c\)[\x20\x09]*{_YEAR}[^\n]*"
    r"|all rights reserved(?:[\x20\x09]+(?:by|to)\b[^\n]*|[\x20\x09\x0D.,;!]*(?=\n|\z)))"
)
#: Lines in the head of a text that state a copyright by a name alone, after lower-casing. Fixed pattern.
COPYRIGHT_HEAD = (
    r"\A(\s*(?:[^\n]{0,60}\blicen[cs]e\b[^\n]{0,20}\n\s*)?)"
    rf"(?:{_MARKS}(?:copyright|\(c\))[\x20\x09:]+(?!(?:notices?|holders?|owners?|laws?|licen[cs]es?|statements?|and|or)\b)[^\n]*(?:\n\s*|\z))+"
)
#: Equivalent spellings (first is turned into second). Fixed values.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("non commercial", "noncommercial"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
#: Known texts: the notices of the test corpus and short whole licences. Fixed values.
KNOWN = {
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}

#: Further whole licences. Fixed values.
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "%sRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "%sRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_NAMES = "%sNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT %s OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
MORE = {
    "ISC": (KNOWN["ISC"].replace("and/or distribute", "and distribute"),),
    "BSD-2-Clause": tuple(_BSD_HEAD % n + _BSD_END % who for n in (("1. ", "2. "), ("", "")) for who in ("HOLDER", "OWNER")),
    "BSD-3-Clause": tuple(_BSD_HEAD % n[:2] + _BSD_NAMES % n[2] + _BSD_END % who for n in (("1. ", "2. ", "3. "), ("", "", "")) for who in ("HOLDER", "OWNER")),
    "MIT-0": (KNOWN["MIT"].replace(
        ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "."
    ),),
    "Zlib": ((
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
        "the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software "
        "in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),),
    "Unlicense": tuple(
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
        "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to "
        "the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        f"TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <{url}>"
        for url in ("http://unlicense.org/", "https://unlicense.org", "https://unlicense.org/")
    ),
    "BSL-1.0": ((
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
        "\"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom "
        "the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this "
        "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies "
        "or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL "
        "THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),),
}
#: Titles that go before a licence. Fixed values.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License", "MIT-0 License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License"),
}


def known_texts() -> list[tuple[str, str]]:
    """``(license, text)`` of every known text, with and without titles."""
    texts = [*KNOWN.items(), *((name, text) for name, forms in MORE.items() for text in forms)]
    texts += [(name, f"{title}\n\n{text}") for name, text in texts for title in TITLES.get(name, ())]
    return texts + [(path.stem, path.read_text(encoding="utf-8")) for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def canonical(text: Column) -> Column:
    """The canonical form of a licence text."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1"), COPYRIGHT_HEAD, "$1")
    out = F.trim(F.regexp_replace(out, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "))
    # whole words only: every word has a space on either side while spellings are folded
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """``license, digest`` of the known texts."""
    rows = spark.createDataFrame(sorted(known.items() if known else known_texts()), "license string, text string")
    rows = rows.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest")).where(F.col("digest") != F.sha2(F.lit(""), 256))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(spark: SparkSession, docs: DataFrame, *, known: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, license`` of every document; ``license`` is null where the whole text is no known licence."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(canonical(F.col(text_col)), 256).alias("digest"))
    # one row per known licence: a size fixed by the parameter
    return rows.join(F.broadcast(known_digests(spark, known)), "digest", "left").select("doc_id", "digest", "license")
