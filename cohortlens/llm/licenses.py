"""Whole texts that are known licences, found by canonical digests."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.bounded import lookup
from cohortlens.llm.common import only

# Spellings that count as the same, as patterns over lower-case words and what they become.
SPELLINGS = (
    ("licenc(e|ing)", "licens", 1),
    ("sub licens", "sublicens", 0),
    ("non commercial", "noncommercial", 0),
    ("(fav|behavi|col|hon)our", "or", -1),
    ("(organi|authori|recogni|utili)s(e|ing|ation)", "z", 2),
    ("acknowledgement", "acknowledgment", 0),
    ("(per cent|percent)", "percent", 0),
    ("https", "http", 0),
)

# Texts of short licences and of the notices that name some.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
LICENSES = {
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_WARRANTY}",
    "BSD-2-Clause": f"{_BSD_HEAD}\n{_BSD_TAIL}",
    "BSD-3-Clause": f"{_BSD_HEAD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{_BSD_TAIL}",
    "ISC": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_WARRANTY}",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
}

# Patterns of the rule for rights statements, for Java and, without possessive marks, for the SQL. No group is repeated
# over text of any length and no two repeats can share characters, so that lines of any length take linear time.
_SPACE = "[ \\t\\n\\r\\f]"
_MARGIN = "[#*;/ \\t]*+"
_BLANK = "[#*;/ \\t\\r]*+"
_YEAR = "([\\[<{]?(19|20)[0-9]{2}|[\\[<{]?(19|20)?yy|[\\[<{]year)"
#: Words after "copyright" that are terms and name no holder.
_TERMS = "holders?|owners?|notices?|laws?|licens[a-z]*|licenc[a-z]*|and|or|in|is|are|to|of|for|on|that|which|this|statements?|interests?|permissions?|protection|rights?"

#: Done on the text before it is cut in lines: rights statements within licence texts are taken out wherever their lines
#: are cut, and the words "all rights reserved" at the end of a line are put on one line.
_TEXT_RULES = (
    (f"copyright{_SPACE}*+(\\(c\\)|©){_SPACE}*+[0-9][0-9, \\t\\n\\r\\f]*+free{_SPACE}++software{_SPACE}++foundation,?{_SPACE}++inc[.]?({_SPACE}*<?https?://[^ \\t\\n\\r\\f<>]*+>?)?", " "),
    (f"copyright{_SPACE}*+(\\(c\\)|©)?{_SPACE}*+[\\[<{{]?(yyyy|19yy|20yy|year)[\\]>}}]?{_SPACE}++[\\[<{{]?(your{_SPACE}++)?name({_SPACE}+of{_SPACE}++(the{_SPACE}++)?(author|copyright{_SPACE}++owner))?[\\]>}}]?", " "),
    (f"all{_SPACE}++rights{_SPACE}++reserved([^\\p{{L}}\\p{{N}}\\n]*+(\\n|$))", "all rights reserved@1"),
)
#: Done on lines, each between two line feeds of its own: lines that name a holder go, and those that say only that all
#: rights are reserved. What begins like a holder's line but goes on with a word of the terms is marked and stays.
_LINE_RULES = (
    (f"\\n{_MARGIN}copyright[ \\t:,]*(by[ \\t]+)?(\\(c\\)|©|&copy;|{_YEAR})[^\\n]*+\\n", ""),
    (f"\\n{_MARGIN}(©|\\(c\\)[ \\t]*+(copyright[ \\t]*+)?{_YEAR})[^\\n]*+\\n", ""),
    (f"\\n{_MARGIN}all rights reserved[^\\p{{L}}\\p{{N}}\\n]*+\\n", ""),
    (f"\\n({_MARGIN})copyright([ \\t]+({_TERMS})([^a-z0-9_]))", "\n@1~copyright@2"),
)
#: A holder without year or sign counts only where a paragraph begins, with the lines like it that follow at once.
_BARE = f"\\n{_MARGIN}copyright([: \\t][^\\n]*+)?\\n"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words with one space between, one spelling of each.

    Lines of the terms may be wrapped anywhere. A holder is named on lines of its own; where the terms go on in
    the holder's line, their beginning cannot be told and the line goes with them.
    """
    x = F.lower(text)
    for pattern, new in _TEXT_RULES:
        x = F.regexp_replace(x, pattern, new.replace("@", "$"))
    x = F.concat(F.lit("\n\n\n"), F.replace(x, F.lit("\n"), F.lit("\n\n")), F.lit("\n"))
    for pattern, new in _LINE_RULES:
        x = F.regexp_replace(x, pattern, new.replace("@", "$"))
    x = F.regexp_replace(x, f"(?:\\n{_BLANK}\\n|\\G){_BARE}", "\n\n")
    x = F.regexp_replace(x, "[^\\p{L}\\p{N}]+", " ")
    for pattern, new, group in SPELLINGS:
        x = F.regexp_replace(x, pattern, _template(new, group, "$"))
    return F.trim(x)


def _template(new: str, group: int, mark: str) -> str:
    """Replacement text; ``group`` 1: kept after it, -1: before it, 2: around it, 0: neither."""
    return {0: new, 1: f"{new}{mark}1", -1: f"{mark}1{new}", 2: f"{mark}1{new}{mark}2"}[group]


#: Standard texts in full, one file for each; the name of the file is that of the licence.
TEXTS = Path(__file__).parent / "license_texts"
_END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def known_licenses(spark: SparkSession) -> DataFrame:
    """The short licences above and the standard texts, each with and without what follows the end of its terms."""
    rows = list(LICENSES.items())
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        terms, end, _ = text.partition(_END_OF_TERMS)
        rows += [(path.stem, text)] + [(path.stem, terms + end), (path.stem, terms)] * bool(end)
    return spark.createDataFrame(rows, "license_id string, text string")


def scan(
    docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, digest, license_id) for every row of ``docs``.

    ``digest`` is the SHA-256 of the canonical whole text, ``license_id`` the licence (license_id, text) with the same one, or null;
    of licences with equal canonical texts the smallest name. Texts without a word, null ones among them, have the digest
    of the empty text and match nothing. Null ids and repeated rows are kept. The licences are sent to all tasks only if
    they are few (checked); a larger catalogue is joined by a shuffle on the digest.
    """
    if licenses is None:
        licenses = known_licenses(docs.sparkSession)
    known = licenses.select("license_id", canonical(F.coalesce("text", F.lit(""))).alias("t")).where("t <> ''")
    known = known.groupBy(F.sha2("t", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    rows = only(docs, id=id_col, text=text_col)
    rows = rows.select("id", F.sha2(canonical(F.coalesce("text", F.lit(""))), 256).alias("digest"))
    return rows.join(lookup(known), "digest", "left").select("id", "digest", "license_id")


def _sql_text(column: str) -> str:
    def quote(pattern: str) -> str:
        return pattern.replace("*+", "*").replace("++", "+").replace("'", "''")

    def replaced(x: str, pattern: str, new: str) -> str:
        return f"regexp_replace({x}, '{quote(pattern)}', '{new.replace('@', chr(92))}', 'g')"

    x = f"lower(coalesce({column}, ''))"
    for rule in _TEXT_RULES:
        x = replaced(x, *rule)
    x = f"concat(repeat(chr(10), 3), replace({x}, chr(10), repeat(chr(10), 2)), chr(10))"
    for rule in _LINE_RULES:
        x = replaced(x, *rule)
    x = replaced(x, f"(\\n{_BLANK}\\n)({_BARE})+", "@1")
    x = replaced(x, "[^\\p{L}\\p{N}]+", " ")
    for pattern, new, group in SPELLINGS:
        x = replaced(x, pattern, _template(new, group, "@"))
    return f"trim({x})"


def sql() -> str:
    """The same rule and the same catalogue, for DuckDB."""
    texts = list(LICENSES.items()) + [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in texts)
    return f"""
WITH given AS (
  SELECT * FROM (VALUES {values}) AS v(license_id, text)
), variants AS (
  SELECT * FROM given
  UNION ALL SELECT license_id, split_part(text, '{_END_OF_TERMS}', 1) || '{_END_OF_TERMS}' FROM given WHERE contains(text, '{_END_OF_TERMS}')
  UNION ALL SELECT license_id, split_part(text, '{_END_OF_TERMS}', 1) FROM given WHERE contains(text, '{_END_OF_TERMS}')
), known AS (
  SELECT sha256({_sql_text('text')}) AS digest, min(license_id) AS license_id FROM variants GROUP BY 1
), d AS (
  SELECT doc_id, sha256({_sql_text('text')}) AS canonical_sha256 FROM documents
)
SELECT doc_id, canonical_sha256, license_id FROM d LEFT JOIN known ON digest = canonical_sha256
"""
