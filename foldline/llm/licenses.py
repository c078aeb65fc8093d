"""Licence scan by canonical digest, in SQL functions alone.

A text is normalised: letters A-Z in lower case, lines that are copyright notices dropped, everything but letters,
digits and characters outside ASCII made one space (typographic quotes and dashes too), and equivalent spellings
replaced word by word. The SHA-256 of the whole normalised text is joined by hash with the digests of known
licences and notices, which come from the fixed texts below or a table that is given; it is small and broadcast.

That finds texts that are a licence and nothing else. Each line is normalised and looked up by its digest as well,
which finds notices of one line in longer texts. ``notices`` also finds licences and notices within longer
texts: a run of whole lines, or of whole paragraphs however their lines are broken, that reads like a known text
after the same normalisation. It compares the normalised texts themselves, not digests.

Defined cases: null and empty texts, and texts of which nothing is left, have the digest of the empty text and no
licence; repeated rows are repeated; a null id stays; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import string
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTICE = r"(^|\n)[ \t*#/;>-]*((copyright[ \t]*)?(\(c\)|©)|copyright[ \t]+(<|\[|by[ \t]|[0-9])|all rights reserved)[^\n]*"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F ‐-―‘-‟•…]+"
#: Equivalent spellings, each as it reads after punctuation has gone; fixed values.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("organisation", "organization"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("whilst", "while"),
    ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("copyright holder", "copyright owner"),
    ("http", "https"), ("v 2", "version 2"), ("v 3", "version 3"),
)

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Known licences and notices: (SPDX id, text); fixed values.
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AS_IS),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


#: Full texts, a file each, named by its SPDX id.
TEXTS = Path(__file__).with_name("license_texts")
#: Ends of a line and of a paragraph in normalised texts; a text's own ones count as spaces.
LINE, PARAGRAPH = "\ue000", "\ue001"


def full_texts(path: Path = TEXTS) -> list[tuple[str, str]]:
    """(SPDX id, text) of the full texts, without what follows the end of their terms."""
    return [(f.stem, f.read_text().split("END OF TERMS AND CONDITIONS")[0]) for f in sorted(path.glob("*.txt"))]


def _words(text: Column) -> Column:
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), NOT_WORD, " ")


def _spelled(words: Column) -> Column:
    for old, new in SPELLINGS:
        words = F.replace(words, F.lit(f" {old} "), F.lit(f" {new} "))
    return words


def normalised(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(_spelled(_words(F.regexp_replace(low, NOTICE, "\n"))))


def marked(text: Column) -> Column:
    """Words of a text with LINE at each end of a line."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + LINE + PARAGRAPH, string.ascii_lowercase + "  ")
    return _words(F.regexp_replace(F.regexp_replace(low, NOTICE, "\n"), r"\r\n|\r|\n", f" {LINE} "))


def by_line(words: Column) -> Column:
    """LINE, then each line that holds a word and LINE behind it."""
    return F.trim(_spelled(F.regexp_replace(F.concat(F.lit(f" {LINE}"), words, F.lit(f"{LINE} ")), f"{LINE}( {LINE})+", LINE)))


def by_paragraph(words: Column) -> Column:
    """PARAGRAPH, then each paragraph as one line and PARAGRAPH behind it; lines without a word part paragraphs."""
    ends = F.regexp_replace(F.concat(F.lit(f" {LINE} {LINE}"), words, F.lit(f"{LINE} {LINE} ")), f"{LINE}( {LINE})+", PARAGRAPH)
    return F.trim(_spelled(F.replace(ends, F.lit(f" {LINE} "), F.lit(" "))))


def known(like: DataFrame, table: Iterable[tuple[str, str]] = KNOWN) -> DataFrame:
    """license_digest, license: the table by digest."""
    rows = like.sparkSession.createDataFrame(list(table), "license string, body string")
    return rows.select(F.sha2(normalised(F.col("body")).cast("binary"), 256).alias("license_digest"), "license").dropDuplicates(["license_digest"])


def _digest(words: Column) -> Column:
    return F.sha2(words.cast("binary"), 256)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: Iterable[tuple[str, str]] = KNOWN) -> DataFrame:
    """Per document: doc_id, digest of its normalised text, license (null if none is known by it), licensed, and lines:
    the sorted ids of known texts that are whole lines of it.

    Lines are looked up by their digests too, in a map of the table's, which has a few rows; a text is read once.
    """
    found = F.broadcast(known(docs, table))
    names = {r["license_digest"]: r["license"] for r in known(docs, table).collect()}  # a row a known text
    by_digest = F.from_json(F.lit(json.dumps(names)), "map<string,string>")  # folded into one literal
    words = F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("whole"), words.alias("low"))
    lines = F.transform(F.split(F.regexp_replace("low", NOTICE, "\n"), r"\r\n|\r|\n"), lambda x: _digest(F.trim(_spelled(_words(x)))))
    named = F.array_sort(F.array_distinct(F.array_compact(F.transform(lines, lambda x: F.element_at(by_digest, x)))))
    rows = rows.select("doc_id", _digest(F.col("whole")).alias("digest"), named.alias("lines"))
    rows = rows.join(found, rows["digest"] == found["license_digest"], "left")
    return rows.select("doc_id", "digest", "license", F.col("license").isNotNull().alias("licensed"), "lines")


def notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """Per document: doc_id, licenses (sorted ids of all known texts that it holds), licensed. table: (id, text); the
    fixed and the full texts if none is given."""
    bodies = docs.sparkSession.createDataFrame([*KNOWN, *full_texts()] if table is None else list(table), "license string, body string")
    bodies = bodies.filter(normalised(F.col("body")) != "").select("license", marked(F.col("body")).alias("words"))
    one = bodies.agg(F.collect_list(F.struct("license", by_line(F.col("words")).alias("lines"), by_paragraph(F.col("words")).alias("paragraphs"))).alias("bodies"))
    words = docs.select(F.col(id_col).alias("doc_id"), marked(F.col(text_col)).alias("words"))
    # Joined before the search, so that a text is normalised once and not for each body; the table is one row.
    rows = words.select("doc_id", by_line(F.col("words")).alias("lines"), by_paragraph(F.col("words")).alias("paragraphs")).crossJoin(F.broadcast(one))
    held = F.filter("bodies", lambda b: F.contains(F.col("lines"), b["lines"]) | F.contains(F.col("paragraphs"), b["paragraphs"]))
    rows = rows.select("doc_id", F.array_sort(F.array_distinct(F.transform(held, lambda b: b["license"]))).alias("licenses"))
    return rows.select("doc_id", "licenses", (F.size("licenses") > 0).alias("licensed"))
