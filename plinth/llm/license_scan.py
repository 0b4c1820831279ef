"""License scan by canonical digest.

Texts are brought to a canonical form: lower case, punctuation and white space as single
blanks, equivalent spellings made one, and lines that claim a copyright left out: those that
begin with copyright, (c) or the sign, unless they go on like a known text.  A unit is
a run of lines, at most the whole text without its leading title lines; every run that has the
number of words and the first word of a known text is hashed and looked up among the digests
of known license texts and notices by a hash join, so a license is found wherever its lines
stand, over any number of paragraphs.  The known texts are a table (``known_table``, or the
caller's own); their digests are broadcast.

Units are named ``text`` (the whole text), ``paragraph`` (lines between empty lines), ``line``
and ``run`` (any other run of lines).

Defined results: null and empty texts, known or not, and known texts of claims alone match nothing; a unit found several times counts each
time, also inside a larger one; rows with equal id add up; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Set
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.shared import bounded_batches, texts_of
from plinth.staging import stage

# Spellings that count as equal.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "catalogue": "catalog", "categorise": "categorize", "centre": "center", "customise": "customize",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "http": "https", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed",
    "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# Names that notices use.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "MIT": ["the MIT License", "MIT License", "MIT"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "BSD-3-Clause"],
    "GPL-2.0": ["the GNU General Public License, version 2", "GPL-2.0"],
    "GPL-3.0": ["the GNU General Public License, version 3", "GPL-3.0"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPL-3.0"],
    "MPL-2.0": ["the Mozilla Public License, Version 2.0", "MPL-2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0"],
    "ISC": ["the ISC License", "ISC"],
}
NOTICES = (
    "Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}",
    "This file is licensed under {}", "SPDX-License-Identifier: {}",
)

# Titles that stand above license texts.
TITLES = (
    "License", "The MIT License (MIT)", "MIT License (MIT)", "ISC License (ISC)", "The 2-Clause BSD License",
    'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "The 3-Clause BSD License",
    'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License", "The BSD License",
    "BSD Zero Clause License", "Zero-Clause BSD", "Apache License", "Version 2.0, January 2004", "Apache License Version 2.0, January 2004",
    "http://www.apache.org/licenses/", "zlib License", "The zlib License", "zlib/libpng License", "GNU General Public License",
    "Version 2, June 1991", "Version 3, 29 June 2007", "GNU Lesser General Public License", "Mozilla Public License Version 2.0",
    "Creative Commons Legal Code", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal",
    "Attribution-ShareAlike 4.0 International", "Creative Commons Attribution-ShareAlike 4.0 International Public License",
)

# License texts; longer ones are the files of ``licenses``, from their first term to the last.
TEXTS = {
    "MIT": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
    "ISC": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
        IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "Zlib": """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software.
        3. This notice may not be removed or altered from any source distribution.""",
}

_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b == 10 or b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_SIGN = re.compile(rb"\W*?\(c\)", re.IGNORECASE)
# A claim inside a known text: a year or the place for one follows at once.
_DATED = re.compile(rb"(copyright|c)( copyright| c)? (\d{4}|y{2,4}|year)\b")
_EQUIVALENT = {a.encode(): b.encode() for a, b in EQUIVALENT.items()}
SENTENCE_WORDS = 8


def _lines(text: str) -> Iterator[tuple[list[bytes], bool]]:
    """The words of each line, and whether it begins with copyright, (c) or the sign, or reserves all rights."""
    raw = text.encode("utf-8", "surrogatepass").replace(b"\xc2\xa9", b"(c)")
    rows = raw.split(b"\n")
    for row, line in zip(rows, raw.translate(_PLAIN).split(b"\n")):
        words = line.split()
        first = words[0] if words else b""
        claim = first == b"copyright" or first == b"c" and bool(_SIGN.match(row)) or words == [b"all", b"rights", b"reserved"]
        yield [_EQUIVALENT.get(w, w) for w in words], claim


def canonical_lines(text: str, sentences: Set[bytes] = frozenset()) -> list[list[bytes]]:
    """The words of each line; an empty list for an empty line, none for a line that claims a copyright.

    A line that goes on like one of ``sentences`` belongs to a license and claims nothing.
    """
    return [words for words, claim in _lines(text) if not claim or b" ".join(words[:SENTENCE_WORDS]) in sentences]


def known_lines(text: str) -> list[list[bytes]]:
    """Canonical lines of a known text, without its leading titles; claims are the lines above it and dated ones."""
    lines = list(_lines(text))
    above = next((i for i, (words, claim) in enumerate(lines) if words and not claim and tuple(words) not in _TITLE_WORDS), 0)
    return [
        words for words, claim in lines[above:]
        if not claim or words[0] != b"all" and not _DATED.match(b" ".join(words))
    ]


def sentences_of(words: list[bytes]) -> Iterator[bytes]:
    """What a line of a known text that looks like a claim may begin with, wherever the text is wrapped."""
    for i, word in enumerate(words):
        if word in (b"copyright", b"c"):
            for n in range(1, SENTENCE_WORDS + 1):
                yield b" ".join(words[i : i + n])


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _joined(lines: list[list[bytes]]) -> list[bytes]:
    return [w for line in lines for w in line]


def _title_words() -> set[tuple[bytes, ...]]:
    forms = [*TITLES, *(f for forms in NAMES.values() for f in forms)]
    forms += [f.removeprefix("the ") for f in forms]
    return {tuple(_joined(canonical_lines(f))) for f in forms}


def _untitled(lines: list[list[bytes]]) -> int:
    """The first line that is neither empty nor a title; of titles alone the first."""
    full = [i for i, line in enumerate(lines) if line]
    return next((i for i in full if tuple(lines[i]) not in _TITLE_WORDS), full[0] if full else 0)


_TITLE_WORDS = _title_words()


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of the texts and notices known here."""
    texts = list(TEXTS.items())
    files = (f for f in resources.files(__package__).joinpath("licenses").iterdir() if f.name.endswith(".txt"))
    texts += [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(files, key=lambda f: f.name)]
    return texts + [(name, notice.format(form)) for name, forms in NAMES.items() for form in forms for notice in NOTICES]


def known_table(spark: SparkSession) -> DataFrame:
    """(license, text): the known texts as ``scan`` takes them; add rows to look for more."""
    return spark.createDataFrame(known_texts(), "license string, text string")


def _known_units(known: DataFrame) -> DataFrame:
    """(digest, license, n_words, first, sentences): one row for each distinct text of a license, with and without
    titles it repeats inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column("license").to_pylist(), texts_of(batch, "text")):
                body = known_lines(text)
                repeated = [tuple(x) in _TITLE_WORDS and not before for before, x in zip(body, body[1:])]
                for form in (body, body[:1] + [x for x, title in zip(body[1:], repeated) if not title]):
                    if words := _joined(form):
                        rows.append((_digest(words), name, len(words), words[0], sorted(set(sentences_of(words)))))
            digests, names, n, first, sentences = zip(*rows) if rows else ((),) * 5
            yield pa.record_batch({
                "digest": pa.array(digests, pa.binary()), "license": pa.array(names, pa.string()),
                "n_words": pa.array(n, pa.int32()), "first": pa.array(first, pa.binary()),
                "sentences": pa.array(sentences, pa.list_(pa.binary())),
            })

    source = known.select(F.col("license").cast("string"), F.col("text").cast("string"))
    return source.mapInArrow(run, "digest binary, license string, n_words int, first binary, sentences array<binary>").distinct()


def units_of(
    text: str, shapes: dict[bytes, list[int]], sentences: Set[bytes] = frozenset()
) -> Iterator[tuple[str, list[bytes]]]:
    """The runs of lines with a first word and a number of words of ``shapes``, each once, with their names."""
    lines = canonical_lines(text, sentences)
    full = [i for i, line in enumerate(lines) if line]
    ends, total = {}, 0  # number of words up to the end of a line -> the line
    for i in full:
        total += len(lines[i])
        ends[total] = i
    begin = 0
    whole = (_untitled(lines), full[-1]) if full else None
    for i in full:
        for n in shapes.get(lines[i][0], ()):
            j = ends.get(begin + n)
            if j is not None:
                opens = i == 0 or not lines[i - 1]
                closes = j + 1 == len(lines) or not lines[j + 1]
                if (i, j) == whole:
                    unit = "text"
                elif opens and closes and all(lines[i : j + 1]):
                    unit = "paragraph"
                else:
                    unit = "line" if i == j else "run"
                yield unit, _joined(lines[i : j + 1])
        begin += len(lines[i])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(id, license, unit, n_found): which known licenses a document states, where and how often.

    ``known`` has the columns ``license`` and ``text``; without it the texts of ``known_table`` are looked for.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    units = stage(_known_units(known_table(spark) if known is None else known), "known-licenses")
    shapes: dict[bytes, list[int]] = {}
    for n, first in units.select("n_words", "first").distinct().toLocalIterator():
        shapes.setdefault(bytes(first), []).append(n)
    sentences = units.select(F.explode("sentences").alias("words")).distinct().toLocalIterator()
    shared = spark.sparkContext.broadcast((shapes, frozenset(bytes(r.words) for r in sentences)))
    table = units.select("digest", F.col("license").alias("_license"))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, units, digests = [], [], []
            for i, text in enumerate(texts_of(batch, "text")):
                for unit, words in units_of(text, *shared.value):
                    at.append(i)
                    units.append(unit)
                    digests.append(_digest(words))
            yield pa.record_batch({
                "id": batch.column("id").take(pa.array(at, pa.int64())), "unit": pa.array(units, pa.string()),
                "digest": pa.array(digests, pa.binary()),
            })

    found = source.mapInArrow(run, f"id {id_type}, unit string, digest binary")
    return found.join(F.broadcast(table), "digest").groupBy(
        F.col("id").alias(id_col), F.col("_license").alias("license"), "unit"
    ).agg(F.count("*").alias("n_found"))
