"""License scan: sparse TF-IDF cosine of license files and headers to templates, then inheritance from ancestor directories.

Templates are whole license texts (``license_texts/``, one file a license), the notices that the licenses ask for at the top
of files, and the short statements that files make of a license. What is compared with them, as sparse TF-IDF vectors
(inverse document frequencies over the templates; a word that no template has weighs as much as the rarest one):

* a file as a whole, with all templates;
* its header, the comment that it begins with, without comment marks, with all templates;
* its paragraphs that mention a license, with notices and statements;
* its sentences and lines that mention a license, with statements.

White space, and so the wrapping of lines, makes no difference. The best template of at least ``threshold`` gives the
file's own license. A file of which at least half of the words is license is a license file: it licenses its directory.
Files without a license of their own take that of the nearest ancestor directory that has one: each directory is joined with
its ancestors' paths, and the deepest match wins.

Edge cases: null and empty texts have no license of their own but inherit; a null path inherits nothing; of several
license files in a directory the most similar one counts (ties: the smaller license name, then path); of equally similar
templates the smaller license name; repeated rows get equal results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from voxloom.llm.common import bounded_batches, materialize, maybe_broadcast

TEXT, NOTICE, STATEMENT = 1, 2, 4
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software "
    "Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
    "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. "
    "You should have received a copy of the GNU {0}General Public License along with this program. If not, see https://www.gnu.org/licenses/."
)
#: Notices at the top of files (fixed values: the licenses' own wording).
NOTICES = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
        "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
        "permissions and limitations under the License.",
    ),
    "GPL-2.0": (_GNU.format("", 2),),
    "GPL-3.0": (_GNU.format("", 3),),
    "LGPL-2.1": (_GNU.format("Lesser ", "2.1"),),
    "LGPL-3.0": (_GNU.format("Lesser ", 3),),
    "AGPL-3.0": (_GNU.format("Affero ", 3),),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one "
        "at https://mozilla.org/MPL/2.0/.",
    ),
}
#: What short statements say.
STATEMENTS = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Licensed under Apache 2.0."),
    "MIT": ("Released under the MIT License.", "SPDX-License-Identifier: MIT", "This software is licensed under the terms of the MIT license."),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "GPL-2.0": ("This program is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"),
    "MPL-2.0": ("Subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "BSD-3-Clause": ("Distributed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "BSD-2-Clause": ("Distributed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": ("Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"),
}
MENTION = re.compile(r"[Ll]icen[cs]|LICEN[CS]|SPDX|[Cc]reative [Cc]ommons|[Pp]ublic [Dd]omain|[Rr]edistribut|[Pp]ermission")
SENTENCE_END = re.compile(r"\n|(?<=[.!?;])[ \t\r]+")
PARAGRAPH_END = re.compile(r"\n[ \t\r]*\n")
TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: A line of a comment, its marks taken off; lines between the marks of a block comment count as its lines.
COMMENT = re.compile(r"[ \t]*(?:#+!?|//+!?|--+|;+|%+|\*+(?!/)|/\*+!?|<!--+|\"\"\"|''')[ \t]?(.*)")
COMMENT_END = re.compile(r"\*+/|--+>|\"\"\"|'''")
THRESHOLD = 0.75


def templates(folder: str | Path = Path(__file__).with_name("license_texts")) -> list[tuple[str, int, str]]:
    """(license, kind, text) of all templates."""
    found = [(f.stem, TEXT, f.read_text(encoding="utf-8")) for f in sorted(Path(folder).glob("*.txt"))]
    for kind, table in ((NOTICE, NOTICES), (STATEMENT, STATEMENTS)):
        found += [(name, kind, text) for name, texts in table.items() for text in texts]
    return found


class Index:
    """Templates as sparse unit vectors, by word."""

    def __init__(self, rows: list[tuple[str, int, str]]):
        bags = [Counter(TOKEN.findall(text.lower())) for _, _, text in rows]
        frequency = Counter(t for bag in bags for t in bag)
        self.names, self.kinds = [r[0] for r in rows], [r[1] for r in rows]
        self.unknown = math.log((1 + len(bags)) / 2) + 1
        self.idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in frequency.items()}
        self.at: dict[str, list[tuple[int, float]]] = {}
        for k, bag in enumerate(bags):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in bag.items()))
            for t, n in bag.items():
                self.at.setdefault(t, []).append((k, n * self.idf[t] / norm))

    def nearest(self, words: list[str], kinds: int, threshold: float) -> tuple[float, str] | None:
        """(similarity, license) of the nearest template of these kinds, if it is near enough."""
        square, dots = 0.0, [0.0] * len(self.names)
        for word, n in Counter(words).items():
            weight = n * self.idf.get(word, self.unknown)
            square += weight * weight
            for k, v in self.at.get(word, ()):
                dots[k] += weight * v
        if not square:
            return None
        norm = math.sqrt(square)
        best = min(((-round(d / norm, 9), name) for d, name, kind in zip(dots, self.names, self.kinds, strict=True) if kind & kinds), default=None)
        return (-best[0], best[1]) if best and -best[0] >= threshold else None


def header_of(text: str) -> str:
    """The comment that a text begins with (after a first line of ``#!``), without its marks."""
    out, inside, lines = [], False, text.split("\n")
    for k, line in enumerate(lines):
        if k == 0 and line.startswith("#!"):
            continue
        if not line.strip():
            if out:
                out.append("")
            continue
        found = COMMENT.fullmatch(line)
        if not found and not inside:
            break
        body = found[1] if found else line
        opens = line.lstrip().startswith(("/*", "<!--", '"""', "'''"))
        closed = COMMENT_END.search(body)
        out.append(COMMENT_END.sub(" ", body))
        inside = (inside or opens) and not closed
    return "\n".join(out).strip()


def own_license(text: str, index: Index, threshold: float = THRESHOLD) -> tuple[str | None, float | None, int]:
    """(license, similarity, words of license) of a text."""
    tokens = lambda s: TOKEN.findall(s.lower())
    size = lambda s: len(s.split())
    found, words = [], 0
    if whole := index.nearest(tokens(text), TEXT | NOTICE | STATEMENT, threshold):
        found.append(whole)
        words = size(text)
    header = header_of(text)
    if header and (best := index.nearest(tokens(header), TEXT | NOTICE | STATEMENT, threshold)):
        found.append(best)
        words = max(words, size(header))
    if MENTION.search(text):
        for end, kinds in ((PARAGRAPH_END, NOTICE | STATEMENT), (SENTENCE_END, STATEMENT)):
            said = [(best, size(s)) for s in end.split(text) if MENTION.search(s) and (best := index.nearest(tokens(s), kinds, threshold))]
            found += [best for best, _ in said]
            words = max(words, sum(n for _, n in said))
    if not found:
        return None, None, 0
    similarity, name = min(found, key=lambda x: (-x[0], x[1]))
    return name, similarity, words


def own_licenses(files: DataFrame, threshold: float = THRESHOLD, rows: list[tuple[str, int, str]] | None = None) -> DataFrame:
    """(path, license, similarity, license_words, n_words) of each of (path, text), in one pass over the texts; further columns
    of files come after these."""
    spark = files.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Index(templates() if rows is None else rows))  # bounded by the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [own_license(t, index, threshold) if t else (None, None, 0) for t in texts]
            name, similarity, words = zip(*found, strict=True) if found else ((), (), ())
            columns = [pa.array(name, pa.string()), pa.array(similarity, pa.float64()), pa.array(words, pa.int64()), pa.array([len((t or "").split()) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:]], ["path", "license", "similarity", "license_words", "n_words", *more])

    more = [c for c in files.columns if c not in ("path", "text")]
    files = files.select("path", "text", *more)
    schema = files.selectExpr("path", "'' AS license", "0D AS similarity", "0L AS license_words", "0L AS n_words", *(f"`{c}`" for c in more)).schema
    return files.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in schema]))


def ancestors(path: Column) -> Column:
    """Directories above a path, the nearest first, down to the root ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def inherit(placed: DataFrame) -> DataFrame:
    """(path, license, similarity, license_from, effective_license) from what own_licenses gives, by joins of paths; further
    columns of placed come after these."""
    more = [c for c in placed.columns if c not in ("path", "license", "similarity", "license_words", "n_words")]
    placed = placed.withColumn("home", F.when(F.col("path").isNotNull(), F.get(ancestors(F.col("path")), 0)))
    givers = (
        placed.filter(F.col("license").isNotNull() & F.col("path").isNotNull() & (2 * F.col("license_words") >= F.col("n_words")))
        .groupBy(F.col("home").alias("directory"))
        .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license", "path")).alias("g"))
        .select("directory", F.col("g.license").alias("given"), F.col("g.path").alias("giver"))
    )
    givers = materialize(givers, "license-dirs")
    # a directory stands for all files in it, so ancestors are looked up once a directory
    homes = placed.filter(F.col("home").isNotNull()).select("home").distinct()
    above = F.when(F.col("home") == "", F.array().cast("array<string>")).otherwise(ancestors(F.col("home")))
    chain = homes.select("home", F.posexplode(F.concat(F.array("home"), above)).alias("up", "directory"))
    heirs = chain.join(maybe_broadcast(givers, givers.count(), 200_000), "directory").groupBy("home").agg(F.min_by(F.struct("given", "giver"), "up").alias("h"))
    heirs = materialize(heirs, "license-heirs")
    out = placed.join(maybe_broadcast(heirs, heirs.count(), 200_000), "home", "left")
    inherits = F.col("license").isNull() & F.col("h").isNotNull()
    return out.select(
        "path", "license", "similarity", F.when(F.col("license").isNotNull(), F.col("path")).when(inherits, F.col("h.giver")).alias("license_from"),
        F.coalesce("license", F.col("h.given")).alias("effective_license"), *more,
    )


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, similarity, license_from, effective_license) for each file."""
    rows = files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    return inherit(materialize(own_licenses(rows, threshold), "licenses"))  # texts are read once


def scan_documents(docs: DataFrame) -> DataFrame:
    """scan over documents, whose path is ``source/lang/doc_id`` (with / as %2F and % as %25 in each): (doc_id, license, similarity, license_from, effective_license)."""
    step = lambda c, none: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit(none)), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    path = F.concat(step("source", "_"), F.lit("/"), step("lang", "_"), F.lit("/"), step("doc_id", ""))
    rows = docs.select(path.alias("path"), F.col("text").cast("string").alias("text"), F.col("doc_id").alias("doc_id"))
    found = inherit(materialize(own_licenses(rows), "licenses"))
    return found.select("doc_id", "license", "similarity", "license_from", "effective_license")
