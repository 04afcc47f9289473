"""License scan: sparse TF-IDF cosine of headers and licence files to templates, and inheritance from the nearest directory.

What is compared are a file's notices: every paragraph that holds an anchor word (license, copyright, SPDX, ...), with comment
marks taken off and wrapped lines joined; each single line of it that holds one; the file's whole leading comment; and, of a
licence file (by its name), the whole text. Templates are whole short licences, the standard headers and titles of
long ones, and customary notices. Terms weigh by their inverse document frequency over all files of the input; words outside the
templates lengthen a notice's vector, so prose that mentions a licence is far from it. The template with the
highest cosine wins, ties going to the smaller name, if it reaches the threshold.

A file without a licence of its own inherits that of the nearest directory above it (its own first) with a licence
file: distinct directories are joined by path to the directories that declare one, the deepest match wins, and files are
joined to their directory's result. Only (repo, path) rows are shuffled, never texts, and directories of very many files, or
above very many directories, are met by a broadcast, so none of them lands in one task.

Templates are a fixed list, so their broadcast has a fixed size. Defined results: null or empty texts have no notice
and score 0; a null repo or path is ''; several licence files of a directory: the highest score, then the smallest
name; repeated rows are separate files; a very long text is read whole; an empty table gives no rows; other columns of files
are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_to_unique, map_arrow, slices, stored

TERM = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)*")
ANCHOR = re.compile(r"licen[sc]e|copyright|copyleft|spdx|public domain|all rights reserved|warranty|permission|redistribut|creative commons|cc0", re.I)
LICENSE_FILE = re.compile(r"(?:^|/)(?:un)?(?:licen[sc]e|copying|notice)[^/]*$", re.I)
#: Marks of a comment at the begin and the end of a line.
COMMENT = re.compile(r"^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--|\"\"\"|dnl\b|rem\b)?[ \t]*|[ \t]*(?:\*+/|-->)?[ \t\r]*$", re.I)
COPYRIGHT_LINE = re.compile(r"(?:©|copyright\b)(?!.*(?:licen[sc]e|all rights reserved)).*", re.I)

# Wording of public licences.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""


def _gnu(name: str, version: str, title: str) -> list[str]:
    """The standard header of a GNU licence, whole and by its paragraphs, its title, and customary notices."""
    grant = f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    only = f"This program is free software; you can redistribute it and/or modify it under the terms of the {name} version {version} as published by the Free Software Foundation."
    no_warranty = f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    copy = f"You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    return ["\n".join((grant, no_warranty, copy)), grant, only, title, f"This work is licensed under the {name}, version {version}.", f"Released under the {name} v{version}."]


def _creative(name: str, short: str, url: str) -> list[str]:
    return [f"Licensed under {short}.", f"This work is licensed under a Creative Commons {name} International License.", f"This work is licensed under the Creative Commons {name} International License. To view a copy of this license, visit {url} or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."]


TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "Apache-2.0": [_APACHE, _APACHE.split("\n")[0], "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Licensed under the Apache License, Version 2.0."],
    "BSD-2-Clause": [f"{_BSD_2}\n{_BSD_AS_IS}", _BSD_2, "BSD 2-Clause License", "Released under the BSD 2-Clause License."],
    "BSD-3-Clause": [f"{_BSD_2}\n{_BSD_3}\n{_BSD_AS_IS}", f"{_BSD_2}\n{_BSD_3}", _BSD_3, "BSD 3-Clause License", "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSL-1.0": [_BOOST, _BOOST.split("\n")[0], "Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "CC-BY-4.0": _creative("Attribution 4.0", "CC BY 4.0", "http://creativecommons.org/licenses/by/4.0/"),
    "CC-BY-NC-4.0": _creative("Attribution-NonCommercial 4.0", "CC BY-NC 4.0", "http://creativecommons.org/licenses/by-nc/4.0/"),
    "CC-BY-SA-4.0": _creative("Attribution-ShareAlike 4.0", "CC BY-SA 4.0", "http://creativecommons.org/licenses/by-sa/4.0/"),
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0.", "CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."],
    "GPL-2.0": _gnu("GNU General Public License", "2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "GPL-3.0": _gnu("GNU General Public License", "3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "ISC": [f"{_ISC}\n{_ISC_AS_IS}", _ISC, "ISC License", "Released under the ISC License."],
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "MIT": [f"{_MIT}\n{_AS_IS}", _MIT, _MIT.split("\n")[0], "MIT License", "Released under the MIT License."],
    "MPL-2.0": [_MPL, "Mozilla Public License Version 2.0", "This file is licensed under the Mozilla Public License, version 2.0."],
    "Proprietary": ["Copyright. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited without written permission."],
    "Unlicense": [_UNLICENSE, _UNLICENSE.split("\n")[0]],
    "Zlib": [_ZLIB, "zlib License"],
}
for _name, _texts in TEMPLATES.items():
    if _name != "Proprietary":
        _texts.append(f"SPDX-License-Identifier: {_name}")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class Matcher:
    """Cosines to the templates under given inverse document frequencies."""

    def __init__(self, idf: dict[str, float], templates: dict[str, list[str]]):
        self.idf = idf
        self.other = sum(idf.values()) / len(idf) if idf else 1.0
        self.index: dict[str, list[tuple[int, float]]] = {}
        self.names: list[str] = []
        for name in sorted(templates):
            for text in templates[name]:
                vector, length = self._vector(text)
                for t, w in vector.items():
                    self.index.setdefault(t, []).append((len(self.names), w / length))
                self.names.append(name)

    def _vector(self, text: str) -> tuple[dict[str, float], float]:
        v = {t: (1 + math.log(n)) * self.idf.get(t, self.other) for t, n in Counter(terms(text)).items()}
        return v, math.sqrt(sum(w * w for w in v.values()))

    def best(self, text: str) -> tuple[float, str]:
        v, length = self._vector(text)
        dots: dict[int, float] = {}
        for t, w in v.items():
            for i, u in self.index.get(t, ()):
                dots[i] = dots.get(i, 0.0) + w * u
        if not dots:
            return 0.0, ""
        top = max(dots.values())
        return min(1.0, top / length), min(self.names[i] for i, d in dots.items() if d >= top - 1e-12)

    def file(self, path: str, text: str) -> tuple[float, str]:
        score, name = 0.0, ""
        for s, n in map(self.best, dict.fromkeys(notices(path, text))):
            if s > score or s == score and s and n < name:
                score, name = s, n
        return score, name


def notices(path: str, text: str) -> Iterator[str]:
    """The units of a file that are compared with templates."""
    if not ANCHOR.search(text):
        return
    block: list[str] = []
    leading: list[str] | None = []  # the comment at the file's head
    inside = False
    for line in [*text.split("\n"), ""]:
        bare = COMMENT.sub("", line)
        if leading is not None:
            inside = (inside or "/*" in line) and "*/" not in line
            if inside or not bare or bare != line.strip() or not any(c.isalnum() for c in bare):
                leading.append(bare)
            else:
                yield from _unit(leading)
                leading = None
        if bare and any(c.isalnum() for c in bare):
            block.append(bare)
        elif block:
            yield from _unit(block)
            block = []
    if leading:
        yield from _unit(leading)
    if LICENSE_FILE.search(path):
        yield from _unit(text.split("\n"))


def _unit(lines: list[str]) -> Iterator[str]:
    """A block of lines, without those that only name who holds the copyright, and its lines with an anchor word."""
    whole = " ".join(lines)
    if not ANCHOR.search(whole):
        return
    yield whole
    rest = [x for x in lines if not COPYRIGHT_LINE.fullmatch(x.strip())]
    if len(rest) < len(lines):
        yield " ".join(rest)
    for x in lines:
        if ANCHOR.search(x):
            yield x


def vocabulary(templates: dict[str, list[str]]) -> set[str]:
    return {t for texts in templates.values() for x in texts for t in terms(x)}


def inverse_frequencies(files: DataFrame, templates: dict[str, list[str]]) -> dict[str, float]:
    """log((1 + files) / (1 + files with the term)) + 1 of each template term, over all files."""
    words = vocabulary(templates)
    kinds = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter({"": 0})
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[""] += 1
                if text:
                    total.update(words.intersection(terms(text)))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema=kinds)

    seen = {r[0]: r[1] for r in map_arrow(files.selectExpr("cast(text as string) text"), count, "term string, n long").groupBy("term").agg(F.sum("n")).collect()}
    n = seen.get("", 0)
    return {t: math.log((1 + n) / (1 + seen.get(t, 0))) + 1 for t in sorted(words)}


def scan_licenses(files: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = 0.75) -> DataFrame:
    """files: doc_id, repo, path, text. Returns doc_id, repo, path, own_license, own_score, license, origin, from_dir."""
    templates = templates or TEMPLATES
    idf = inverse_frequencies(files, templates)
    kinds = pa.schema([("doc_id", pa.int64()), ("repo", pa.string()), ("path", pa.string()), ("own_license", pa.string()), ("own_score", pa.float64()), ("declares", pa.bool_())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(idf, templates)
        for batch in (s for b in batches for s in slices(b)):
            paths = batch.column(2).to_pylist()
            found = [matcher.file(p, t) if t else (0.0, "") for p, t in zip(paths, batch.column(3).to_pylist())]
            own = [n if s >= threshold else None for s, n in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(own, pa.string()), pa.array([s for s, _ in found], pa.float64()), pa.array([bool(o and LICENSE_FILE.search(p)) for o, p in zip(own, paths)], pa.bool_())], schema=kinds)

    plain = files.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(repo as string), '') repo", "coalesce(cast(path as string), '') path", "cast(text as string) text")
    scanned = stored(map_arrow(plain, match, "doc_id long, repo string, path string, own_license string, own_score double, declares boolean"), "license-scan")
    return inherit(scanned)


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds license, origin (own, inherited, none) and from_dir to scanned files."""
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    d = scanned.withColumn("dir", directory)
    top = d.where("declares").groupBy("repo", "dir", "own_license").agg(F.max("own_score").alias("own_score"))
    best = F.min(F.struct((-F.col("own_score")).alias("s"), "own_license"))
    says = stored(top.groupBy("repo", "dir").agg(best["own_license"].alias("said")).select("repo", F.col("dir").alias("up"), "said"), "declared")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = stored(d.select("repo", "dir").distinct().select("repo", "dir", F.posexplode(F.array_distinct(above)).alias("depth", "up")), "directories")
    found = join_to_unique(dirs, says, ["repo", "up"], "inner")
    near = stored(found.groupBy("repo", "dir").agg(F.max(F.struct("depth", "said", "up")).alias("m")), "nearest")
    out = join_to_unique(d, near, ["repo", "dir"], "left")
    return out.select(
        "doc_id", "repo", "path", "own_license", "own_score",
        F.coalesce("own_license", "m.said").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(F.col("m").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own_license").isNull(), F.col("m.up")).alias("from_dir"),
    )
