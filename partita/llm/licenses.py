"""Licence scans: Dice similarity of word bigrams between stretches of a text and licence templates.

For a template of a bigrams and a threshold t, a stretch of b bigrams can only reach t if
b lies between a t / (2 - t) and a (2 - t) / t, and only with at least a t / (2 - t) bigrams in
common.  A text that shares fewer bigrams with a template is done with it after one pass over its words;
for the others every stretch between two shared bigrams whose size is within the bounds is compared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import normalise
from .shared import ship, table

THRESHOLD = 0.8

#: Texts of public licences and the notices that refer to them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.""",
    "BSD-3-Clause": """Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser
General Public License for more details.""",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser
General Public License for more details.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero
General Public License for more details.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote
the original software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. This notice may not be removed or altered from any source
distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the
Software and this entire statement, including the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless
such copies or derivative works are solely in the form of machine-executable object code generated by a source
language processor.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public
License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and
neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.
You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see
http://creativecommons.org/publicdomain/zero/1.0/""",
    "BSD-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, version 2.0.",
    "CC0-1.0-notice": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
}


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.counts = {name: Counter(b) for name, text in sorted(templates.items()) if (b := bigrams(normalise(text).split()))}
        self.size = {name: sum(c.values()) for name, c in self.counts.items()}
        self.holders: dict[tuple[str, str], list[str]] = {}
        for name, c in self.counts.items():
            for b in c:
                self.holders.setdefault(b, []).append(name)

    def bounds(self, name: str) -> tuple[int, int]:
        a, t = self.size[name], self.threshold
        return ceil(a * t / (2 - t) - 1e-9), floor(a * (2 - t) / t + 1e-9)

    def __call__(self, text: str | None) -> dict[str, tuple[float, int, int]]:
        """template -> (Dice, first word, words) of its most similar stretch; of equal ones the first, then the shortest."""
        pairs = bigrams(normalise(text).split())
        holders = self.holders
        places: dict[str, list[int]] = {}
        for k in [k for k, p in enumerate(pairs) if p in holders]:
            for name in holders[pairs[k]]:
                places.setdefault(name, []).append(k)
        found = {}
        for name, at in places.items():
            least, most = self.bounds(name)
            if len(at) >= least and sum((Counter(pairs[k] for k in at) & self.counts[name]).values()) >= least:
                best = self._best(name, pairs, at, least, most)
                if best:
                    found[name] = best
        return found

    def _best(self, name: str, pairs: list, at: list[int], least: int, most: int):
        a, known, best = self.size[name], self.counts[name], None
        for i, start in enumerate(at):
            if i + least > len(at) or at[i + least - 1] - start >= most:
                continue  # too few shared bigrams within the largest stretch
            left, common = dict(known), 0
            for k in at[i:]:
                size = k - start + 1
                if size > most:
                    break
                if left[pairs[k]]:
                    left[pairs[k]] -= 1
                    common += 1
                    dice = 2 * common / (a + size)
                    if dice >= self.threshold and (best is None or dice > best[0]):
                        best = dice, start, size + 1
        return best


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, dice, start, words, best): each template found in each document, once, at its best stretch.

    ``best`` is false where an overlapping stretch is more similar to another template.
    Texts are lower-cased, with runs of ASCII punctuation and white space as one space; ``start`` counts
    words of that form.  Whole texts are scanned, and stretches may begin and end anywhere.  Null, empty and one-word texts
    hold no licence; templates of fewer than two words take no part.  Repeated rows repeat their results and null
    ids are kept.  Other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(templates, threshold)
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = scan(t.as_py())
                for name, (dice, start, words) in found.items():
                    better = any(o[0] > dice and o[1] < start + words and start < o[1] + o[2] for o in found.values())
                    out.append((d, name, dice, start, words, not better))
            if out:
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "license", "dice", "start", "words", "best"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, license string, dice double, start long, words long, best boolean")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join(f"('{name}', '{normalise(text)}')" for name, text in sorted(TEMPLATES.items()))
    t = THRESHOLD
    return rf"""
WITH template AS (SELECT license, string_split(text, ' ') AS w FROM (VALUES {rows}) v(license, text)),
known AS (SELECT license, w[i] || ' ' || w[i + 1] AS pair, COUNT(*) AS cnt FROM (SELECT license, w, unnest(range(1, len(w))) AS i FROM template) GROUP BY 1, 2),
sized AS (SELECT license, SUM(cnt) AS a, ceil(SUM(cnt) * {t} / (2 - {t}) - 1e-9) AS least, floor(SUM(cnt) * (2 - {t}) / {t} + 1e-9) AS most FROM known GROUP BY 1),
words AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^0-9a-zA-Z\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM words)),
shared AS (SELECT p.doc_id, k.license, p.pos, p.pair, k.cnt FROM pairs p JOIN known k USING (pair)),
enough AS (
  SELECT doc_id, license FROM (SELECT doc_id, license, pair, least(COUNT(*), MAX(cnt)) AS n FROM shared GROUP BY 1, 2, 3) JOIN sized USING (license)
  GROUP BY doc_id, license HAVING SUM(n) >= MAX(least)),
here AS MATERIALIZED (SELECT s.*, z.a, z.most FROM shared s SEMI JOIN enough e ON e.doc_id = s.doc_id AND e.license = s.license JOIN sized z ON z.license = s.license),
stretch AS (SELECT s.doc_id, s.license, s.pos AS start, e.pos - s.pos + 1 AS size, s.a FROM here s JOIN here e ON e.doc_id = s.doc_id AND e.license = s.license AND e.pos >= s.pos AND e.pos - s.pos + 1 <= s.most),
common AS (
  SELECT doc_id, license, start, size, a, SUM(n) AS c FROM (
    SELECT x.doc_id, x.license, x.start, x.size, x.a, h.pair, least(COUNT(*), MAX(h.cnt)) AS n
    FROM stretch x JOIN here h ON h.doc_id = x.doc_id AND h.license = x.license AND h.pos BETWEEN x.start AND x.start + x.size - 1 GROUP BY ALL) GROUP BY ALL),
found AS (
  SELECT doc_id, license, 2 * c / CAST(a + size AS DOUBLE) AS dice, start, size + 1 AS words FROM common WHERE 2 * c / CAST(a + size AS DOUBLE) >= {t}
  QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY 2 * c / CAST(a + size AS DOUBLE) DESC, start, size) = 1)
SELECT f.doc_id, f.license, f.dice, f.start, f.words,
  NOT EXISTS (SELECT 1 FROM found o WHERE o.doc_id = f.doc_id AND o.dice > f.dice AND o.start < f.start + f.words AND f.start < o.start + o.words) AS best
FROM found f
"""


QUERIES = {"op5_licenses": op5_licenses}
ORACLES = {"op5_licenses": _sql()}
