"""Licence notices in documents: Dice coefficient over word bigrams.

A text is normalised to lower-case words of letters and digits. Its segments
are its lines and the text as a whole. A segment with ``a`` bigrams can reach
the coefficient ``t`` with a template of ``b`` only if t/(2-t) <= a/b <=
(2-t)/t, and only if enough of its bigrams occur in any template at all; the
multiset intersection is counted for those pairs alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, Words, documents, pieces, segment_hash, word_hash

# Licence notices by SPDX identifier, in the public wording of each licence.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
# The notices above, and whole texts and longer headers for the window scan.
NOTICES = TEMPLATES + [
    ("MIT", _MIT_BODY), ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
            "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
            "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                   "See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
                "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
                "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
]


def _pairs(text: str) -> np.ndarray:
    h = word_hash(text, ALNUM, lower=True)
    at = np.arange(max(len(h) - 1, 0))
    return segment_hash(h, at, at + 2)


def _scan(templates: list[tuple[str, str]], t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(name, Counter(p.tolist()), len(p)) for name, text in templates if len(p := _pairs(text))]
        vocabulary = np.unique(np.array([g for _, c, _ in known for g in c], np.uint64))
        sizes = np.array([n for _, _, n in known], np.float64)
        for b in pieces(batches, "text"):
            w = Words(b.column("text"), ALNUM, lower=True)
            h, doc = w.hashes(), w.doc()
            breaks = np.flatnonzero(w.data == 10)
            line = np.searchsorted(breaks, w.start)
            at = np.arange(max(len(h) - 1, 0))
            grams = segment_hash(h, at, at + 2)
            place = np.minimum(np.searchsorted(vocabulary, grams), len(vocabulary) - 1)
            useful = vocabulary[place] == grams if len(vocabulary) else np.zeros(len(grams), bool)
            found: dict[int, list] = {}
            whole = doc[at] == doc[at + 1] if len(at) else np.zeros(0, bool)
            # lines are numbered over the piece; a text as a whole is its own segment
            for alone, inner, number in ((False, whole & (line[at] == line[at + 1]) if len(at) else whole, line), (True, whole, doc)):
                k = at[inner]
                key = doc[k] * (len(breaks) + 1) + number[k] if not alone else doc[k].astype(np.int64)
                if not len(k):
                    continue
                new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                n = np.diff(np.append(new, len(k)))
                hits = np.add.reduceat(useful[k].astype(np.int64), new)
                bound = 2 * np.minimum(hits[:, None], sizes) >= t * (n[:, None] + sizes)
                fits = (n[:, None] >= sizes * t / (2 - t) - 1e-9) & (n[:, None] <= sizes * (2 - t) / t + 1e-9) & bound
                for s in np.flatnonzero(fits.any(1)):
                    mine = Counter(grams[k[new[s]:new[s] + n[s]]].tolist())
                    d = int(doc[k[new[s]]])
                    number_in_doc = -1 if alone else int(line[k[new[s]]] - np.searchsorted(breaks, w.offs[d]))
                    for j in np.flatnonzero(fits[s]):
                        name, c, size = known[j]
                        dice = 2 * sum(min(v, c[g]) for g, v in mine.items() if g in c) / (int(n[s]) + size)
                        if dice >= t:
                            found.setdefault(d, []).append((-dice, name, number_in_doc))
            best = [min(found[i]) if i in found else (None, None, None) for i in range(b.num_rows)]
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "licence": pa.array([x[1] for x in best], pa.string()),
                "dice": pa.array([None if x[0] is None else -x[0] for x in best], pa.float64()), "line": pa.array([x[2] for x in best], pa.int64()),
                "n_segments": pa.array([len({x[2] for x in found.get(i, ())}) for i in range(b.num_rows)], pa.int64())})
    return run


def licence_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Per document: doc_id, the best ``licence`` with its ``dice`` and ``line`` (-1: the whole text), and the number of matching segments.

    Ties go to the smaller licence name, then the smaller line. Lines are
    counted from 0 and end at a line feed. Null and empty texts, and texts of
    one word, match nothing: licence, dice and line are null.
    """
    return documents(docs).mapInArrow(_scan(templates, threshold), "doc_id long, licence string, dice double, line long, n_segments long")


def _windows(templates: list[tuple[str, str]], t: float):
    """The best runs of words. One that begins or ends with a bigram foreign to the template is beaten by the run without it, so only runs between own bigrams are looked at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(name, Counter(p.tolist()), len(p)) for name, text in templates if len(p := _pairs(text))]
        vocabulary = np.unique(np.array([g for _, c, _ in known for g in c], np.uint64))
        own = np.array([np.isin(vocabulary, np.array(list(c), np.uint64)) for _, c, _ in known])
        for b in pieces(batches, "text"):
            w = Words(b.column("text"), ALNUM, lower=True)
            h, doc = w.hashes(), w.doc()
            found: dict[int, list] = {}
            at = np.arange(max(len(h) - 1, 0))
            if len(at) and len(vocabulary):
                grams = segment_hash(h, at, at + 2)
                place = np.minimum(np.searchsorted(vocabulary, grams), len(vocabulary) - 1)
                useful = np.flatnonzero((vocabulary[place] == grams) & (doc[at] == doc[at + 1]))
                for k, (name, c, size) in enumerate(known):
                    mine = useful[own[k][place[useful]]]
                    longest, least = int(size * (2 - t) / t + 1e-9), size * t / (2 - t) - 1e-9
                    # the own bigrams that a longest run from here holds; the text's last word has none
                    to = np.searchsorted(mine, np.minimum(mine + longest, w.first[doc[mine] + 1] - 1)) if len(mine) else mine
                    rich = np.flatnonzero(to - np.arange(len(mine)) >= least)
                    _best_runs(rich, to, mine, grams, c, size, t, least, lambda i, dice, end, name=name: found.setdefault(int(doc[i]), []).append((-dice, name, i - int(w.first[doc[i]]), end - i + 2)))  # noqa: B023
            best = [min(found[i]) if i in found else (None,) * 4 for i in range(b.num_rows)]
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "licence": pa.array([x[1] for x in best], pa.string()),
                "dice": pa.array([None if x[0] is None else -x[0] for x in best], pa.float64()), "first_word": pa.array([x[2] for x in best], pa.int64()),
                "n_words": pa.array([x[3] for x in best], pa.int64()), "n_licences": pa.array([len({x[1] for x in found.get(i, ())}) for i in range(b.num_rows)], pa.int64())})
    return run


def _best_runs(rich, to, mine, grams, c, size, t, least, add) -> None:
    """Calls ``add`` with (first bigram, dice, last bigram) of the best run from each start that reaches ``t``."""
    inside, left, right, common = Counter(), 0, 0, 0
    for i in rich.tolist():
        # bigrams that a longest run shares with the template, kept up from start to start
        if i >= right:
            inside, left, right, common = Counter(), i, i, 0
        while right < to[i]:
            g = int(grams[mine[right]])
            inside[g] += 1
            common += inside[g] <= c[g]
            right += 1
        while left < i:
            g = int(grams[mine[left]])
            common -= inside[g] <= c[g]
            inside[g] -= 1
            left += 1
        if common < least:
            continue
        seen, shared, best, end = Counter(), 0, 0.0, 0
        for p in mine[i:to[i]].tolist():
            g = int(grams[p])
            seen[g] += 1
            shared += seen[g] <= c[g]
            dice = 2 * shared / (p - int(mine[i]) + 1 + size)
            if dice > best:
                best, end = dice, p
        if best >= t:
            add(int(mine[i]), best, end)


def notice_scan(docs: DataFrame, templates: list[tuple[str, str]] = NOTICES, threshold: float = 0.8) -> DataFrame:
    """Per document the run of words most like a template, wherever it stands: inside a line, over several lines, or the whole text.

    Columns: doc_id, ``licence``, ``dice``, ``first_word`` (from 0) and
    ``n_words`` of the run, and ``n_licences``, the number of licences with any
    run of at least ``threshold``. Ties go to the smaller licence name, then the
    earlier and the shorter run. Without a match all but ``n_licences`` are null.
    """
    return documents(docs).mapInArrow(_windows(templates, threshold), "doc_id long, licence string, dice double, first_word long, n_words long, n_licences long")


def _words(x: str) -> str:
    return f"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def oracle(threshold: float = 0.8) -> str:
    """The same in SQL."""
    values = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH t AS (SELECT * FROM (VALUES {values}) x(tid, name, body)),
tw AS (SELECT tid, name, {_words('body')} w FROM t),
tp AS (SELECT tid, name, len(w) - 1 n, unnest({pairs}) g FROM tw WHERE len(w) > 1),
tc AS (SELECT tid, name, n, g, count(*) c FROM tp GROUP BY ALL),
seg AS (SELECT doc_id, unnest(range(len(l))) line, unnest(l) body FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) l FROM documents)
        UNION ALL SELECT doc_id, -1, coalesce(text, '') FROM documents),
sw AS (SELECT doc_id, line, {_words('body')} w FROM seg),
sp AS (SELECT doc_id, line, len(w) - 1 n, unnest({pairs}) g FROM sw WHERE len(w) > 1),
sc AS (SELECT doc_id, line, n, g, count(*) c FROM sp WHERE g IN (SELECT g FROM tc) GROUP BY ALL),
m AS (SELECT doc_id, line, name, tid, 2 * sum(least(sc.c, tc.c))::DOUBLE / (any_value(sc.n) + any_value(tc.n)) dice
      FROM sc JOIN tc USING (g) GROUP BY doc_id, line, name, tid),
ok AS (SELECT * FROM m WHERE dice >= {threshold}),
b AS (SELECT doc_id, arg_min(struct_pack(name, dice, line), struct_pack(a := -dice, name := name, line := line)) x, count(DISTINCT line) k FROM ok GROUP BY doc_id)
SELECT d.doc_id, b.x.name AS licence, b.x.dice AS dice, b.x.line::BIGINT AS line, coalesce(b.k, 0)::BIGINT AS n_segments
FROM documents d LEFT JOIN b USING (doc_id)"""
