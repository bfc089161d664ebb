"""Licence notices anywhere in a text against all runs of words."""

import random
from collections import Counter

import pytest

from emberscan.llm import licences
from tests.llm.plain import ALNUM, lower


def best_run(text, templates, t=0.8):
    """All runs of words against all templates."""
    w, found = ALNUM.findall(lower(text)), []
    grams = list(zip(w, w[1:]))
    for name, body in templates:
        b = ALNUM.findall(lower(body))
        c = Counter(zip(b, b[1:]))
        for i in range(len(grams)):
            seen, shared = Counter(), 0
            for j in range(i, min(len(grams), i + 2 * len(b))):
                seen[grams[j]] += 1
                shared += seen[grams[j]] <= c[grams[j]]
                dice = 2 * shared / (j - i + 1 + len(b) - 1)
                if dice >= t:
                    found.append((-dice, name, i, j - i + 2))
    best = min(found) if found else (None,) * 4
    return best[1], None if best[0] is None else -best[0], best[2], best[3], len({x[1] for x in found})


def test_notices_anywhere(spark):
    """Wrapped, in mid-line, damaged, repeated, as whole licence files, and none."""
    mit, bsd3, gpl = licences.NOTICES[11][1], licences.NOTICES[13][1], licences.NOTICES[5][1]
    wrap = lambda x, n: "\n".join(" ".join(x.split()[i:i + n]) for i in range(0, len(x.split()), n))
    rnd = random.Random(2)
    prose = lambda n: " ".join(rnd.choice(["the", "under", "license", "of", "this", "software", "and", "x1", "x2"]) for _ in range(n))
    damaged = gpl.split()
    damaged[7] = damaged[20] = "zzz"
    texts = ["Copyright (c) A. Body\n\n" + wrap(mit, 9), prose(60) + " " + gpl + " " + prose(60), prose(30) + "\n" + wrap(" ".join(damaged), 5) + "\n" + prose(30),
             wrap(bsd3, 8), "we say it is released under the MIT license and go on", "Released under the\nMIT License.\n" * 4, "the license " * 300, prose(200), "", None, "MIT"]
    rows = [*enumerate(texts), (None, texts[4])]
    got = {r.doc_id: tuple(r)[1:] for r in licences.notice_scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {i: best_run(x, licences.NOTICES) for i, x in rows}
    assert [got[i][0] for i in range(6)] == ["MIT", "GPL-3.0", "GPL-3.0", "BSD-3-Clause", "MIT", "MIT"] and got[7][0] is None


def test_windows_of_odd_tables(spark):
    """An empty table, and columns with names that the scan uses itself."""
    df = spark.createDataFrame([(1, None, 1, "x"), (2, licences.NOTICES[11][1], 2, "y"), (2, "", 3, "z")], "doc_id long, text string, n int, template string")
    got = sorted((r.doc_id, r[1] is not None) for r in licences.notice_scan(df).collect())
    assert len(got) == 3 and got[0][0] == 1
    assert licences.notice_scan(df.limit(0)).collect() == []
