"""Filter audit, vector codes and signature trees against plain Python, on awkward rows, hot groups and empty tables."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from emberscan.llm import filter_audit, signature_trees, vector_codes
from tests.llm import plain


# ---- filter audit ----------------------------------------------------------------
def audit(rows, labels):
    """Rows as (doc_id, text, source)."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = defaultdict(Counter)
    for d, t, s in rows:
        t = t or ""
        w = plain.BLANK.findall(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
               "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t]}
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for k, f in enumerate(order):
                c = out[s or "", order, k + 1]
                hit = bad[f] and not gone
                c["removed"] += hit
                c["redundant"] += bad[f] and gone
                c["unique_fails"] += bad[f] and sum(bad.values()) == 1
                c["good_lost"] += hit and d in good
                c["toxic_lost"] += hit and d in toxic
                gone |= bad[f]
                c["kept"] += not gone
    shapley = Counter()
    for (p, order, k), c in out.items():
        shapley[p, order[k - 1]] += c["removed"]
    return {key: (c["kept"], c["removed"], c["redundant"], c["unique_fails"], c["good_lost"], c["toxic_lost"], shapley[key[0], key[1][key[2] - 1]]) for key, c in out.items()}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark, texts):
    rnd = random.Random(3)
    rows = [(d, t, rnd.choice(["a", "b", "", None])) for d, t in texts]
    rows += [(None, texts[3][1], "a"), (None, texts[3][1], "b"), (None, None, None), (500, "COPY # of all", "a"), (500, "COPY # of all", "b"), (501, "COPY # of all", "b")]
    rows += [(1000 + i, "one text in a third of all rows", rnd.choice("ab")) for i in range(60)]
    labels = [(d, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for d, _, _ in rows[::2]] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (99999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "k", 5, 2.0) for r in rows], "doc_id long, text string, source string, f int, part string, word long, good double").repartition(4)
    marks = spark.createDataFrame([(*r, 1, 9) for r in labels], "doc_id long, quality int, toxic int, salt int, n int")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in filter_audit.interaction_audit(docs, marks).collect()}
    assert got == audit(rows, labels)
    assert len(got) == 3 * 600 and all(any(v[i] for v in got.values()) for i in range(7))
    assert filter_audit.interaction_audit(docs.limit(0), marks).count() == 0
    assert filter_audit.interaction_audit(docs.limit(3), marks.limit(0)).where("good_lost > 0").count() == 0


def test_positional_popcount():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 100, 1001):
        words, weight = rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 12, n)
        want = [sum(int(w) * (int(x) >> s & 1) for x, w in zip(words, weight)) for s in range(32)]
        assert filter_audit.positional_popcount(words, weight).tolist() == want


# ---- vector codes ----------------------------------------------------------------
def codes(rows, parts=16, entries=64, rounds=2):
    """{row number: (code, error)} and the digest, for rows of whole numbers in order of their ids."""
    x = np.array(rows, np.int64).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for done in range(rounds + 1):
        square = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        best = square.argmin(2)
        if done == rounds:
            break
        for p in range(parts):
            for e in set(best[:, p].tolist()):
                mine = x[best[:, p] == e, p]
                books[p, e] = mine.sum(0) // len(mine)
    text = ",".join(map(str, books.ravel().tolist()))
    return [("".join(f"{b:02x}" for b in r), int(s.min(1).sum())) for r, s in zip(best, square)], hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("n, entries", [(700, 64), (300, 16), (40, 64), (1, 64)])
def test_vector_codes(spark, n, entries):
    rng = np.random.default_rng(n)
    x = (rng.integers(0, 12, (n, 1)) * 3.0 + rng.normal(size=(n, 32))).astype(np.float32)
    x[n // 2:n // 2 + n // 5] = x[0]  # copies
    x = np.round(x * 8) / 8  # ties
    rows = [(i * 2, v.tolist(), None if i % 3 == 0 else i % 3) for i, v in enumerate(x)]
    bad = [(-1, None, 1), (-2, [None] * 32, 1), (-3, [float("nan")] * 32, 1), (-4, [1.0] * 31 + [float("-inf")], 1)]
    df = spark.createDataFrame([(*r, 4, "x", b"n") for r in rows + bad], "vec_id long, embedding array<float>, label int, error int, near string, low binary").repartition(5)
    got = vector_codes.vector_codes(df, entries=entries).collect()
    want, digest = codes(np.floor(256 * x.astype(np.float64)), entries=entries)
    per = Counter()
    for (_, _, label), (_, error) in zip(rows, want):
        per[label] += error
    assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in got} == {r[0]: (*w, per[r[2]], digest) for r, w in zip(rows, want)}
    assert len(got) == n


def test_bounds_spare_measuring(spark):
    """Rows near well separated entries keep their entry without a second look, and lists shrink."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(64, 32)) * 4
    x = np.concatenate([centres, centres[rng.integers(0, 64, 936)] + rng.normal(size=(936, 32)) * 0.05])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    coded, books, log = vector_codes.compress(df, rounds=4)
    assert all(r["measured_again"] < 0.3 * r["parts"] for r in log[1:])
    assert log[0]["b"] == 16 and log[-1]["b"] <= 16 and books.shape == (16, 64, 2)
    want, digest = codes(np.floor(256 * x), rounds=4)
    assert [(r.code, r.error) for r in coded.orderBy("vec_id").collect()] == want and vector_codes.codebooks_sha256(books) == digest


def test_vector_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0] * 16, "a"), (1, [1.0] * 16, "a"), (1, [0.5] * 16, None), (None, [3e38] * 16, "b"), (2, [1.0] * 15, "b"), (3, [], "b"), (4, [-3e38] * 16, "b")]
    got = vector_codes.vector_codes(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.vec_id is None and -1 or r.vec_id for r in got) == [-1, 1, 1, 1, 4]
    assert all(r.error == 0 and r.label_error == 0 for r in got)
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame(rows, schema), entries=257)


# ---- signature trees ---------------------------------------------------------------
def components_of(df, percent=85):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in signature_trees.jaccard_components(df, percent).collect() if r.doc_id is not None}


def test_signature_trees(docs, texts, no_docs):
    want = plain.near(texts, 85)
    rows = signature_trees.jaccard_components(docs).collect()
    assert len(rows) == docs.count() and sum(r.doc_id is None for r in rows) == 3
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert signature_trees.jaccard_components(no_docs).count() == 0


def edited(rnd, base, edits):
    mine = list(base)
    for _ in range(edits):
        mine[rnd.randrange(len(mine))] = f"e{rnd.randrange(10_000)}"
    return " ".join(mine)


@pytest.mark.parametrize("block", [512, 16])
def test_hot_trees(spark, monkeypatch, block):
    """A large family at the edge of the similarity, chains, one common passage, long and short texts; also with trees dealt in many blocks."""
    monkeypatch.setattr(signature_trees, "BLOCK", block)
    monkeypatch.setattr(signature_trees, "FULL", max(8, block // 4))
    monkeypatch.setattr(signature_trees, "FULL_SHINGLES", 4000 if block < 100 else 1 << 17)
    rnd = random.Random(block)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(rnd, base, rnd.randrange(1, 6))) for i in range(120)]
    chain = [f"c{i}" for i in range(120)]
    for i in range(50):
        rows.append((200 + i, " ".join(chain)))
        chain[(i * 7) % 120] = f"v{i}"
    passage = " ".join(f"p{i}" for i in range(25))
    rows += [(300 + i, f"{passage} " + " ".join(f"q{i}_{j}" for j in range(rnd.randrange(3, 40)))) for i in range(60)]
    long = [f"l{i}" for i in range(3000)]
    rows += [(400 + i, edited(rnd, long, e)) for i, e in enumerate((0, 40, 60, 70, 80, 300))]
    rows += [(500 + i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 8)))) for i in range(40)]
    rnd.shuffle(rows)
    got = components_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert got == plain.near(rows, 85)
    assert len({c for _, c in got.values()}) > 60 and len({c for d, (_, c) in got.items() if d < 120}) < 90


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_meeting_of_trees(percent):
    """Forests of exact bitmaps connect what plain pairs connect; sketches connect at least that."""
    rng = np.random.default_rng(percent)
    for size in (1, 2, 7, 40, 300):
        sets = [set(rng.integers(0, 60, rng.integers(1, 50)).tolist()) for _ in range(size)]
        for i in range(size // 3):
            sets[i] = set(sets[-1 - i]) ^ {int(rng.integers(0, 60))} or {1}
        n = np.array([len(s) for s in sets])
        ids = rng.permutation(size) * 3

        def partition(bits, excess):
            tree = signature_trees.Tree(np.arange(size), bits, n, excess)
            met = signature_trees.Meeting(ids, percent)
            met.meet(tree, tree)
            assert len(met.forest.edges) < max(1, size)
            return [met.forest.root(int(i)) for i in ids]

        exact = np.zeros((size, 1), np.uint64)
        sketch = np.zeros((size, 1), np.uint64)
        for i, s in enumerate(sets):
            exact[i, 0] = sum(1 << v for v in s)
            sketch[i, 0] = sum(1 << v for v in {v % 16 for v in s})
        up = {int(i): int(i) for i in ids}

        def root(d):
            while up[d] != d:
                d = up[d]
            return d

        for i, j in itertools.combinations(range(size), 2):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (n[i] + n[j] - both):
                a, b = root(int(ids[i])), root(int(ids[j]))
                up[max(a, b)] = min(a, b)
        want = [root(int(i)) for i in ids]
        assert partition(exact, np.zeros(size, np.int64)) == want
        loose = partition(sketch, n - np.bitwise_count(sketch).sum(1))
        assert len({*zip(want, loose)}) == len({*want})


def test_percent_is_checked(no_docs):
    with pytest.raises(ValueError):
        signature_trees.jaccard_components(no_docs, 50)
