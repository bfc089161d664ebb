"""Operators on texts against plain Python, on every awkward case at once, and on empty tables."""

import hashlib

import pytest

from emberscan.llm import decontaminate, debruijn, hamming_join, licences
from tests.llm import plain


def test_repeated_spans(docs, texts):
    got = debruijn.repeated_spans(docs).collect()
    want = plain.spans(texts)
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
    free = [r for r in got if r.doc_id is None]
    assert len(free) == 3 and all(r.n_removed == 0 for r in free)
    assert sum(v[1] for v in want.values()) > 300


def test_kept_texts(docs, texts):
    got = debruijn.kept_texts(docs)
    assert got.columns == docs.columns
    want = plain.spans(texts)
    rows = got.collect()
    assert len(rows) == docs.count()
    source = dict(texts)
    for r in rows:
        if r.doc_id is None or not want[r.doc_id][1]:
            assert r.doc_id is None or r.text == source[r.doc_id]
        else:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][2]


def test_near_duplicates(docs, texts):
    got = hamming_join.near_duplicates(docs).collect()
    want = plain.near(texts)
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_large_group_of_near_copies(spark):
    """Members that are near each other but not near the group's smallest id are still linked."""
    base = [f"w{i}" for i in range(120)]
    rows, mine = [], list(base)
    for i in range(60):
        rows.append((i, " ".join(mine)))
        mine[(i * 7) % 120] = f"v{i}"  # a chain: neighbours are near, the ends are not
    rows += [(1000 + i, " ".join(base[:100] + [f"t{i}_{j}" for j in range(5)])) for i in range(40)]
    got = hamming_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain.near(rows)
    assert {r.doc_id: r.component_id for r in got} == {d: c for d, (_, c) in want.items()}


def test_blocks_of_a_mixed_bucket(spark, monkeypatch):
    monkeypatch.setattr(hamming_join, "BLOCK", 4)
    monkeypatch.setattr(hamming_join, "FULL", 5)
    test_large_group_of_near_copies(spark)


def test_contamination(spark, docs, texts, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain.leaks(texts, items)
    got = decontaminate.contamination(docs, bench).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert tuple(r)[1:] == want[r.doc_id]
    assert sum(r.contaminated for r in got) > 3


def test_contamination_in_blocks(spark, docs, texts, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 25)
    test_contamination(spark, docs, texts, items)


def test_licences(spark):
    rows = [(1, "x\nReleased under the MIT license!\ny"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, None), (4, ""), (5, "MIT"),
            (6, "Released under the MIT Licence and much else that is said here"), (7, "a b\n" * 3 + "Licensed under the Apache License, Version 2.0."), (None, "released under the mit license")]
    got = {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].licence, got[1].line, got[1].dice) == ("MIT", 1, 1.0)
    assert (got[2].licence, got[2].line, got[2].n_segments) == ("GPL-3.0", -1, 2)
    assert (got[7].licence, got[7].line) == ("Apache-2.0", 3)
    assert all(got[i].licence is None and got[i].n_segments == 0 for i in (3, 4, 5, 6)) and got[None].licence == "MIT"


@pytest.mark.parametrize("empty", [debruijn.repeated_spans, debruijn.kept_texts, hamming_join.near_duplicates, licences.licence_scan])
def test_empty_table(no_docs, empty):
    assert empty(no_docs).collect() == []


def test_empty_benchmark(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(no_docs, none).collect() == []
    got = decontaminate.contamination(docs, none).collect()
    assert len(got) == docs.count() and not any(r.contaminated for r in got)


@pytest.mark.parametrize("turns", [6, 10, 11])
def test_words_that_power_sums_confuse(spark, turns):
    """The Thue-Morse word and its complement, also as patterns of words, are different words to every operator."""
    bits = [0]
    for _ in range(turns):
        bits += [1 - b for b in bits]
    words = ["".join("ab"[b ^ k] for b in bits) for k in (0, 1)]
    frame = [f"w{i}" for i in range(19)]
    rows = [(i, " ".join([*frame[:9], w, *frame[9:]])) for i, w in enumerate(words)]
    rows += [(2 + k, " ".join("xy"[b ^ k] for b in bits[:64])) for k in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.repeated_spans(df).collect()} == plain.spans(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in hamming_join.near_duplicates(df).collect()} == plain.near(rows)
    items = [(0, rows[0][1]), (1, words[0]), (2, rows[2][1])]
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == plain.leaks(rows, items)
