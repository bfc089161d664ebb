"""Line field, nearest vectors, fixity audit, URL filter and the pipeline."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberscan.llm import ann_lsh, crf_quality, fixity, url_templates
from tests.llm import plain


# ---- quality ----------------------------------------------------------------------
def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    row = np.array([0, 0, 0, 1, 2, 2])
    score, trans = rng.normal(size=6), rng.normal(size=(2, 2))
    good, pair, z = crf_quality.Chains(row).marginals(score, trans)
    total, p, want = 0.0, np.zeros((2, 2)), np.zeros(6)
    for r in range(3):
        at = np.flatnonzero(row == r)
        weights = {}
        for code in range(2 ** len(at)):
            y = [code >> i & 1 for i in range(len(at))]
            weights[tuple(y)] = np.exp(sum(score[a] * v for a, v in zip(at, y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        norm = sum(weights.values())
        total += np.log(norm)
        for y, w in weights.items():
            want[at] += np.array(y) * w / norm
            for a, b in zip(y, y[1:]):
                p[a, b] += w / norm
    assert np.allclose(good, want) and np.allclose(pair, p) and np.isclose(z, total)


def test_quality_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # enough labels to learn from
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = crf_quality.fit(docs, labels)
    rows = crf_quality.quality(docs, field).join(labels, "doc_id").where(crf_quality.held_out(F.col("doc_id"))).collect()
    right = [(r.score >= crf_quality.LIMIT) == bool(r.quality) for r in rows]
    assert sum(right) >= 0.95 * len(right)
    # labels of held-out rows and other columns change nothing
    other = labels.withColumn("quality", F.when(crf_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = crf_quality.fit(docs.withColumn("lang", F.lit("xx")).repartition(3), other.repartition(7))
    assert np.array_equal(field.weights, again.weights)


def test_quality_of_awkward_rows(docs, no_docs, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    field = crf_quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    narrow = docs.select("doc_id", "text", F.col("id").alias("x"), F.col("kind"))
    rows = crf_quality.quality(narrow, field).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if not (r.text or "").strip()} == {field.prior}
    assert crf_quality.quality(no_docs, field).collect() == []
    assert crf_quality.fit(docs, labels.limit(0)) is None
    assert {r.score for r in crf_quality.quality(docs, None).collect()} == {0.5}


# ---- nearest vectors ----------------------------------------------------------------
def _brute(rows, asks, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, float)
    out = {}
    for q in asks:
        if q in ok:
            cos = [(-float(ok[q] @ v / np.linalg.norm(ok[q]) / np.linalg.norm(v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])]
            out[q] = sorted(cos)[:k]
    return out


def test_nearest_small_and_odd(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(20)]  # copies of one vector
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] * 8), (204, [None] * 8), (205, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (206, [1.0, 2.0]), (207, [2.0, 1.0])]
    rows += [rows[4], rows[4]]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int").repartition(4)
    asks = [i for i, _ in rows if i is not None and (i % 20 == 0 or i > 199)]
    got = {}
    for r in ann_lsh.nearest(df, (F.col("vec_id") % 20 == 0) | (F.col("vec_id") > 199)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = _brute(rows, asks)
    assert {q for q, v in want.items() if v} == set(got)
    hits = 0
    for q, v in got.items():
        v.sort()
        assert [r for r, _, _ in v] == list(range(1, len(want[q]) + 1))
        hits += len({i for _, i, _ in v} & {i for _, i in want[q]})
    assert hits >= 0.9 * sum(len(v) for v in want.values())
    assert [i for _, i, _ in got[100]] == [0, 101, 102, 103, 104]  # ties go to the smaller id
    assert [i for _, i, _ in got[206]] == [207]
    assert ann_lsh.nearest(df.limit(0), F.col("vec_id") > 0).collect() == []


def test_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet".replace("sf0.001", "sf0.1"))
    rows = [(r.vec_id, list(r.embedding)) for r in e.collect()]
    want = _brute(rows, [i for i, _ in rows if i % 50 == 0])
    got = {}
    for r in ann_lsh.nearest(e, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for _, i in v}) for q, v in want.items()) >= 0.9 * 5 * len(want)


# ---- fixity ---------------------------------------------------------------------------
def test_audit(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(0, 9000, 3)] + [(None, None, None), (None, "u", "v"), (-5, "", ""), (6, "again", "é")]
    a = spark.createDataFrame(rows, "page_id long, url string, html string")
    b = [r for r in rows if r[0] != 300]
    b = [(r[0], r[1], (r[2] or "") + "!") if r[0] == 3000 else r for r in b] + [(9, "http://h/9", "<p>9</p>" * 4), (10**6, "new", "page")]
    got = {r.page_id: r for r in fixity.audit(a, spark.createDataFrame(b, a.schema).repartition(3)).collect()}
    assert {k: v.fault for k, v in got.items()} == {300: "missing", 3000: "changed", 9: "changed", 10**6: "extra"}
    assert (got[9].records_primary, got[9].records_replica, got[300].records_replica, got[10**6].offset) == (1, 2, None, None)
    assert fixity.audit(a, a.repartition(7)).collect() == []
    assert fixity.audit(a.limit(0), a.limit(0)).collect() == []
    assert {r.fault for r in fixity.audit(a.limit(0), a).collect()} == {"extra"}


# ---- urls -------------------------------------------------------------------------------
def test_urls(spark):
    rnd = random.Random(2)
    rows = [(i, f"https://shop{i % 2}.org/item/{rnd.randrange(10**6)}?x=1#y") for i in range(60)]
    rows += [(100, None), (101, "no scheme"), (102, "http://EXAMPLE.com/en/a"), (103, "http://www.example.com/en/"), (104, "http://b.net/es/1"), (105, "http://b.net"), (106, "HTTP://x.com?q=/en/"),
             (107, "://"), (108, "a://b://c/d"), (None, "http://b.net/fr/x"), (104, "http://b.net/es/1")]
    rows += [(200 + i, f"http://deep.org/{'/'.join('abcdefghijkl'[:i])}") for i in range(12)]
    df = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    got = url_templates.judge(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[102].host, by[102].path, by[102].rule, by[102].verdict) == ("example.com", "/en/a", "example.com/en/", "block")
    assert (by[103].rule, by[103].verdict) == ("www.example.com/en/", "allow")
    assert (by[104].rule, by[104].verdict, by[None].rule) == ("net/es/", "block", "net/fr/")
    assert (by[105].host, by[105].path, by[105].rule) == ("b.net", "", None)
    assert (by[106].host, by[106].path, by[106].rule) == ("x.com", "", None)
    assert all((by[i].host, by[i].path) == ("", "") for i in (100, 101, 107)) and (by[108].host, by[108].path) == ("b:", "//c/d")
    assert by[0].template == "/item/*" and {r.verdict for r in got} <= {"allow", "block"}
    assert url_templates.judge(df.limit(0)).collect() == []


def test_wildcards_and_purity(spark):
    """More values than a node may have become one template, judged by the examples among them."""
    rnd = random.Random(4)
    names = ["".join(rnd.choice("bcdfgh") for _ in range(9)) for _ in range(80)]
    rows = [(i, f"http://s.org/user/{n}") for i, n in enumerate(names)]
    rules = [("s.org", f"/user/{n}", "block") for n in names[:30]] + [("s.org", f"/user/{names[30]}", "allow")]
    got = {r.page_id: r for r in url_templates.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert {r.template for r in got.values()} == {"/user/*"}
    assert got[30].verdict == "allow" and got[79].verdict == "block" and got[79].rule is None


def test_url_tree(spark):
    """Purity smoothed from all hosts down to the template, pooled siblings and wildcards, against a plain tree."""
    rnd = random.Random(8)
    hosts = ["a.com", "b.net", "c.net", "d.org", "shop.example.com", "e.net"]
    words = ["en", "es", "fr", "item", "tag", "p7", *("".join(rnd.choice("bcdfgh") for _ in range(5)) for _ in range(50))]
    rows = []
    for i in range(900):
        h = rnd.choice(hosts)
        first = rnd.choice(words[:6]) if h != "d.org" else rnd.choice(words)
        rows.append((i, f"http://{h}/" + "/".join([first] + [rnd.choice(words[:4]) for _ in range(rnd.randrange(0, 10))])))
    rows += [(900 + i, f"http://c.net/{'es' if i % 4 else 'tag'}/x") for i in range(40)]
    got = {r.page_id: r for r in url_templates.judge(spark.createDataFrame(rows, "page_id long, url string").repartition(3)).collect()}
    said = [(got[i].host, got[i].path, None if got[i].rule is None else dict(((h + p), v) for h, p, v in url_templates.RULES)[got[i].rule] == "allow") for i in range(len(rows))]
    want = plain.url_tree(said)
    assert {i: (r.template, r.verdict == "allow") for i, r in got.items()} == want
    free = [r.verdict for r in got.values() if r.rule is None]
    assert free.count("block") > 50 and free.count("allow") > 50


def test_nearest_of_extreme_sizes(spark):
    """Finite vectors of any size have true cosines."""
    rows = [(0, [1.0, 0.1]), (1, [1.0, 0.2]), (2, [0.5, 0.4]), (3, [1e200, 1e200]), (4, [1e-200, 2e-200]), (5, [5e-324, 0.0]), (6, [1e308, -1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann_lsh.nearest(df, F.col("vec_id") >= 0, k=6).collect()}
    whole = {i: [float(Fraction(x) / max(abs(Fraction(y)) for y in v)) for x in v] for i, v in rows}
    assert len(got) == 42
    for (a, b), score in got.items():
        x, y = whole[a], whole[b]
        assert score == pytest.approx(sum(p * q for p, q in zip(x, y)) / math.hypot(*x) / math.hypot(*y), abs=1e-12)


# ---- pipeline -----------------------------------------------------------------------------
def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES:
        before = docs.collect()
        rows = [(r.doc_id, r.text) for r in before]
        docs = cp.written(stage(spark, docs, sf), "test")
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == {d for d, _ in rows}
            break
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            field = cp.crf_quality.fit(spark.createDataFrame(before), spark.read.parquet(f"{sf}/labels.parquet"))
            good = {r.doc_id for r in cp.crf_quality.quality(spark.createDataFrame(before), field).collect() if r.score >= cp.crf_quality.LIMIT}
            assert set(after) == good and len(good) < len(rows)
        elif name == "near_duplicates":
            assert set(after) == {d for d, (_, c) in plain.near(rows).items() if c == d} and len(after) < len(rows)
        elif name == "repeated_spans":
            want = plain.spans(rows)
            assert set(after) == set(want) and sum(v[1] for v in want.values()) > 0
            assert all(len(plain.BLANK.findall(after[d])) == n - gone for d, (n, gone, _) in want.items())
        elif name == "decontamination":
            assert set(after) == {d for d, v in plain.leaks(rows, items).items() if not v[-1]} and len(after) < len(rows)


@pytest.mark.parametrize("name", ["documents"])
def test_pipeline_on_nothing(spark, sf, name):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/{name}.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.collect() == []
