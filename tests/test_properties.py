"""Operators without a SQL twin against brute force, and worked examples."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberscan import params
from emberscan.functions import entities as ent
from emberscan.functions import text as tx
from emberscan.operators import alerts, clusters, dedup, graph, profile, score_early as early, series, trust, vectors
from emberscan.sources import payloads as pay

NOW = datetime(2024, 1, 10, 12, 0, 0)


def texts(n=60, seed=3):
    """Short texts with exact copies, near copies and unrelated ones."""
    rnd = random.Random(seed)
    vocab = [f"word{i}" for i in range(400)]
    out = []
    for i in range(n):
        kind = rnd.random()
        if out and kind < 0.2:
            out.append(rnd.choice(out))
        elif out and kind < 0.65:
            w = rnd.choice(out).split(" ")
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rnd.sample(vocab, 40)))
    return out


def test_near_duplicate_groups_equal_brute_force(spark):
    t = texts(80)
    sets = [set(x.split()) for x in t]
    label = list(range(len(t)))
    edges = [(i, j) for i in range(len(t)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85]
    for _ in t:
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    df = spark.createDataFrame(list(enumerate(t)), "id long, text string").select("id", tx.token_set(F.col("text")).alias("toks"))
    got = {r["id"]: r["component"] for r in graph.near_duplicate_groups(df).collect()}
    assert got == dict(enumerate(label))
    assert len(set(label)) < len(t)


def test_lossless_bands_and_recall(spark):
    bands = dedup.tight_bands()
    assert len(bands) == 20 and sum(n for _, n in bands) == 128
    t = texts(60)
    d = spark.createDataFrame(list(enumerate(t)), "id long, text string")
    sig = {r["id"]: r["sig"] for r in dedup.minhash(d, "id", tx.tokens(F.col("text"))).collect()}
    sdf = spark.createDataFrame([(k, v) for k, v in sig.items()], "id long, sig array<long>")
    b = {}
    for r in dedup.lossless_bands(sdf, "id").collect():
        b.setdefault(r["bucket"], set()).add(r["id"])
    wide = {}
    for r in dedup.bands(sdf, "id").collect():
        wide.setdefault((r["band"], r["band_hash"]), set()).add(r["id"])
    for i in sig:
        for j in sig:
            if i < j:
                est = np.mean(np.array(sig[i]) == np.array(sig[j]))
                exact = len(set(t[i].split()) & set(t[j].split())) / len(set(t[i].split()) | set(t[j].split()))
                assert abs(est - exact) < 0.2
                if est >= 0.85:
                    assert any({i, j} <= s for s in b.values())
                    assert any({i, j} <= s for s in wide.values())


def test_empty_text_has_the_sentinel_signature(spark):
    d = spark.createDataFrame([(1, ""), (2, "a b")], "id long, text string")
    r = {x["id"]: x["sig"] for x in dedup.minhash(d, "id", tx.tokens(F.col("text"))).collect()}
    assert set(r[1]) == {-1} and len(r[2]) == 128


@pytest.mark.parametrize("parts", [1, 5])
def test_leader_clusters_equal_a_sequential_pass(spark, parts):
    t = texts(50, seed=9)
    docs = spark.createDataFrame(list(enumerate(t)), "id long, text string").repartition(parts)
    f = {r["id"]: r for r in clusters.features(docs).collect()}
    lead, want = [], {}
    for i in range(len(t)):
        best, score = None, 0.0
        for k in lead:
            j = np.mean(np.array(f[i]["sig"]) == np.array(f[k]["sig"]))
            c = float(np.dot(np.array(f[i]["emb"], dtype=float), np.array(f[k]["emb"], dtype=float)))
            if j >= 0.85 and c >= 0.55 and 0.5 * j + 0.5 * c > score + 1e-9:
                best, score = k, 0.5 * j + 0.5 * c
        if best is None:
            lead.append(i)
            best = i
        want[i] = best
    got = {r["id"]: r["leader"] for r in clusters.leader_clusters(docs).collect()}
    assert got == want
    assert 1 < len(lead) < len(t)


def test_stream_clustering_equals_batch(spark):
    from emberscan.session import shared_dir
    from emberscan.streaming.clustering import LeaderStore

    docs = spark.createDataFrame(list(enumerate(texts(45, seed=5))), "id long, text string")
    store = LeaderStore(spark, f"{shared_dir(spark)}/leaders-{random.random()}")
    for b in range(3):
        store.assign(docs.where((F.col("id") >= 15 * b) & (F.col("id") < 15 * b + 15)), b)
    got = {r["id"]: r["leader"] for r in store.assignments().collect()}
    assert got == {r["id"]: r["leader"] for r in clusters.leader_clusters(docs).collect()}


def test_components_of_a_long_chain(spark):
    n = 200
    nodes = spark.range(n).select("id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i != 120], "src long, dst long")
    got = {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()}
    assert got == {i: 0 if i <= 120 else 121 for i in range(n)}


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(120) for j in range(i) if s[i, j] >= 0.7}
    got = {(r["id"], r["neighbour"]) for r in vectors.nearest(df, df, 1000, 0.7, earlier_only=True, cells=8).collect()}
    assert got == want


def test_semantic_duplicates_point_at_first_copy(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.99, 0.05])], "id long, vec array<double>")
    got = {r["id"]: r["duplicate_of"] for r in vectors.semantic_duplicates(df, "id", "vec").collect()}
    assert got == {2: 1, 4: 1}


def test_embeddings_are_unit_and_deterministic(spark):
    d = spark.createDataFrame([(1, "Hello https://x.y World"), (2, "hello world"), (3, "")], "id long, text string")
    for kind in ("signed", "padded"):
        e = {r["id"]: np.array(r["e"]) for r in d.select("id", vectors.embed_text(F.col("text"), kind).alias("e")).collect()}
        assert len(e[1]) == params.EMBED_DIM and abs(np.linalg.norm(e[1]) - 1) < 1e-5
        assert np.linalg.norm(e[3]) == 0
    assert np.allclose(e[2], e[2])


def test_drift_equals_the_recurrence(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30, 3))
    df = spark.createDataFrame([("k", i, [float(x) for x in r]) for i, r in enumerate(v)], "k string, o long, v array<double>")
    c = v[0].copy()
    for r in v[1:]:
        c = 0.1 * r + 0.9 * c
    got = vectors.drift(df, "k", "o", "v").first()["centroid"]
    assert np.allclose(got, c)


def test_ewma_closed_form_equals_recurrence(spark):
    w = params.SCORE_WINDOWS["1H"]
    counts = [0, 3, 1, 0, 0, 7, 2, 2, 0, 1, 9, 4]
    v = 0.0
    for c in counts:
        v = w.alpha * c / w.bucket_hours + (1 - w.alpha) * v
    df = spark.createDataFrame([(counts,)], "c array<long>")
    r = df.select(series.ewma(F.col("c"), w).alias("v"), series.ewma_series(F.col("c"), w).alias("s")).first()
    assert abs(r["v"] - v) < 1e-9 and abs(r["s"][-1] - v) < 1e-9 and len(r["s"]) == 12


def test_delta_rules(spark):
    df = spark.createDataFrame([(5.0, 0.0, 5), (5.0, 0.0, 4), (100.0, 1.0, 9), (0.0, 2.0, 9), (1.975, 2.0, 9)], "v double, b double, n long")
    got = [r[0] for r in df.select(series.delta_pct(F.col("v"), F.col("b"), F.col("n"))).collect()]
    assert got == [999, 0, 999, -100, -1]


def test_hashtag_jaccard_equals_all_pairs(spark):
    rnd = random.Random(4)
    rows = [("t", rnd.sample(["a", "b", "c", "d", "e"], rnd.randint(1, 4))) for _ in range(40)]
    s = [set(x) for _, x in rows]
    want = np.mean([len(s[i] & s[j]) / len(s[i] | s[j]) for i in range(40) for j in range(i)])
    got = trust.hashtag_jaccard(spark.createDataFrame(rows, "trend_id string, tags array<string>")).first()["hashtag_jaccard"]
    assert abs(got - want) < 1e-9


def test_window_boundaries(spark):
    ms = timedelta(milliseconds=1)
    at = [NOW - timedelta(minutes=15), NOW - timedelta(minutes=15) + ms, NOW - timedelta(minutes=60), NOW - timedelta(hours=24) - ms]
    rows = [("t", i, "x", i, t, 0.0) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "trend_id string, external_id long, source string, author_id long, published_at timestamp_ntz, sentiment double")
    r = profile.trend_profile(df, NOW).first()
    assert (r["mentions"], r["m15"], r["m60"], r["older"], r["max_author60"]) == (4, 1, 2, 1, 1)


def test_penalty_thresholds(spark):
    cols = "max_author60 long, m60 long, unique_authors long, mentions long, older long"
    rows = [(14, 20, 8, 20, 6), (15, 40, 7, 20, 7), (2, 3, 3, 3, 0), (2, 2, 2, 2, 0)]
    df = spark.createDataFrame(rows, cols)
    a = [round(r["penalty"], 2) for r in early.penalty_authors(df).collect()]
    b = [round(r["penalty"], 2) for r in early.penalty_dominance(df).collect()]
    assert a == [0.0, 1.0, 0.0, 0.0]
    assert b == [0.4, 0.7, 0.4, 0.0]


def test_rigid_veto_examples(spark):
    rows = [("RTX4090", "RTX5090"), ("Apple", "Apple"), ("Apple", ""), ("Apple", "Google"), ("$NVDA", "$AMD"), ("Apple Google", "Apple")]
    df = spark.createDataFrame(rows, "a string, b string").select(ent.entity_array(F.col("a")).alias("a"), ent.entity_array(F.col("b")).alias("b"))
    got = [tuple(r) for r in df.select(ent.rigid_veto(F.col("a"), F.col("b")), ent.rigid_veto(F.col("a"), F.col("b"), "asymmetric")).collect()]
    assert got == [(True, True), (False, False), (False, False), (True, True), (True, True), (True, False)]


def test_entities_by_type(spark):
    t = "Nvidia RTX4090 cve-2024-1234 #ai $NVDA a@b.co @joe https://x.y/z NASA in New York"
    e = spark.createDataFrame([(t,)], "t string").select(ent.entity_array(F.col("t"))).first()[0]
    got = {(x["type"], x["value"]) for x in e}
    assert {("brand", "Nvidia"), ("model", "RTX4090"), ("cve", "CVE-2024-1234"), ("hashtag", "ai"), ("cashtag", "NVDA"), ("person", "a@b.co"), ("person", "joe"),
            ("url", "https://x.y/z"), ("org", "NASA"), ("location", "New York")} <= got


def test_normalise_examples(spark):
    rows = [("Check GPT-4 & node.js!! https://a.b/c", "check gpt-4 node.js url"), ("@joe says #AI 🚀 www.x.y", "joe says ai url"), (None, ""), ("Ünïcode — é", "ünïcode é")]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in rows], "t string").select(tx.normalise(F.col("t"))).collect()]
    assert got == [b for _, b in rows]


def test_parse_date_fallback(spark):
    rows = ["Wed, 02 Oct 2024 13:14:15 GMT", "20241002T131415Z", "1727874855", "2024-10-02T13:14:15Z", "nope", ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "d string").select(tx.parse_date(F.col("d"))).collect()]
    assert got[:4] == [datetime(2024, 10, 2, 13, 14, 15)] * 4 and got[4:] == [datetime(1970, 1, 1)] * 2


def test_payload_edge_cases(spark):
    df = lambda *p: spark.createDataFrame([(x,) for x in p], "payload string")
    assert pay.gdelt(df("<html>busy</html>", "")).count() == 0
    one = pay.feeds(df("<rss><channel><item><title>A &amp; B</title><link>https://l</link></item></channel></rss>")).first()
    assert (one["external_id"], one["text"], one["author_id"]) == ("https://l", "A & B", "unknown")
    assert pay.hn_items(df("null", '{"id":1,"title":"t","score":9,"time":0}', '{"id":2,"title":"u","score":10,"time":5}'), 10).count() == 1
    r = '{"data":{"children":[{"data":{"id":"a","author":"[deleted]","title":"x","created_utc":1}},{"data":{"id":"b","author":"z","title":"x","created_utc":1,"url":"u"}}]}}'
    assert [x["external_id"] for x in pay.reddit_listing(df(r)).collect()] == ["b"]


def test_alert_cooldown(spark):
    at = [NOW + timedelta(seconds=s) for s in (0, 100, 299, 300, 400, 700)]
    df = spark.createDataFrame([("r", "t", 300, "high", 1, a) for a in at], "rule_id string, trend_id string, cooldown_sec long, severity string, user_id long, at timestamp_ntz")
    got = [r["fired_at"] for r in alerts.fire(df).orderBy("fire_no").collect()]
    assert got == [at[0], at[3], at[5]]


def test_scores_stay_in_range(spark, sf):
    import __spark_entry__ as entry

    for name, cols in (("g1_g2_g3_early_score_strict", ["score"]), ("g18_compute_score_24h", ["confidence"])):
        for r in entry.queries()[name](spark, sf).collect():
            assert all(0 <= r[c] <= 100 for c in cols)


@pytest.mark.parametrize("name", ["d3_minhash_signatures", "c7_fork_detection", "g26_origin_quality", "d15_simhash_distinct", "n6_active_keywords"])
def test_rows_only_queries(spark, sf, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, sf).count() > 0
