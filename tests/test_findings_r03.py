"""Faults of the third round's findings: small cases that failed before."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberscan.functions import entities as ent
from emberscan.functions import text as tx
from emberscan.operators import vectors
from emberscan.plans.text import entities_sql, normalise_sql
from tests.oracle import compare, connection


# ---- n1_document_entities (F8) ---------------------------------------------------------
def test_entities_beside_letters_that_are_not_ascii(spark):
    """Word boundaries and white space as in the SQL: ASCII only."""
    import duckdb

    texts = ["caféNATO UN", "éRTX100é $ABCé", "Tokyoß in ñParis.", "NATOx UN_ EU2", "https://a.b/c\x0bd e", "caféwww.x.y z", "CVE-2024-1234é @ü", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (sorted(f"{e.type}:{e.value}" for e in r.e), r.n) for r in df.select("doc_id", ent.entity_array(F.col("text")).alias("e"), tx.normalise(F.col("text")).alias("n")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", [list(r) for r in enumerate(texts)])
    want = {i: (sorted(e), n) for i, e, n in con.execute(f"SELECT doc_id, list_distinct({entities_sql('text')}), {normalise_sql('text')} FROM d").fetchall()}
    assert got == want


# ---- g21_legitimacy (F7), p20_role_presets (F9) ----------------------------------------
@pytest.mark.parametrize("name", ["g21_legitimacy", "p20_role_presets"])
def test_story_means_do_not_follow_the_files(spark, sf, tmp_path, name):
    """Rows of a story lie in many files, as on larger tables; means of equal values are as in one scan."""
    import os

    import __spark_entry__ as entry

    for t in os.listdir(sf):
        if t != "events.parquet":
            os.symlink(f"{sf}/{t}", tmp_path / t)
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("user_id", F.col("user_id") % 10)  # few authors, so that stories are long
    events.coalesce(1).write.parquet(f"{tmp_path}/one/events.parquet")
    events.repartition(37, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    con = connection(sf)
    con.execute("SET threads=1")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/one/events.parquet/*.parquet'")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert compare(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) == []
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# ---- w13_fuzzy_names (F3) --------------------------------------------------------------
@pytest.mark.parametrize("few", [10_000, 3])
def test_fuzzy_never_sends_the_names_to_every_task(spark, sf, capsys, monkeypatch, few):
    """Only needles may be broadcast, and only if they are few; both ways give the same rows."""
    from emberscan.operators import search

    monkeypatch.setattr(search, "FEW_GRAMS", few, raising=False)
    names = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name")
    asked = [(1, names.orderBy("p_partkey").first()["p_name"]), (2, "Part 77 x")]
    needles = spark.createDataFrame(asked, "needle_id int, needle string")
    out = search.fuzzy(names, "p_partkey", "p_name", needles, 0.1)
    out.explain()
    plan = capsys.readouterr().out
    assert "BuildLeft" not in plan and ("BroadcastHashJoin" in plan) == (few > 3)
    grams = lambda s: {f"  {s.lower().strip()} "[i:i + 3] for i in range(len(s.strip()) + 1)}
    want = {(p, i) for p, n in names.collect() for i, q in asked if len(grams(n) & grams(q)) >= 0.1 * len(grams(n) | grams(q))}
    assert {(r.p_partkey, r.needle_id) for r in out.collect()} == want and want


# ---- d7_shingle_groups (F2), d7_c2_near_duplicate_groups, d8_keep_earliest --------------
def test_near_duplicate_groups_store_no_long_tokens(spark):
    """Long tokens are not written again and again; groups equal brute force, with frequent tokens, copies and empty sets."""
    import os
    import random

    from emberscan.operators import graph
    from emberscan.session import shared_dir

    rnd = random.Random(8)
    alphabet = [chr(c) for c in range(33, 127)]
    tokens = ["".join(random.Random(i).choices(alphabet, k=400)) for i in range(3000)]
    sets = []
    for i in range(120):
        old = rnd.choice(sets) if sets and i % 3 else None
        sets.append(sorted({*rnd.sample(old, max(1, len(old) - rnd.randrange(4))), rnd.randrange(3000)}) if old else sorted({*rnd.sample(range(3000), rnd.randrange(1, 60)), 1, 2}))
    sets += [sets[5], sets[5], []]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(set(a) & set(sets[j])) / len(set(a) | set(sets[j])) >= 0.85 - 1e-12:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    df = spark.createDataFrame([(i, [tokens[t] for t in s]) for i, s in enumerate(sets)], "id long, toks array<string>")
    folder = shared_dir(spark).removeprefix("file://")
    held = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(folder) for f in fs)
    before = held()
    got = {r.id: r.component for r in graph.near_duplicate_groups(df).collect()}
    assert got == {i: root(i) for i in range(len(sets))}
    assert held() - before < 400 * sum(map(len, sets)) / 2  # half of the tokens themselves


# ---- j8_stream_pickup (F5) -------------------------------------------------------------
def test_stream_pickup_lists_no_pairs(spark, tmp_path, capsys):
    """Every post of a dense trend finds its earliest answer, also one at the very end of its interval, without a join of posts and answers."""
    import random

    from emberscan.streaming import ingest, timers

    rnd = random.Random(5)
    rows = [(i, "t", rnd.choice("pq"), rnd.randrange(20_000_000) if i % 7 else 1_000_000 * rnd.randrange(20)) for i in range(1200)]
    rows += [(i, "u", s, us) for i, s, us in ((601, "p", 0), (602, "q", 3_000_000), (603, "p", 5_000_000), (604, "q", 8_000_001), (605, "p", 9_000_000), (606, "q", 9_000_000))]
    rows += [(-1, "~end", "p", 10**11), (-2, "~end", "q", 10**11)]
    rows = [(i, t, s, us + 10**12) for i, t, s, us in rows]  # the watermark begins at zero
    df = spark.createDataFrame(rows, "external_id long, trend_id string, source string, us long").withColumn("published_at", F.timestamp_micros("us"))
    df.write.parquet(f"{tmp_path}/in")
    out = timers.pickup(ingest.landed_parquet(spark, f"{tmp_path}/in", df.schema), "p", "q", within_seconds=3)
    out.explain()
    assert "Join" not in capsys.readouterr().out
    want = {}
    for i, t, s, us in rows:
        lags = [b - us for _, u, r, b in rows if s == "p" and r == "q" and u == t and 0 <= b - us <= 3_000_000]
        if lags and t != "~end":
            want[i] = min(lags)
    got = {r.external_id: r.lag_us for r in ingest.run_to_table(out, path=f"{tmp_path}/out").collect() if r.trend_id != "~end"}
    assert got == want and {601: 3_000_000, 605: 0}.items() <= got.items() and 603 not in got


# ---- n8_top_tickers (F22) --------------------------------------------------------------
def test_top_entities_look_for_their_type_only(spark, capsys):
    """One type is found without the patterns of the others, and is what the whole list has of it."""
    from emberscan.operators import mining

    texts = ["$ABC $ABC Apple", "x@e.test $abc $XYZ", "$XYZ $ABC #tag RTX100 cve-2024-1234 @me NASA in Paris https://e.test/1", ""]
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "trend_id string, external_id long, text string").withColumn("published_at", F.lit("2024-01-01").cast("timestamp"))
    for kind in {k for k, *_ in ent.PATTERNS + ent.DICTIONARIES}:
        want = mining.explode_entities(df).where(F.col("type") == kind).groupBy("value").count().orderBy(F.desc("count"), "value").limit(10)
        assert [tuple(r) for r in mining.top_entities(df, kind).collect()] == [tuple(r) for r in want.collect()]
    mining.top_entities(df, "cashtag").explain(True)
    assert "https?" not in capsys.readouterr().out


def test_blocks_travel_once_a_group(spark, monkeypatch):
    """Unrelated vectors at a low limit: every block meets every other, and none is copied for every visit."""
    monkeypatch.setattr(vectors, "BLOCK", 4)
    rnd = np.random.default_rng(4)
    m = rnd.normal(size=(1200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vec array<double>")
    qb, pb, pairs = vectors._visits(df, df, 0.1, "id", "vec", True, None, None)
    sent = vectors._shipments(qb, pb, pairs).agg(F.sum(F.size("ids"))).first()[0]
    sides = math.isqrt(16 * spark.sparkContext.defaultParallelism)
    assert sent <= 2 * 1200 * sides < pairs.agg(F.sum(F.col("q_n") + F.col("p_n"))).first()[0] / 4
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.where(np.tri(1200, k=-1, dtype=bool), u @ u.T, -2)
    for k in (1, 3):
        got = {(r.id, r.neighbour) for r in vectors.nearest(df, df, k, 0.6, earlier_only=True).collect()}
        assert got == {(i, int(j)) for i in range(1200) for j in np.argsort(-s[i])[:k] if s[i, j] >= 0.6}


# ---- n3_cluster_entities (F15), n5_tags (F16), n6_active_keywords (F19) -----------------
def test_first_entities_need_the_first_posts_only(spark, monkeypatch):
    """A trend whose first posts name enough entities is cut behind them; one that takes longer, and one with few, are looked at whole."""
    from datetime import datetime, timedelta

    from emberscan.operators import mining

    t0, rows = datetime(2024, 3, 1), []
    rows += [("fast", i, t0 + timedelta(minutes=i // 2), f"#a{i} #b{i} #A{i // 2}") for i in range(500)]
    rows += [("slow", 1000 + i, t0 - timedelta(minutes=i), f"#s{i // 40}") for i in range(400)]
    rows += [("few", 2000 + i, t0, "#x #y") for i in range(5)] + [(None, 3000, t0, "#n"), ("bare", 3001, t0, "none")]
    df = spark.createDataFrame(rows, "trend_id string, external_id long, published_at timestamp, text string")
    seen, plain = [], mining.explode_entities
    monkeypatch.setattr(mining, "HEAD", 6, raising=False)
    monkeypatch.setattr(mining, "explode_entities", lambda p, *a: seen.append(p) or plain(p, *a))
    got = {(r.trend_id, r.ord, r.value) for r in mining.cluster_entities(df, 8).collect()}
    want = set()
    for k in {r[0] for r in rows}:
        names = list(dict.fromkeys(w.lower() for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])) for w in r[3].split() if w[0] == "#"))
        want |= {(k, i + 1, w[1:]) for i, w in enumerate(names[:8])}
    assert {(k, o, v.lower()) for k, o, v in got} == want
    assert seen[-1].where("trend_id = 'fast'").count() <= 6 and seen[-1].where("trend_id = 'slow'").count() == 400


# ---- p2_p4_normalise_hash (F23), e2_embed_padded (F26), d2_content_dedup_gap (F28) ------
def test_normalised_texts_are_those_of_the_sql_in_fewer_passes(spark, capsys):
    """Steps that touch each other: dots in a row, marks, links in links, runs of blanks and punctuation."""
    import random

    import duckdb

    bits = ["a", "B", "_", "1", ".", ".", "-", "-", "@", "#", " ", " ", "\t", "\n", " ", "　", "‍", "é", "ß", "😀", "☀", "→", "¿", "$", "^", "[", "`",
            "http://", "HTTPS://x", "www.", "wWw.", "ww.", "hhttp://", "URL", "\x0b", "\x1f", " ", tx.DOT_MARK, tx.DASH_MARK, "𝒳"]
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))) for i in range(5000)] + [(5000, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", tx.normalise(F.col("text")).alias("n"))
    con = duckdb.connect()
    arrow = df.sparkSession.createDataFrame(texts, "doc_id long, text string").toArrow()
    con.register("d", arrow)
    assert {(r.doc_id, r.n) for r in df.collect()} == set(con.execute(f"SELECT doc_id, {normalise_sql('text')} FROM d").fetchall())
    df.explain()
    plan = capsys.readouterr().out
    assert "translate(" not in plan and plan.count("regexp_replace(") <= len(tx.NORMALISE_STEPS) - 1


# ---- n1_n2_entities (F21) --------------------------------------------------------------
def test_texts_are_searched_once_and_long_runs_in_one_pass(spark, sf, capsys):
    import time

    import __spark_entry__ as entry

    entry.queries()["n1_n2_entities"](spark, sf).explain()
    assert capsys.readouterr().out.count("regexp_extract_all(") == len(ent.PATTERNS) + len(ent.DICTIONARIES)
    rows = [(0, "x" * 400_000 + " a.b@c.io_y@d.org"), (1, "e" * 400_000 + "@f.com"), (2, "a@b.cc_x@d.ee@f.gg"), (3, "@a @b.c"), (4, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    t = time.perf_counter()
    got = {r.id: r.v for r in df.select("id", ent.values_of(ent.entity_array(F.col("text"), "person"), "person").alias("v")).collect()}
    assert time.perf_counter() - t < 30
    assert got == {0: ["a.b@c.io", "_y@d.org", "c", "d"], 1: ["e" * 400_000 + "@f.com", "f"], 2: ["a@b.cc", "_x@d.ee", "b", "d", "f"], 3: ["a", "b"], 4: None}


# ---- s2_reddit_atom (F17) --------------------------------------------------------------
def test_atom_content_is_cleaned_once(spark, capsys):
    """Entries without title or content, and runs of every kind of blank."""
    import random

    from emberscan.sources import payloads as pay

    entry = lambda i, t, c: f"<entry><id>{i}</id>{t}{c}<updated>2024-01-01T00:00:00Z</updated></entry>"
    kinds = [("<title>T</title>", "<content>&lt;p&gt;a \t b&lt;/p&gt;</content>"), ("", "<content>c</content>"), ("<title>only</title>", ""), ("", ""), ("", "<content>&lt;br&gt; </content>"), ("<title></title>", "<content>d</content>")]
    rows = spark.createDataFrame([("<feed>" + "".join(entry(i, *k) for i, k in enumerate(kinds)) + "</feed>",)], "payload string")
    out = pay.reddit_atom(rows)
    assert {r.external_id: r.text for r in out.collect()} == {"0": "T\n\na b", "1": "\n\nc", "2": "only", "5": "\n\nd"}
    out.select("external_id", "text").explain()
    assert capsys.readouterr().out.count("<[^>]+>") <= 2  # in the filter, for entries without title, and once for the text
    rnd = random.Random(2)
    texts = [(i, "".join(rnd.choice("aé   \t\n\x0b\x1f\x85  　﻿​") for _ in range(rnd.randint(0, 12)))) for i in range(3000)]
    df = spark.createDataFrame(texts, "id long, t string")
    assert df.where(~tx.collapse(F.col("t")).eqNullSafe(F.trim(F.regexp_replace("t", tx.SPACE + "+", " ")))).count() == 0


# ---- d4_lsh_bands (F25) and all other users of signatures --------------------------------
def test_signatures_are_made_without_a_row_for_every_word(spark, capsys):
    """Equal to the permutations worked out by hand, with texts of no words, repeated ids and null ids."""
    import hashlib

    from emberscan.operators import dedup

    rows = [(1, "a b a  c"), (2, ""), (3, None), (4, "x"), (4, "y\tz"), (5, None), (5, "ü"), (None, "p"), (None, "q")]
    out = dedup.minhash(spark.createDataFrame(rows, "id long, text string"), "id", tx.tokens(F.col("text")))
    bag = {}
    for i, t in rows:
        bag.setdefault(i, []).extend(dict.fromkeys((t or "").split()))
    h = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
    want = {i: [min((a * h(w) + b) % dedup.PRIME for w in ws) if ws else -1 for a, b in map(dedup.permutation, range(128))] for i, ws in bag.items()}
    got = out.collect()
    assert {r.id: r.sig for r in got} == want and len(got) == len(want) and {r.id: r.n_tokens for r in got} == {i: len(ws) for i, ws in bag.items()}
    out.explain()
    assert "Generate" not in capsys.readouterr().out


def test_items_alone_in_their_buckets_are_leaders_without_features(spark):
    """embeddings and entities are made for items that meet another only; the rest takes part in no comparison."""
    from emberscan.operators import graph

    items = spark.range(50).select("id", F.col("id").alias("ord"), F.col("id").alias("last_ord"))
    buckets = items.select("id", F.when(F.col("id").isin(7, 9, 30), F.lit(-1)).otherwise(F.col("id")).alias("bucket")).union(items.select("id", F.col("id") + 1000))
    asked, compared = [], []

    def more(ids):
        asked.append(sorted(r.id for r in ids.collect()))
        return ids.select("id", (F.col("id") < 10).alias("x"))

    def gate(pairs):
        compared.append({r[c] for r in pairs.select("leader", "id").collect() for c in ("leader", "id")})
        return pairs.where("a_x = b_x").select("leader", "leader_ord", "id", F.lit(1.0).alias("score"))

    chosen, matches = graph.leaders(items, buckets, gate, more=more)
    assert sorted((r.id, r.ord) for r in chosen.collect()) == [(i, i) for i in range(50) if i != 9]
    assert [(r.leader, r.id) for r in matches.collect()] == [(7, 9)]
    assert asked == [[7, 9, 30]] and set().union(*compared) <= {7, 9, 30}


def test_bm25_shuffles_no_pair_of_query_and_document(spark, monkeypatch):
    """scores are summed where a document's postings lie; with more terms than may ride along the result is the same."""
    from emberscan.operators import search

    docs = spark.createDataFrame([(i, " ".join(f"word{(i * j) % 11}" for j in range(1 + i % 9))) for i in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "word3 word5 word3"), (2, "word0 none"), (3, "it")], "query_id long, q string")
    few = search.bm25(queries, docs, "doc_id", "text", 5)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "hashpartitioning(query_id" in line and "doc_id" in line]
    got = sorted(map(tuple, few.select("query_id", "doc_id", "rank").collect()))
    monkeypatch.setattr(search, "FEW_TERMS", 0)
    assert got == sorted(map(tuple, search.bm25(queries, docs, "doc_id", "text", 5).select("query_id", "doc_id", "rank").collect())) and len(got) == 10
