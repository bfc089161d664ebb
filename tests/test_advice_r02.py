"""Whole jobs where an earlier round did less: hand-made cases against plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

import pytest

from emberscan import params
from emberscan.operators import alerts, backtest, profile, score_early, trust


# ---- g23_trash_features ----------------------------------------------------------------
def test_hashtag_jaccard_of_forty_tags(spark):
    """Posts of 40 tags beside short ones, equal sets, a hot tag on several shares, and a trend without common tags."""
    rnd = random.Random(4)
    names = [f"h{i}" for i in range(60)]
    rows = [(f"t{i % 2}", ["hot", *rnd.sample(names, rnd.choice([1, 2, 3, 8, 9, 20, 39]))]) for i in range(70)]
    rows += [("t0", [f"h{i}" for i in range(40)])] * 3 + [("t2", ["a"]), ("t2", [f"b{i}" for i in range(40)]), ("t3", [f"b{i}" for i in range(40)])]
    want = {}
    for t in {r[0] for r in rows}:
        pairs = list(combinations([set(x) for k, x in rows if k == t], 2))
        want[t] = sum(len(a & b) / len(a | b) for a, b in pairs) / len(pairs) if pairs else None
    df = spark.createDataFrame(rows, "trend_id string, tags array<string>")
    for share in (5_000, 4):
        got = {r.trend_id: r.hashtag_jaccard for r in trust.hashtag_jaccard(df, share=share).collect()}
        assert got == {k: v if v is None else pytest.approx(v, abs=1e-9) for k, v in want.items()}


# ---- a39_backtest, t6_alerts_fired -----------------------------------------------------
def test_ticks_have_the_whole_score(spark):
    """Every tick equals the early score of the trend's profile at that clock; floods, single mentions, one source, and mentions exactly on ticks."""
    now, rnd, rows = datetime(2024, 1, 10, 12), random.Random(6), []
    for i in range(400):
        t = rnd.choice(["wide", "wide", "flood", "one_source"])
        at = now - timedelta(minutes=15 * rnd.randrange(130)) if i % 5 == 0 else now - timedelta(seconds=rnd.randrange(86_400 // 3 if i % 3 else 115_000))
        rows.append((t, i, "rss" if t == "one_source" else rnd.choice(params.SOURCES), 1 if t == "flood" else rnd.randrange(40), at, rnd.random()))
    rows += [("single", 900, "hn", 1, now - timedelta(minutes=20), 0.5), ("future", 901, "hn", 1, now + timedelta(minutes=1), 0.5)]
    df = spark.createDataFrame(rows, "trend_id string, external_id long, source string, author_id long, published_at timestamp_ntz, sentiment double").coalesce(1).cache()
    got = {(r.trend_id, r.tick): r for r in backtest.tick_scores(df, now, 900).collect()}
    for k in (0, 1, 2, 5, 24):
        clock = now - timedelta(minutes=15 * k)
        want = score_early.early_score(profile.trend_profile(df.where(df.published_at <= clock), clock), "strict").where("m60 > 0").collect()
        assert {t for t, n in got if n == k} == {r.trend_id for r in want}
        for r in want:
            g = got[r.trend_id, k]
            for c in ("m15", "m30", "m60", "mentions", "older", "authors60", "sources60", "sources15", "max_author60", "max_source60", "social60", "phase", "shape", "is_trending"):
                assert g[c] == r[c], (c, r.trend_id, k)
            for c in ("freshness", "trust", "entropy15", "age_hours", "penalty", "raw_score", "gated_score", "score"):
                assert g[c] == pytest.approx(r[c], abs=1e-9), (c, r.trend_id, k)
    assert got["single", 1].score <= 15 and {r.penalty > 0 for r in got.values()} == {True, False}


# ---- t11_alert_fatigue -----------------------------------------------------------------
def test_fatigue_keeps_rows_as_rows(spark):
    """Dense and sparse groups against a plain fold; no group becomes an array."""
    rnd, start, quiet = random.Random(7), datetime(2024, 1, 1), 7200
    rows = [(u, f"r{rnd.randrange(3)}", f"t{rnd.randrange(4)}", "high", start + timedelta(seconds=rnd.randrange(200_000) if u else 60 * i), rnd.random() < 0.05) for u in (0, 1) for i in range(600)]
    rows = sorted({r[:5]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "user_id long, rule_id string, trend_id string, severity string, fired_at timestamp_ntz, is_phase_change boolean")
    groups = spark.createDataFrame([("t0", "g"), ("t1", "g")], "trend_id string, group_id string")
    out = alerts.limit_fatigue(df, {}, groups, quiet)
    want, last = {}, {}
    for u, r, t, _, at, change in sorted(rows, key=lambda x: (x[4], x[1], x[2])):
        k = (u, "g" if t in ("t0", "t1") else t)
        if k not in last or change or at - last[k][0] >= timedelta(seconds=quiet):
            last[k] = (at, (u, r, t, at))
            want[u, r, t, at] = 0
        want[last[k][1]] += 1
    assert {(x.user_id, x.rule_id, x.trend_id, x.fired_at): x.stands_for for x in out.collect()} == want
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


# ---- d15_simhash_distinct --------------------------------------------------------------
def test_simhash_counts_documents_without_tokens(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, "alpha beta gamma delta", "en", "a", 22), (2, "alpha beta gamma delta", "en", "a", 22), (3, None, "en", "a", 0), (4, "", "en", "b", 0), (5, "https://e.test/x", "en", "b", 16)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.source: (r.docs, r.distinct_contents, r.near_copies) for r in entry.queries()["d15_simhash_distinct"](spark, str(tmp_path)).collect()}
    assert got == {"a": (3, 1, 1), "b": (2, 0, 0)}
