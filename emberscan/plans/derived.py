"""Shared derived tables of the list, alert and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import bucket
from ..operators import backtest, clusters
from .early import TRENDS, profile_sql, score_sql, scored
from .views import SCALE, mentions, now_of, posts, posts_sql, texts

STEP = 15 * 60 * SCALE  # one scaled quarter of an hour: a day


def posts_full(spark, sf):
    """Posts with the language of their document."""
    return posts(spark, sf).join(texts(spark, sf).select("doc_id", "lang"), "doc_id")


def trend_rows(spark, sf):
    """Scored trends with title, summary and originator."""
    roll = clusters.rollup(posts_full(spark, sf)).select("trend_id", "title", "summary", "languages", "originator")
    return scored(spark, sf).join(roll, "trend_id")


TREND_ROWS = TRENDS + posts_sql() + """
, rc AS (SELECT trend_id, text, row_number() OVER (PARTITION BY trend_id ORDER BY published_at DESC, external_id DESC) AS rn FROM po),
ti AS (SELECT trend_id, first(trim(text) ORDER BY length(trim(text)), rn) AS title FROM rc WHERE rn <= 3 AND length(trim(text)) > 0 GROUP BY 1),
su AS (SELECT trend_id, first(substr(text, 1, 200) ORDER BY length(text) DESC, published_at, external_id) AS summary FROM po GROUP BY 1),
tr AS (SELECT sc.*, CASE WHEN length(title) > 140 THEN substr(title, 1, 137) || '...' ELSE title END AS title, summary
  FROM sc JOIN ti USING (trend_id) JOIN su USING (trend_id))"""


def ticks(spark, sf):
    """The whole early score of every trend at a grid of clocks."""
    return backtest.tick_scores(mentions(spark, sf), now_of(spark, sf), STEP)


# Profile and score of early.py over every (trend, tick) as if it were a trend of its own with its own clock.
TICKS = f"""
, grid AS (SELECT k AS tick, p.now - to_seconds({STEP} * k) AS tick_at FROM p, range(60) r(k)),
mt AS (SELECT m.* REPLACE (trend_id || '#' || tick AS trend_id), tick FROM m JOIN grid ON published_at <= tick_at),
se AS (SELECT trend_id, avg(sentiment) AS sentiment FROM mt JOIN grid USING (tick) WHERE published_at > tick_at - to_seconds({4 * STEP}) GROUP BY 1)""" + profile_sql().replace(
    "FROM m, p\n", "FROM mt m JOIN (SELECT tick, tick_at AS now FROM grid) g USING (tick)\n") + score_sql() + """,
tm AS (SELECT sc.* REPLACE (split_part(sc.trend_id, '#', 1) AS trend_id), se.sentiment, grid.tick, tick_at
  FROM sc JOIN se ON se.trend_id = sc.trend_id JOIN grid ON grid.tick = CAST(split_part(sc.trend_id, '#', 2) AS BIGINT) WHERE m60 > 0)"""


# ---- small literal side tables -----------------------------------------------------
SAVED = [("t1", "ai", "follow up on topic", True, None, "2024-01-20 10:00:00"), ("t3", "ai", None, False, "2024-02-10 00:00:00", "2024-01-22 09:00:00"),
         ("t4", None, "weak rumor", False, "2024-01-25 00:00:00", "2024-01-23 08:00:00"), ("t6", "chips", "", True, None, "2024-01-24 07:00:00"),
         ("t9", None, None, False, None, "2024-01-25 06:00:00"), ("t77", "chips", "gone", False, None, "2024-01-26 05:00:00")]
RULES = [
    ("r01", "t1", "score_gt", 40.0, None, None, 172800, True, "high", 1), ("r02", None, "velocity_gt", 2.0, None, None, 86400, True, "high", 1),
    ("r03", None, "mentions_gt", 120.0, None, None, 345600, True, "info", 2), ("r04", "t2", "mentions_lt", 100.0, None, None, 86400, True, "info", 2),
    ("r05", None, "phase_is", 0.0, None, "decaying", 259200, True, "medium", 1), ("r06", None, "phase_change", 0.0, None, None, 0, True, "info", 1),
    ("r07", "t3", "delta_pct_gt", 5.0, None, None, 172800, True, "high", 2), ("r08", "t4", "source_breakout", 0.0, None, None, 86400, True, "critical", 1),
    ("r09", "t5", "between", 40.0, 60.0, None, 432000, True, "medium", 2), ("r10", None, "source_count", 5.0, None, None, 604800, True, "critical", 1),
    ("r11", "t6", "sentiment", 5.0, None, None, 172800, True, "high", 2), ("r12", "t7", "score_gt", 10.0, None, None, 60, False, "critical", 1),
    ("r13", "t99", "score_gt", 10.0, None, None, 60, True, "high", 1),
]


def _values(rows):
    def lit(v):
        return "NULL" if v is None else ("true" if v is True else "false" if v is False else f"'{v}'" if isinstance(v, str) else str(v))

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


SAVED_SQL = f"""
, saved AS (SELECT trend_id, folder, notes, pinned, CAST(snoozed_until AS TIMESTAMP) AS snoozed_until, CAST(created_at AS TIMESTAMP) AS created_at
  FROM (VALUES {_values(SAVED)}) v(trend_id, folder, notes, pinned, snoozed_until, created_at))"""
RULES_SQL = f"""
, rules AS (SELECT rule_id, trend_id, condition, CAST(threshold AS DOUBLE) AS threshold, CAST(threshold_max AS DOUBLE) AS threshold_max, rule_phase,
   CAST(cooldown_sec AS BIGINT) AS cooldown_sec, armed, severity, CAST(user_id AS BIGINT) AS user_id
  FROM (VALUES {_values(RULES)}) v(rule_id, trend_id, condition, threshold, threshold_max, rule_phase, cooldown_sec, armed, severity, user_id))"""


def saved(spark):
    df = spark.createDataFrame(SAVED, "trend_id string, folder string, notes string, pinned boolean, snoozed_until string, created_at string")
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("snoozed_until", "created_at")})


def rules(spark):
    from ..operators.alerts import RULE_SCHEMA

    return spark.createDataFrame(RULES, RULE_SCHEMA)
