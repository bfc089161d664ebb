"""Domain views over the given tables, and the same views as SQL text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import Trailing

# One "minute" of the early score lasts 96 minutes here: the event table is too
# thin for the default windows, so all of them are stretched alike.
SCALE = 96
TRAILING = Trailing(scale=SCALE)

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give row-wise heavy work enough tasks when the input has only a few splits.

    A large table already has more splits than cores and is returned as it is, so
    nothing is shuffled there.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def text_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Hash of the normalised text per document, partitioned for joins on doc_id.

    The exchange is the one a join on doc_id needs anyway; it also keeps a
    broadcast join from repeating the hash for every matching row.
    """
    from ..functions import text as tx

    d = documents(spark, sf).select("doc_id", "lang", F.sha1(tx.normalise(F.col("text"))).alias("text_hash"))
    return d.repartition("doc_id")


def now_of(spark: SparkSession, sf: str) -> datetime:
    """Clock of a data set: its latest event. One column, answered from footers."""
    return table(spark, sf, "events").agg(F.max("ts").alias("t")).first()["t"]


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """One mention per event. Columns not used by a query are never read."""
    docs = table(spark, sf, "documents").agg(F.count("*").alias("n")).scalar()
    return as_mentions(table(spark, sf, "events"), docs)


def as_mentions(e: DataFrame, docs) -> DataFrame:
    """Events as mentions; ``docs`` is the number of documents. Works on streams."""
    kind = F.col("event_type")
    source = (
        F.when(kind == "click", "reddit").when(kind == "view", "bluesky").when(kind == "purchase", "x")
        .when(kind == "signup", "rss").otherwise("hn")
    )
    k = F.get_json_object("props", "$.k").cast("bigint")
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        i.alias("external_id"),
        source.alias("source"),
        u.alias("author_id"),
        F.col("ts").alias("published_at"),
        F.concat(F.lit("t"), k % 10).alias("trend_id"),
        (i % docs).alias("doc_id"),
        F.concat(source, F.lit("/"), k % 7).alias("community"),
        F.concat(F.lit("https://e.test/"), i % 400).alias("url"),
        F.floor(F.col("value") * 10).alias("reach"),
        (((i * 37) % 201 - 100) / F.lit(100.0)).alias("sentiment"),
        (((u * 29) % 101) / F.lit(100.0)).alias("author_quality"),
        (((u * 17) % 10) / F.lit(10.0)).alias("bot_score"),
        ((u * 13) % 1500).alias("author_age_days"),
        ((u * 101) % 50000).alias("followers"),
        (u % 11 == 0).alias("verified"),
        F.when(i % 5 != 0, i - 1).alias("reply_to"),
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang")


def mentions_with_text(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions joined to their text. An equi-join on a unique document key."""
    return mentions(spark, sf).join(texts(spark, sf), "doc_id")


# ---- the same views as SQL ---------------------------------------------------
P = """
WITH p AS (SELECT (SELECT max(ts) FROM events) AS now, (SELECT count(*) FROM documents) AS nd),
m AS (
  SELECT event_id AS external_id,
    CASE event_type WHEN 'click' THEN 'reddit' WHEN 'view' THEN 'bluesky' WHEN 'purchase' THEN 'x'
      WHEN 'signup' THEN 'rss' ELSE 'hn' END AS source,
    user_id AS author_id, ts AS published_at, 't' || (k % 10) AS trend_id, event_id % nd AS doc_id,
    (CASE event_type WHEN 'click' THEN 'reddit' WHEN 'view' THEN 'bluesky' WHEN 'purchase' THEN 'x'
      WHEN 'signup' THEN 'rss' ELSE 'hn' END) || '/' || (k % 7) AS community,
    'https://e.test/' || (event_id % 400) AS url,
    CAST(floor(value * 10) AS BIGINT) AS reach,
    CAST((event_id * 37) % 201 - 100 AS DOUBLE) / 100 AS sentiment,
    CAST((user_id * 29) % 101 AS DOUBLE) / 100 AS author_quality,
    CAST((user_id * 17) % 10 AS DOUBLE) / 10 AS bot_score,
    (user_id * 13) % 1500 AS author_age_days,
    (user_id * 101) % 50000 AS followers,
    user_id % 11 = 0 AS verified,
    CASE WHEN event_id % 5 <> 0 THEN event_id - 1 END AS reply_to
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events) e, p
)
"""


def sql(body: str, **names) -> str:
    """Prefix ``body`` with the shared views. ``body`` may add CTEs after a comma."""
    for key, value in names.items():
        body = body.replace("{" + key + "}", str(value))
    return P + body


# ---- short posts derived from the events ----------------------------------------
def _pick(words, index):
    return F.get(F.array(*[F.lit(w) for w in words]), index.cast("int"))


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions with a short synthetic text that carries every kind of entity."""
    return with_post_text(spread(mentions(spark, sf)))


def with_post_text(m: DataFrame) -> DataFrame:
    from ..params import BRANDS, LOCATIONS, ORGS

    i, u = F.col("external_id"), F.col("author_id")
    b = _pick(BRANDS, i % 30)
    text = F.concat(
        b, F.lit(" rumor via @user"), u.cast("string"), F.lit(" #topic"), (i % 7).cast("string"),
        F.when(i % 3 == 0, F.concat(F.lit(" $"), F.upper(F.substring(b, 1, 3)))).otherwise(""),
        F.when(i % 4 == 0, F.concat(F.lit(" cve-2024-"), (1000 + i % 50).cast("string"))).otherwise(""),
        F.when(i % 2 == 0, F.concat(F.lit(" RTX"), (100 + i % 40).cast("string"))).otherwise(""),
        F.lit(" "), _pick(ORGS, u % 20), F.lit(" in "), _pick(LOCATIONS, i % 30),
        F.when(i % 11 == 0, " breaking news").otherwise(""),
        F.when(i % 10 == 0, F.concat(F.lit(" mail"), u.cast("string"), F.lit("@e.test"))).otherwise(""),
        F.lit(" "), F.col("url"))
    return m.withColumn("text", text)


def _list(words):
    return "[" + ",".join("'" + w + "'" for w in words) + "]"


def posts_sql() -> str:
    """CTE ``po``: the same posts."""
    from ..params import BRANDS, LOCATIONS, ORGS

    b = f"{_list(BRANDS)}[external_id % 30 + 1]"
    return f"""
, po AS (SELECT *, {b} || ' rumor via @user' || author_id || ' #topic' || (external_id % 7)
  || CASE WHEN external_id % 3 = 0 THEN ' $' || upper(substr({b}, 1, 3)) ELSE '' END
  || CASE WHEN external_id % 4 = 0 THEN ' cve-2024-' || (1000 + external_id % 50) ELSE '' END
  || CASE WHEN external_id % 2 = 0 THEN ' RTX' || (100 + external_id % 40) ELSE '' END
  || ' ' || {_list(ORGS)}[author_id % 20 + 1] || ' in ' || {_list(LOCATIONS)}[external_id % 30 + 1]
  || CASE WHEN external_id % 11 = 0 THEN ' breaking news' ELSE '' END
  || CASE WHEN external_id % 10 = 0 THEN ' mail' || author_id || '@e.test' ELSE '' END || ' ' || url AS text FROM m)"""
