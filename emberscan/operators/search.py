"""Ranked text search and fuzzy matching over a postings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def words(text: Column) -> Column:
    """Lower-cased words longer than two letters."""
    clean = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " ")
    return F.filter(F.split(clean, r"(?U)\s+"), lambda w: F.length(w) > 2)


def tokenised(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, len, w): the words of every document, written once and searched often."""
    return cut(docs.select(id_col, words(F.col(text)).alias("w")).select(id_col, F.size("w").alias("len"), "w"))


#: Query terms that may ride with every task.
FEW_TERMS = 20_000


def bm25(queries: DataFrame, docs: DataFrame, id_col: str, text: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Top ``k`` documents per query. ``queries``: (query_id, q).

    Documents are tokenised once. Only postings of query terms are kept, and
    they are counted inside the document, where no term is hot. Few query terms
    go to the postings, which lie by document: words of no query are dropped in
    the row that holds them, and a document's scores are summed where its
    postings are, so no (query, document) pair is shuffled but the best ``k`` of
    a task. Many terms are joined with the written postings; both sides are
    plain tables there, so Spark can split a common term. A repeated
    query term counts again. Scores are compared at nine decimals, so equal
    documents rank by id whatever the order of summation.
    """
    qt = queries.select("query_id", F.explode(words(F.col("q"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    qt = cut(qt)
    terms = [r["term"] for r in qt.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    few = len(terms) <= FEW_TERMS and qt.count() <= 10 * FEW_TERMS
    if few:
        w = docs.select(id_col, words(F.col(text)).alias("w"))
        tok = cut(w.select(id_col, F.size("w").alias("len"), F.filter("w", lambda x: x.isin(terms)).alias("w")))
        hit = tok.select(id_col, "len", F.explode("w").alias("term")).repartition(id_col)
    else:
        tok = tokenised(docs, id_col, text)
        hit = tok.select(id_col, "len", F.explode("w").alias("term")).join(qt.select("term").distinct(), "term", "left_semi")
    totals = tok.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    tf = cut(hit.groupBy(id_col, "len", "term").agg(F.count("*").alias("tf")))
    n, avgdl = totals.select("n").scalar(), totals.select("avgdl").scalar()
    df = cut(tf.groupBy("term").agg(F.count("*").alias("df")))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighed = qt.join(df, "term").select("query_id", "term", (F.col("qn") * idf).alias("x"))
    part = F.col("x") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / avgdl))
    both = tf.repartition(id_col).join(F.broadcast(weighed), "term") if few else weighed.join(tf, "term")
    score = both.groupBy("query_id", id_col).agg(F.sum(part).alias("score"))
    win = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), id_col)
    return score.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= k)


def contains_all(docs: DataFrame, id_col: str, text: str, terms: list[str]) -> DataFrame:
    """Documents holding every given word."""
    w = words(F.col(text))
    return docs.where(F.size(F.array_except(F.array(*[F.lit(t.lower()) for t in terms]), w)) == 0).select(id_col)


#: Trigrams of all needles that may ride with every task.
FEW_GRAMS = 200_000


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(F.trim(text)), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))


def fuzzy(names: DataFrame, id_col: str, name: str, needles: DataFrame, min_similarity: float) -> DataFrame:
    """Names similar to a needle by the Jaccard of their letter trigrams.

    ``needles``: (needle_id, needle). Similar names share a trigram, so the join
    is on trigrams and the overlap is the number of joined rows. The exploded
    names look small to the planner and are never to be sent whole to every
    task: needles are sent if they are few, else both sides are shuffled.
    """
    a = names.select(id_col, trigrams(F.col(name)).alias("t")).select(id_col, F.size("t").alias("na"), F.explode("t").alias("g"))
    b = needles.select("needle_id", trigrams(F.col("needle")).alias("t")).select("needle_id", F.size("t").alias("nb"), F.explode("t").alias("g"))
    few = b.limit(FEW_GRAMS + 1).count() <= FEW_GRAMS
    j = (a.join(F.broadcast(b), "g") if few else a.hint("merge").join(b, "g")).groupBy(id_col, "needle_id", "na", "nb").agg(F.count("*").alias("c"))
    s = F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))
    return j.select(id_col, "needle_id", s.alias("similarity")).where(F.col("similarity") >= min_similarity)
