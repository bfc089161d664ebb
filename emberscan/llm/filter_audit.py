"""Filter interaction audit: one word per document says which subsets of the filters it survives.

Five filters have 32 subsets. A document that fails the filters ``f`` survives
the subset ``s`` where ``s & f`` is 0; bit ``s`` of its 32-bit word says so. The
number of survivors of every subset, for each part and label, is a positional
popcount of the words, taken with carry-save adders: three words of one weight
become a sum of that weight and a carry of the next, all 32 positions at once.
Every order of the filters is then read off the 32 counts.

Filter E (an earlier identical text) needs the whole table. Texts are told
apart by SHA-256 and folded before the shuffle to one row per (text, part,
labels), so a text with a third of all rows is a few rows; its copies share a
word that enters the adders by the binary digits of their number.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Survival word of every set of failed filters.
WORDS = [sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)]
#: Salts that spread rows without doc_id, which meet no label.
SALTS = 64


def failures(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text (not null) fails."""
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = (n < 200, 100 * distinct < 50 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((fail.cast("int") * (1 << i) for i, fail in enumerate(fails)), F.lit(0))


def positional_popcount(words: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often each of the 32 bits is set in ``words``, every word counted ``weight`` times."""
    counts = np.zeros(SUBSETS, np.int64)
    carried: list[np.ndarray] = []
    level = 0
    while carried or (weight >> level).any():
        held = np.concatenate([*carried, words[(weight >> level) & 1 == 1]])
        carried = []
        while len(held) > 2:
            third = len(held) // 3
            a, b, c = held[:third], held[third:2 * third], held[2 * third:3 * third]
            half = a ^ b
            carried.append((a & b) | (c & half))
            held = np.concatenate([half ^ c, held[3 * third:]])
        for word in held:
            counts += ((int(word) >> np.arange(SUBSETS)) & 1) << level
        level += 1
    return counts


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, part and labels: survivors of every subset."""
    for b in batches:
        if not b.num_rows:
            continue
        part = pc.dictionary_encode(b.column("part"))
        group = part.indices.to_numpy().astype(np.int64) * 4 + b.column("good").to_numpy() * 2 + b.column("toxic").to_numpy()
        word, weight = b.column("word").to_numpy().astype(np.uint32), b.column("weight").to_numpy()
        order = np.argsort(group, kind="stable")
        group, word, weight = group[order], word[order], weight[order]
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = np.append(cut[1:], len(group))
        named = group[cut]
        yield pa.record_batch({
            "part": part.dictionary.take(pa.array(named // 4)), "good": pa.array((named // 2 % 2).astype(np.int32)), "toxic": pa.array((named % 2).astype(np.int32)),
            "survive": pa.array([positional_popcount(word[lo:hi], weight[lo:hi]) for lo, hi in zip(cut, ends)], pa.list_(pa.int64()))})


def survival_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, word, weight): ``weight`` documents of a part and labels share the word.

    A null text is empty and a null source is the part of the empty one. A
    document is good (toxic) where any of its label rows has quality (toxic) 1.
    E fails where a row with a smaller doc_id holds the same text: rows that
    repeat the smallest id all pass it, and rows without id never fail it, make
    no other row fail it, and have no label.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), failures(text).alias("f"), F.unhex(F.sha2(text, 256)).alias("same"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("same", F.rand(7)), F.lit(SALTS))).otherwise(F.lit(0))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("salt")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    both = rows.withColumn("salt", salt.cast("long")).join(marks, ["doc_id", "salt"], "left").fillna(0, ["good", "toxic"])
    once = both.groupBy("doc_id", "salt", "same", "part", "f", "good", "toxic").agg(F.count("*").alias("m"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "m")))
    folded = once.groupBy("same", "part", "f", "good", "toxic").agg(
        F.sum("m").alias("n"), first.alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("m")).otherwise(0)).alias("free"))
    earliest = F.min("first.doc_id").over(Window.partitionBy("same"))
    passing = F.col("free") + F.when(F.col("first.doc_id") == F.col("earliest"), F.col("first.m")).otherwise(0)
    table = F.array(*[F.lit(w) for w in WORDS])
    kinds = F.explode(F.array(
        F.struct(table[F.col("f")].alias("word"), F.col("passing").alias("weight")),
        F.struct(table[F.col("f") + 16].alias("word"), (F.col("n") - F.col("passing")).alias("weight"))))
    return folded.withColumn("earliest", earliest).withColumn("passing", passing).select("part", "good", "toxic", kinds.alias("k")).select(
        "part", "good", "toxic", "k.word", "k.weight").where("weight > 0")


def subset_survivors(words: DataFrame) -> DataFrame:
    """(part, c): ``c[s]`` has how many documents (n), good and toxic ones survive the subset ``s``."""
    sums = words.mapInArrow(_survivors, "part string, good int, toxic int, survive array<long>").select("part", "good", "toxic", F.posexplode("survive").alias("s", "k"))
    per = sums.groupBy("part", "s").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("good")).alias("good"), F.sum(F.col("k") * F.col("toxic")).alias("toxic"))
    return per.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("s", "n", "good", "toxic"))).alias("c"))


def _steps() -> Column:
    """All orders of the filters, step by step: the subsets before and after, and the filter between them."""
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for k, i in enumerate(order):
            steps.append({"filter_order": "".join(FILTERS[j] for j in order), "step": k + 1, "i": i, "before": before, "after": before | 1 << i, "mine": 1 << i, "rest": SUBSETS - 1 - (1 << i)})
            before |= 1 << i
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, i: int, before: int, after: int, mine: int, rest: int>>")


def _shapley(c: Column, i: int) -> Column:
    """Documents that filter ``i`` removes, over all orders: ``|s|! (4 - |s|)!`` of them put it right behind the subset ``s``."""
    others = [s for s in range(SUBSETS) if not s >> i & 1]
    return sum((math.factorial(s.bit_count()) * math.factorial(len(FILTERS) - 1 - s.bit_count()) * (c[s]["n"] - c[s | 1 << i]["n"]) for s in others), F.lit(0))


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    An empty table has no part and no row. Nulls, ties and repeated rows are
    those of ``survival_words``; other columns of the tables are never read.
    """
    per = written(subset_survivors(survival_words(docs, labels)), "survivors")
    rows = per.select("part", "c", F.array(*[_shapley(F.col("c"), i) for i in range(len(FILTERS))]).alias("shapley"), F.explode(_steps()).alias("o"))
    at = lambda name, what: F.col("c")[F.col(f"o.{name}")][what]
    lost = lambda what: at("before", what) - at("after", what)
    return rows.select(
        "part", "o.filter_order", "o.step", at("after", "n").alias("kept"), lost("n").alias("removed"),
        (F.col("c")[0]["n"] - at("mine", "n") - lost("n")).alias("redundant"), (at("rest", "n") - F.col("c")[SUBSETS - 1]["n"]).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("shapley")[F.col("o.i")].alias("shapley"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS g, max((toxic = 1)::INT) AS x FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(g, 0) AS g, coalesce(x, 0) AS x,
             [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t), false)] AS f
      FROM t LEFT JOIN l USING (doc_id)),
k AS (SELECT part, g, x, f, count(*) AS n FROM d GROUP BY ALL),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS s),
o AS (SELECT a.s || b.s || c.s || e.s || g.s AS o FROM s a, s b, s c, s e, s g
      WHERE len(list_distinct([a.s, b.s, c.s, e.s, g.s])) = 5),
q AS (SELECT part, o, i, substr(o, i, 1) AS mine, n, n * g AS gn, n * x AS xn, f[strpos('ABCDE', substr(o, i, 1))] AS bad,
             len(list_filter(range(1, i), lambda j: f[strpos('ABCDE', substr(o, j, 1))])) > 0 AS gone,
             len(list_filter(f, lambda v: v)) AS fails
      FROM k, o, range(1, 6) r(i)),
z AS (SELECT part, o AS filter_order, i::INT AS step, mine,
             coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad AND fails = 1), 0)::BIGINT AS unique_fails,
             coalesce(sum(gn) FILTER (bad AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(xn) FILTER (bad AND NOT gone), 0)::BIGINT AS toxic_lost
      FROM q GROUP BY ALL)
SELECT * EXCLUDE (mine), (sum(removed) OVER (PARTITION BY part, mine))::BIGINT AS shapley FROM z"""
