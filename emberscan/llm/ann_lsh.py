"""Nearest vectors by cosine: multiprobe p-stable hashing with exact distances at the end.

A table cuts ``HASHES`` random Gaussian projections of the unit vectors into
cells of one width; a bucket is one cell of each. A query visits its own
bucket and those one cell up or down in some projections, in the order of
their estimated success: the squared distances from the query to the
cell borders crossed, added up. Candidates of all tables are compared with the
query in double precision inside their bucket, and only the nearest leave it.

Equal vectors are folded to one row that keeps their smallest ids, so copies
of a vector are one candidate. A bucket of more than ``BLOCK`` vectors is dealt
into blocks, each of which sees all its queries; nothing is left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import written
from .words import mix, signed

TABLES, HASHES, PROBES = 10, 12, 48
#: Width of a cell, in standard deviations of a projection of a random unit vector.
WIDTH = 3.0
#: Projections in which a probe leaves its own cell at most.
CHANGES = 3
#: Vectors that are compared at once.
BLOCK = 2048



def _steps() -> np.ndarray:
    """All ways to go one cell down or up in at most ``CHANGES`` projections."""
    out = [np.zeros(HASHES, np.int64)]
    for r in range(1, CHANGES + 1):
        for where in itertools.combinations(range(HASHES), r):
            for way in itertools.product((-1, 1), repeat=r):
                out.append(np.zeros(HASHES, np.int64))
                out[-1][list(where)] = way
    return np.stack(out)


_STEPS = _steps()


def _vectors(col: pa.Array) -> np.ndarray:
    """Vectors scaled by a power of two to components of at most one: cosines stay, and no square over- or underflows to nothing."""
    if not len(col):
        return np.zeros((0, 1))
    x = np.array(col.to_pylist(), np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _buckets(queries: bool, tables: int, probes: int):
    """One row for each table (and each probe of a query): bucket, id and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                size = b.column("dim").to_numpy()
                for dim in np.unique(size):
                    k = np.flatnonzero(size == dim)
                    part = b.take(pa.array(k))
                    u = _unit(_vectors(part.column("vec")))
                    for t in range(tables):
                        rng = np.random.default_rng([int(dim), t, 11])
                        a, shift = rng.normal(size=(int(dim), HASHES)), rng.uniform(size=HASHES)
                        p = u @ a * np.sqrt(dim) / np.linalg.norm(a, axis=0) / WIDTH + shift
                        cell = np.floor(p)
                        cells = cell[:, None, :]
                        if queries:
                            f = p - cell
                            total = (f * f) @ (_STEPS < 0).T + (1 - f) ** 2 @ (_STEPS > 0).T
                            best = np.argsort(total, axis=1, kind="stable")[:, :probes]
                            cells = cells + _STEPS[best]
                        key = np.full(cells.shape[:2], np.uint64(int(dim) * 1000 + t))
                        for j in range(HASHES):
                            key = mix(key ^ mix(cells[:, :, j].astype(np.int64).view(np.uint64) + np.uint64(j)))
                        rows = np.repeat(np.arange(len(k)), key.shape[1])
                        yield pa.record_batch({"bucket": signed(key.ravel()), "id": part.column("id").take(pa.array(rows)), "vec": part.column("vec").take(pa.array(rows))})
    return run


def _compare(keep: int):
    """Nearest candidates of the queries of every (bucket, block); rows come sorted with candidates first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, rows, units = None, [], [], None
        for b in batches:
            key = np.stack([b.column("bucket").to_numpy(), b.column("block").to_numpy(), b.column("is_query").to_numpy()], 1)
            cut = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(key))
            for lo, hi in zip(cut[:-1], cut[1:]):
                if here != tuple(key[lo, :2]):
                    here, ids, rows, units = tuple(key[lo, :2]), [], [], None
                part = b.slice(lo, hi - lo)
                if not key[lo, 2]:
                    ids.append(part.column("id").to_numpy())
                    rows.append(part.column("vec"))
                    continue
                if not ids:
                    continue
                if units is None:
                    found = np.concatenate(ids)
                    order = np.argsort(found)  # of equal scores the smaller id comes first
                    found = found[order]
                    units = np.concatenate([_vectors(r) for r in rows])[order]
                    norm = np.linalg.norm(units, axis=1)
                for at in range(0, part.num_rows, 512):
                    q = part.slice(at, 512)
                    x = _vectors(q.column("vec"))
                    score = x @ units.T / (np.linalg.norm(x, axis=1)[:, None] * norm)
                    n = min(keep, score.shape[1])
                    best = np.argsort(-score, axis=1, kind="stable")[:, :n]
                    yield pa.record_batch({"query": pa.array(np.repeat(q.column("id").to_numpy(), n)), "id": pa.array(found[best].ravel()),
                                           "score": pa.array(np.take_along_axis(score, best, 1).ravel())})
    return run


def _met(candidates: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nearest distinct candidates of every query, from rows (bucket, block, id, vec)."""
    side = lambda df, q: df.select("bucket", "block", F.lit(q).alias("is_query"), "id", "vec")
    both = side(candidates, 0).union(side(queries, 1)).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "is_query")
    near = both.mapInArrow(_compare(keep), "query long, id long, score double").groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).drop("r")


def nearest(vectors: DataFrame, is_query, k: int = 5, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """The ``k`` nearest found for every query row: query_id, rank from 1, vec_id, score (cosine).

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on it.
    Ties go to the smaller vec_id. Rows without id, and vectors that are null,
    empty, zero, or hold a null or non-finite number take no part; vectors of
    different lengths never meet. Rows that repeat an id and its vector are
    one row. A query that met fewer than ``k`` other vectors in its buckets is
    compared with all rows, in blocks.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), is_query.alias("asks"))
    big = F.lit(float("inf"))
    ok = v.where("id is not null and vec is not null and size(vec) > 0").where(
        F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("vec", lambda x: x != 0))
    # -0.0 and 0.0 are one number
    ok = ok.withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, 0.0).otherwise(x)))
    ok = ok.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(17), F.reverse("vec"))).distinct()
    members = ok.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= k + 1)
    members = written(members.select("h1", "h2", "r", "id", "vec", F.size("vec").alias("dim")), "members")
    heads = members.where("r = 1").select("h1", "h2", "id", "vec", "dim")
    asked = written(ok.where("asks").select("h1", "h2", F.col("id").alias("query_id")), "asked")
    ask = written(heads.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("id", "vec", "dim"), "queries")
    rows = "bucket long, id long, vec array<double>"
    cand = heads.select("id", "vec", "dim").mapInArrow(_buckets(False, tables, probes), rows)
    hot = written(cand.groupBy("bucket").count().where(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).alias("blocks")), "hot")
    blocks = F.coalesce("blocks", F.lit(1)).cast("long")
    dealt = cand.join(hot, "bucket", "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    visits = ask.mapInArrow(_buckets(True, tables, probes), rows).join(hot, "bucket", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    found = written(_met(dealt, visits, k + 1), "found")

    # The few that met too little: all rows of their length, in blocks. There are few lengths: n of them need n * n / 2 numbers.
    total = F.broadcast(heads.groupBy("dim").agg(F.count("*").alias("total")))
    have = found.groupBy(F.col("query").alias("id")).agg(F.count("*").alias("have"))
    unmet = ask.join(have, "id", "left").join(total, "dim").where(F.coalesce("have", F.lit(0)) < F.least(F.lit(k + 1), F.col("total")))
    unmet = written(unmet.select("id", "vec", "dim", F.ceil(F.col("total") / BLOCK).alias("blocks")), "unmet")
    every = heads.join(F.broadcast(unmet.select("dim", "blocks").distinct()), "dim").select(
        F.col("dim").cast("long").alias("bucket"), F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", "vec")
    asks = unmet.select(F.col("dim").cast("long").alias("bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id", "vec")
    full = found.union(_met(every, asks, k + 1)).groupBy("query", "id").agg(F.max("score").alias("score"))

    # from heads back to all ids: a query's class, and the smallest ids of every class met
    classes = members.select("h1", "h2", F.col("id").alias("vec_id")).join(heads.select("h1", "h2", F.col("id").alias("head")), ["h1", "h2"])
    spread = written(full.join(classes.select(F.col("head").alias("id"), "vec_id"), "id").select(F.col("query").alias("head"), "vec_id", "score"), "spread")
    own = asked.join(heads.select("h1", "h2", F.col("id").alias("head")), ["h1", "h2"]).select("query_id", "head").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = own.join(spread, "head").where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
