"""Vector code compression: codebooks per part, kept up by Drake-Hamerly adaptive bounds.

Vectors are cut into equal parts, and every part has a codebook whose entries
move for a few rounds (integer k-means). A row keeps, for each of its parts,
the ``b`` closest entries in order with lower bounds of their distances, and
one outer bound for all other entries. When entries move, the bounds shrink by
the moves; the distance to the row's own entry is computed exactly, and only
the listed entries whose bounds it reaches are measured again, in integers.
Where it reaches the outer bound, all entries are. ``b`` is then lowered to the
longest list that a row really needed, but not below ``least``.

The state is a Parquet table for every round. Codebooks, sums and moves have a
fixed size and pass through the driver; vectors never do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest component after scaling; beyond it values stay at the limit, so that squared distances fit 64 bits.
LIMIT = 1 << 26
#: Relative slack of a bound against rounding.
SLACK = 1e-12
#: Rows that are measured at once, and copies of a label's sum in the last join.
CHUNK, SALTS = 1024, 32


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): components floor(scale * x); rows with a null vector, or null or non-finite components, go."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("x"))
    big = F.lit(float("inf"))
    ok = v.where(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < big)))
    return ok.withColumn("x", F.transform("x", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long")))


def _numbers(col: pa.Array, parts: int) -> np.ndarray:
    """Vectors of one length as (row, part, position)."""
    return col.flatten().to_numpy().reshape(len(col), parts, -1)


def _down(x: np.ndarray) -> np.ndarray:
    """Half-precision numbers that are not above ``x``, which is 0 or more (or infinite)."""
    y = np.minimum(x, 65504.0).astype(np.float16)
    y = np.where(y.astype(np.float64) > x, np.nextafter(y, np.float16(0)), y)
    return np.where(np.isinf(x), np.float16(np.inf), y)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances in integers of every row to entries (of all rows, or of each row)."""
    d = x[:, None, :] - entries
    return np.einsum("nkd,nkd->nk", d, d)


def _rank(square: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Order of each row's entries by distance, ties to the lower index."""
    return np.lexsort((index, square), axis=1)


class _Bounds:
    """Closest entries of one part of some rows: list, lower bounds, outer bound, and the list length each row needed."""

    def __init__(self, near: np.ndarray, low: np.ndarray, outer: np.ndarray):
        self.near, self.low, self.outer = near, low, outer
        self.used = np.zeros(len(near), np.int32)
        self.square = np.zeros(len(near), np.int64)

    @classmethod
    def full(cls, x: np.ndarray, book: np.ndarray, b: int) -> _Bounds:
        square = _squares(x, book[None])
        order = _rank(square, np.broadcast_to(np.arange(len(book)), square.shape))[:, :b + 1]
        root = np.sqrt(np.take_along_axis(square, order, 1)) * (1 - SLACK)
        outer = root[:, b] if root.shape[1] > b else np.full(len(x), np.inf)
        new = cls(order[:, :b], root[:, :b], outer)
        new.square = np.take_along_axis(square, order[:, :1], 1)[:, 0]
        return new

    def moved(self, x: np.ndarray, book: np.ndarray, move: np.ndarray, b: int) -> None:
        """Bounds and lists after the entries moved to ``book``; lists are cut to ``b`` first."""
        self.outer = np.minimum(self.outer, self.low[:, b:].min(1, initial=np.inf)) - move.max(initial=0)
        self.near = self.near[:, :b]
        self.low = self.low[:, :b] - move[self.near]
        d = x - book[self.near[:, 0]]
        self.square = (d * d).sum(1)
        reach = np.sqrt(self.square) * (1 + SLACK)
        # least[z]: no entry from place z of the list on, nor any outside it, is nearer
        least = np.minimum.accumulate(np.concatenate([self.low, self.outer[:, None]], 1)[:, ::-1], 1)[:, ::-1]
        safe = least[:, 1:] > reach[:, None]
        need = np.where(safe.any(1), safe.argmax(1) + 1, 0)
        self.used = need.astype(np.int32)
        self.low[:, 0] = np.sqrt(self.square) * (1 - SLACK)
        for z in np.unique(need[need > 1]):
            k = np.flatnonzero(need == z)
            index = self.near[k, :z]
            square = _squares(x[k], book[index])
            order = _rank(square, index)
            square = np.take_along_axis(square, order, 1)
            self.near[k, :z] = np.take_along_axis(index, order, 1)
            self.low[k, :z] = np.sqrt(square) * (1 - SLACK)
            self.square[k] = square[:, 0]
        k = np.flatnonzero(need == 0)
        if len(k):
            again = _Bounds.full(x[k], book, self.near.shape[1])
            self.near[k], self.low[k], self.outer[k], self.square[k] = again.near, again.low, again.outer, again.square


def _state(b: pa.RecordBatch, x: np.ndarray, held: list[_Bounds]) -> pa.RecordBatch:
    near = np.stack([h.near for h in held], 1).astype(np.uint8)
    low = np.stack([_down(np.maximum(h.low, 0)) for h in held], 1)
    outer = np.stack([_down(np.maximum(h.outer, 0)) for h in held], 1)
    packed = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
    used = np.stack([h.used for h in held], 1)
    return pa.record_batch({"vec_id": b.column("vec_id"), "label": b.column("label"), "x": packed(x.astype(np.int32)), "near": packed(near), "low": packed(low), "outer": packed(outer),
                            "used": pa.array(used.max(1)), "again": pa.array((used != 1).sum(1))})


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK):
            yield whole.slice(at, CHUNK)


def _unpack(col: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), *shape)


def _start(books: np.ndarray, b: int):
    """First round: all entries of every part measured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            x = _numbers(rows.column("x"), len(books))
            yield _state(rows, x, [_Bounds.full(x[:, p], book, b) for p, book in enumerate(books)])
    return run


def _next(books: np.ndarray, moves: np.ndarray, held: int, b: int, last: bool):
    """A later round from the state of the one before; the last one gives codes and errors instead of a state."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            x = _unpack(rows.column("x"), np.int32, parts, books.shape[2]).astype(np.int64)
            near = _unpack(rows.column("near"), np.uint8, parts, held).astype(np.int64)
            low = _unpack(rows.column("low"), np.float16, parts, held).astype(np.float64)
            outer = _unpack(rows.column("outer"), np.float16, parts).astype(np.float64)
            found = [_Bounds(near[:, p], low[:, p], outer[:, p]) for p in range(parts)]
            for p, f in enumerate(found):
                f.moved(x[:, p], books[p], moves[p], b)
            if not last:
                yield _state(rows, x, found)
                continue
            code = np.stack([f.near[:, 0] for f in found], 1).astype(np.uint8)
            yield pa.record_batch({"vec_id": rows.column("vec_id"), "label": rows.column("label"), "code": pa.array([c.tobytes().hex() for c in code], pa.string()),
                                   "error": pa.array(sum(f.square for f in found), pa.int64())})
    return run


def _sums(parts: int, entries: int, width: int):
    """One task's rows per entry and their sums by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width + 1), np.int64)
        for rows in _chunks(batches):
            x = _unpack(rows.column("x"), np.int32, parts * width).astype(np.int64).reshape(-1, width)
            near = _unpack(rows.column("near"), np.uint8, parts, -1)[:, :, 0].astype(np.int64)
            slot = (near + np.arange(parts) * entries).ravel()
            total[:, 0] += np.bincount(slot, minlength=len(total))
            for j in range(width):  # at most CHUNK rows of at most LIMIT: exact in double precision
                total[:, j + 1] += np.bincount(slot, x[:, j], len(total)).astype(np.int64)
        some = np.flatnonzero(total[:, 0])
        yield pa.record_batch({"slot": pa.array(some), "total": pa.array(total[some].tolist(), pa.list_(pa.int64()))})
    return run


def _moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by floor(sum / count) of their parts; unused entries stay."""
    parts, entries, width = books.shape
    per = state.select("x", "near").mapInArrow(_sums(parts, entries, width), "slot long, total array<long>")
    rows = per.groupBy("slot").agg(*[F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(width + 1)]).collect()
    new = books.copy().reshape(parts * entries, width)
    for slot, count, *sums in rows:
        new[slot] = [s // count for s in sums]
    return new.reshape(books.shape)


def _first_books(ints: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids, as (part, entry, position)."""
    rows = ints.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    rows = [r.x for r in rows if len(r.x) == len(rows[0].x)]
    if not rows or not len(rows[0]) or len(rows[0]) % parts:
        return np.zeros((parts, 0, 0), np.int64)
    return np.array(rows, np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, start: int | None = None, least: int | None = None) -> tuple[DataFrame, np.ndarray, list[dict]]:
    """((vec_id, label, code, error), final codebooks, and for every round between the first and the last its ``b`` and how many parts were measured again).

    ``code`` has two hex digits per part, ``error`` is the sum of squared
    integer distances. ``start`` is the first list length ``b`` (default
    entries / 4), ``least`` its smallest (default entries / 8).

    Rows with a null vector, or null or non-finite components, go. The vectors
    of the smallest ids (null last; of equal ids the smaller vector) give the
    first codebooks, fewer where there are fewer rows; the first of them sets
    the length, and rows of another length, or one that ``parts`` does not
    divide, have no code and go too. Components beyond 2**26 after scaling
    stay there. Repeated rows are rows of their own. Empty in, empty out.
    """
    if not 0 < entries <= 256 or rounds < 1:
        raise ValueError("a code of two hex digits has 1 to 256 entries, which move for at least one round")
    ints = integer_vectors(vectors)
    books = _first_books(ints, parts, entries)
    kind = ints.schema["label"].dataType.simpleString()
    codes = f"vec_id long, label {kind}, code string, error long"
    if not books.size:
        return vectors.sparkSession.createDataFrame([], codes), books, []
    here = ints.where(F.size("x") == books.shape[0] * books.shape[2])
    schema = f"vec_id long, label {kind}, x binary, near binary, low binary, outer binary, used int, again long"
    b = min(start or max(1, entries // 4), books.shape[1])
    least = min(least or max(1, entries // 8), b)
    state, held, log = written(here.mapInArrow(_start(books, b), schema), "bounds"), b, []
    for left in range(rounds - 1, -1, -1):
        new = _moved_books(state, books)
        moves = np.sqrt(((new - books) ** 2).sum(2)) * (1 + SLACK)
        books, step = new, _next(new, moves, held, b, not left)
        if left:
            state = written(state.mapInArrow(step, schema), "bounds")
            used, again, n = state.agg(F.max("used"), F.sum("again"), F.count("*")).first()
            log.append({"b": b, "longest": used, "measured_again": again, "parts": n * parts})
            held, b = b, min(b, max(least, used or 0))
    return written(state.mapInArrow(step, codes), "codes"), books, log


def codebooks_sha256(books: np.ndarray) -> str:
    """Digest of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error (the error of all rows of the label, null labels together) and codebooks_sha256; see ``compress``."""
    coded, books, _ = compress(vectors, **options)
    per = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    # A label with a third of all rows is joined in SALTS places.
    per = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("label", "named")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(per, (salted["salt"] == per["salt"]) & salted["label"].eqNullSafe(per["named"])).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in SQL: all entries of every part measured in every round."""
    def assign(i: int) -> str:
        d = "list_sum(list_transform(range(1, len(v.x) + 1), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j])))"
        return f"a{i} AS MATERIALIZED (SELECT r, v.p, min({d} * {entries} + e) AS k FROM v JOIN c{i} c ON c.p = v.p GROUP BY r, v.p)"

    def move(i: int) -> str:
        return f"""
s{i} AS (SELECT p, k % {entries} AS e, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.p, a.k, unnest(v.x) AS x, unnest(range(1, len(v.x) + 1)) AS j FROM a{i} a JOIN v USING (r, p)) GROUP BY ALL),
m{i} AS (SELECT p, e, list((s - (((s % n) + n) % n)) // n ORDER BY j) AS x FROM s{i} GROUP BY p, e),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (p, e))"""
    steps = ",\n".join(f"{assign(i)},{move(i)}" for i in range(rounds)) + f",\n{assign(rounds)}"
    return f"""
WITH f AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {scale})::BIGINT) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS MATERIALIZED (SELECT r, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS x FROM f, range(0, {parts}) t(p)),
c0 AS MATERIALIZED (SELECT p, r AS e, x FROM v WHERE r < {entries}),
{steps},
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM c{rounds}),
o AS (SELECT r, string_agg(printf('%02x', k % {entries}), '' ORDER BY p) AS code, sum(k // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM f JOIN o USING (r), b"""
