"""Near duplicates: a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A document's set holds its distinct shingles of four words. Its signature is
``CHUNKS * WIDTH`` MinHash values cut to ``BITS`` bits; the distance of two
signatures is the number of values that differ. Signatures are split into
``CHUNKS`` chunks. If two differ in fewer than ``CHUNKS * (ERRORS + 1)``
values, some chunk differs in at most ``ERRORS`` of them (pigeonhole), so
entering every chunk once for each way to leave ``ERRORS`` values out finds
all pairs up to ``RADIUS``. With 12 chunks of 4 values and one error that is
23 of 48, more than five deviations above the mean for a similarity of 0.8.

Equal sets are folded first, so copies of a text are one row of a class. A
bucket never yields all its pairs. Its members are checked against its
smallest id, and confirmed pairs are joined into components. Where a bucket
holds several components, signatures within the radius tie them to a family;
a block of a bucket returns the ties of a spanning forest, not its pairs. The
families' components are then compared on the full sets, again in blocks that
return a forest: all members outside a family's largest component meet all
others, and the largest never meets itself. Whatever is linked is linked on
full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .stage import by_key, lean, written
from .words import BLANK, Words, documents, mix, pieces, segment_hash, signed

#: Words of a shingle.
SHINGLE = 4
CHUNKS, WIDTH, ERRORS, BITS = 12, 4, 1, 16
VALUES = CHUNKS * WIDTH
RADIUS = CHUNKS * (ERRORS + 1) - 1
#: Rows that are compared with as many others at once, on signatures and on full sets.
BLOCK, FULL = 1024, 256
#: Slots of the filter that thins texts before they are shuffled; its size is fixed.
SLOTS = 1 << 20

_SEEDS = np.random.default_rng(97).integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every text, sorted by row and hash.

    A text of fewer words has its whole sequence as its one shingle; a text
    without words has none.
    """
    w = Words(col, BLANK, lower=True)
    h = w.hashes()
    at = w.windows(SHINGLE)
    few = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
    start, end = np.append(at, w.first[few]), np.append(at + SHINGLE, w.first[few + 1])
    row, g = w.doc()[start], segment_hash(h, start, end)
    k = np.lexsort((g, row))
    row, g = row[k], g[k]
    new = np.ones(len(k), bool)
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    return row[new], g[new]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        row, g = shingle_sets(b.column("text"))
        n = np.bincount(row, minlength=b.num_rows)
        some = np.flatnonzero(n)
        begin = np.append(0, np.cumsum(n[some]))[:-1]
        a, c = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
        sig = np.zeros((b.num_rows, VALUES), np.uint16)
        if len(some):
            a[some] = np.add.reduceat(mix(g + np.uint64(1)), begin)
            c[some] = np.bitwise_xor.reduceat(mix(g ^ _SEEDS[0]), begin)
            for i, s in enumerate(_SEEDS):
                x = (g ^ (s >> np.uint64(7))) * s
                sig[some, i] = mix(np.minimum.reduceat(x ^ (x >> np.uint64(31)), begin)).astype(np.uint16)
        yield pa.record_batch({"doc_id": b.column("doc_id"), "n": pa.array(n, pa.int64()), "f1": signed(a), "f2": signed(c),
                               "sig": pa.array([s.tobytes() for s in sig], pa.binary())})


def _sig(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, VALUES)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key for every chunk and every value of it that may be wrong."""
    for b in batches:
        sig = _sig(b.column("sig")).astype(np.uint64).reshape(-1, CHUNKS, WIDTH)
        out = np.zeros((len(sig), CHUNKS, WIDTH), np.uint64)
        for wrong in range(WIDTH):
            x = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(wrong)
            x = np.broadcast_to(mix(x + np.uint64(1)), (len(sig), CHUNKS))
            for j in range(WIDTH):
                if j != wrong:
                    x = mix(x ^ (sig[:, :, j] + np.uint64(j << BITS)))
            out[:, :, wrong] = x
        ids = np.repeat(b.column("id").to_numpy(), CHUNKS * WIDTH)
        for at in range(0, len(ids), 100_000):
            yield pa.record_batch({"key": signed(out.reshape(-1)[at:at + 100_000]), "id": pa.array(ids[at:at + 100_000])})


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures are within the radius."""
    for b in batches:
        keep = (_sig(b.column("sig_a")) != _sig(b.column("sig_b"))).sum(1) <= RADIUS
        yield b.select(["a", "b"]).filter(pa.array(keep))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text_a"):
            ra, ga = shingle_sets(b.column("text_a"))
            rb, gb = shingle_sets(b.column("text_b"))
            na, nb = np.bincount(ra, minlength=b.num_rows), np.bincount(rb, minlength=b.num_rows)
            row, g = np.append(ra, rb), np.append(ga, gb)
            k = np.lexsort((g, row))
            row, g = row[k], g[k]
            both = np.bincount(row[1:][(row[1:] == row[:-1]) & (g[1:] == g[:-1])], minlength=b.num_rows)
            yield b.select(["a", "b"]).filter(pa.array(100 * both >= percent * (na + nb - both)))
    return run


def _thinned(texts: DataFrame, used: DataFrame) -> DataFrame:
    """Texts whose ids may be among those ``used`` (a column id).

    The others stay out of the shuffle as far as a filter of fixed size can
    tell: it has ``SLOTS`` rows at most, whatever the input.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).alias("slot")
    return texts.withColumn("slot", slot("doc_id")).join(F.broadcast(used.select(slot("id")).distinct()), "slot", "left_semi").select("doc_id", "text")


def _linked(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of representatives that are confirmed on their full texts."""
    mine = _thinned(texts, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    left = pairs.join(mine.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(mine.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(lean(_confirm(percent)), "a long, b long").distinct(), "links")


class _Forest:
    """Union-find over component ids; remembers the edges that joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def tie(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.edges.append((x, y))
        return True

    def batch(self) -> pa.RecordBatch:
        return pa.record_batch([pa.array([e[i] for e in self.edges], pa.int64()) for i in (0, 1)], names=["src", "dst"])


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components with signatures within the radius of each other, block by block of a bucket: a spanning forest."""
    for t in by_key(batches, ["key", "i", "j"]):
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        comp, n, block = (t.column(c).to_numpy() for c in ("component", "n", "block"))
        sig = _sig(t.column("sig").combine_chunks())
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
        forest, root = _Forest(), comp.copy()
        for x in first:
            y = second[root[second] != root[x]]
            y = y[5 * np.minimum(n[y], n[x]) >= 4 * np.maximum(n[y], n[x])]
            y = y[(sig[y] != sig[x]).sum(1) <= RADIUS]
            if len(y):
                for c in np.unique(comp[y]).tolist():
                    forest.tie(c, int(comp[x]))
                names, back = np.unique(comp, return_inverse=True)
                root = np.array([forest.root(c) for c in names.tolist()])[back]
        if forest.edges:
            yield forest.batch()


def _full(percent: int):
    """Components linked by members of two blocks of a family, on their full sets: a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, ["family", "i", "j"]):
            comp, side = t.column("component").to_numpy(), t.column("side").to_numpy()
            row, g = shingle_sets(t.column("text").combine_chunks())
            n = np.bincount(row, minlength=t.num_rows)
            _, col, df = np.unique(g, return_inverse=True, return_counts=True)
            often = df > 1  # a shingle of one member is in no intersection
            place = np.cumsum(often) - 1
            keep = often[col]
            row, col = row[keep], place[col[keep]]
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(right):  # a block with itself
                right = left
            both = np.zeros((len(left), len(right)), np.float32)
            order = np.argsort(col, kind="stable")
            row, col = row[order], col[order]
            for at in range(0, int(often.sum()), 4096):
                lo, hi = np.searchsorted(col, [at, at + 4096])
                m = np.zeros((t.num_rows, 4096), np.float32)
                m[row[lo:hi], col[lo:hi] - at] = 1
                both += m[left] @ m[right].T
            union = n[left][:, None] + n[right][None, :] - both
            linked = (100 * both.astype(np.float64) >= percent * union) & (comp[left][:, None] != comp[right][None, :])
            forest = _Forest()
            for x, y in set(zip(*(comp[k[v]].tolist() for k, v in zip((left, right), np.nonzero(linked))))):
                forest.tie(x, y)
            if forest.edges:
                yield forest.batch()
    return run


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept.

    Documents are linked where 100 * intersection >= ``percent`` * union of
    their shingle sets (words between white space, A-Z lower-cased);
    component_id is the smallest doc_id that links reach. Null, empty and
    wordless texts are linked with nothing. Rows without doc_id take no part
    and are kept; rows that repeat an id and its text get the same result.
    ``percent`` must be 80 or more, as the radius is made for it.
    """
    if percent < 80:
        raise ValueError("the radius of the signatures is made for 80 per cent or more")
    base = documents(docs)
    sets = written(base.mapInArrow(lean(_signatures), "doc_id long, n long, f1 long, f2 long, sig binary"), "sets")
    # min() of the signature is that of any member: equal sets have equal signatures
    classes = written(sets.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(
        F.min("doc_id").alias("id"), F.min("sig").alias("sig")), "classes")
    reps = classes.select("id", "n", "sig")
    keys = reps.select("id", "sig").mapInArrow(_keys, "key long, id long")
    hubs = written(keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1"), "hubs")
    shared = written(keys.join(hubs, "key").select("key", "id", "hub", "members"), "shared")
    stars = written(shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    close = stars.join(side("a"), "a").join(side("b"), "b").where(
        F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))
    texts = base.where("doc_id is not null and text is not null")
    links = _linked(texts, written(close.select("a", "b", "sig_a", "sig_b").mapInArrow(_near, "a long, b long"), "close"), percent)

    members = written(shared.select("id").distinct(), "members")
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    first = components(members, edges)
    placed = shared.join(first, "id")
    mixed = written(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
                    .where("lo < hi").withColumn("blocks", F.ceil(F.col("size") / BLOCK)).select("key", "blocks"), "mixed")
    rows = placed.select("key", "id", "component").join(mixed, "key").join(reps, "id")
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "component", "n", "sig")
    ties = written(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_ties, "src long, dst long").distinct(), "ties")

    parts = ties.select(F.col("src").alias("id")).union(ties.select("dst")).distinct()
    families = components(parts, ties).select(F.col("id").alias("component"), F.col("component").alias("family"))
    inside = written(first.join(families, "component"), "families")
    main = inside.groupBy("family", "component").agg(F.count("*").alias("k")).groupBy("family").agg(
        F.max_by("component", F.struct("k", "component")).alias("main"), F.max("k").alias("in_main"), F.sum("k").alias("k"))
    main = written(main.select("family", "main", F.ceil(F.col("in_main") / FULL).alias("mains"), F.ceil((F.col("k") - F.col("in_main")) / FULL).alias("others")), "mains")
    member = _thinned(texts, inside.select("id")).join(inside.join(main, "family"), F.col("doc_id") == F.col("id"))
    is_main, span = F.col("component") == F.col("main"), lambda k: F.sequence(F.lit(0).cast("long"), k - 1)
    mine = F.pmod(F.xxhash64("id"), F.when(is_main, F.col("mains")).otherwise(F.col("others")))
    # (i, j): block i of the others with block j of the others, or with block -1 - j of the largest component
    as_main = F.transform(span(F.col("others")), lambda i: F.struct(i.alias("i"), (-1 - F.col("mine")).alias("j"), F.lit(1).alias("side")))
    with_main = F.transform(span(F.col("mains")), lambda j: F.struct(F.col("mine").alias("i"), (-1 - j).alias("j"), F.lit(0).alias("side")))
    with_others = F.transform(span(F.col("others")), lambda j: F.struct(
        F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j"), (F.col("mine") > j).cast("int").alias("side")))
    meets = member.withColumn("mine", mine).withColumn("m", F.explode(F.when(is_main, as_main).otherwise(F.concat(with_main, with_others)))).select(
        "family", "m.i", "m.j", "m.side", "component", "text")
    joined = written(meets.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(lean(_full(percent)), "src long, dst long").distinct(), "joined")
    last = components(first.select(F.col("component").alias("id")).distinct(), joined)
    final = first.select("id", F.col("component").alias("c")).join(last.select(F.col("id").alias("c"), "component"), "c").select("id", "component")
    named = written(classes.select("f1", "f2", "n", "id").join(final, "id", "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("component")), "named")
    out = sets.select("doc_id", "f1", "f2", "n").join(named, ["f1", "f2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
