"""Jaccard join of shingle sets: signature trees, met in pairs from the top down.

A leaf of a tree is a document: a bitmap with one bit for the hash of each of
its shingles, and its set size. A node combines the bitmaps of its children by
OR and their sizes to a range. Two nodes are met together: a pair below them
shares at most the bits common to both bitmaps, and for each side no more
shingles beyond that than had to share a bit, so where that overlap is too
small for the sizes, or the ranges are too far apart, the whole pair of nodes
goes. Pairs of one component go too: only components are asked for.

Where the trees stand. Linked sets share a shingle of their rarest few (prefix
filter), so every shared one has a tree of the documents that hold it there;
groups with the same documents are one tree. Here the bitmap is a sketch of
about a bit for a shingle, and what survives is a possible link. A spanning
forest of these is confirmed on full texts. Families whose forest failed in
part are met once more, now in trees whose bitmaps have a bit for each shingle
that two of the documents share: there the overlap of two leaves is exact.

A tree of very many documents is dealt in blocks. Each holds the tree's
smallest id, which ties most blocks together; only trees that are still in
several components then meet block by block. No step returns all pairs of a
group, and no link is lost: every bound holds for all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .hamming_join import _Forest, _linked, _thinned, shingle_sets
from .stage import by_key, written
from .words import documents, mix, pieces, signed

PERCENT = 85
#: Children of a node, and pairs of nodes that are expanded at once.
FAN, PAIRS = 8, 256
#: Documents of a block of a tree; documents and shingles of a block of a family.
BLOCK, FULL, FULL_SHINGLES = 512, 512, 1 << 17
#: Bits of the narrowest and the widest sketch.
NARROW, WIDE = 64, 1 << 15
#: Slots in which tasks count shingles to tell frequent ones. It sets the order of the prefix, never the result.
SLOTS = 1 << 20


class Tree:
    """Levels of nodes over documents in the given order: OR of bitmaps, size range, most shingles that share a bit, component range."""

    def __init__(self, rows: np.ndarray, bits: np.ndarray, n: np.ndarray, excess: np.ndarray):
        self.rows = rows
        self.bits, self.low, self.high, self.excess = [bits], [n], [n], [excess]
        while len(self.bits[-1]) > FAN:
            at = np.arange(0, len(self.bits[-1]), FAN)
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], at, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], at))
            self.high.append(np.maximum.reduceat(self.high[-1], at))
            self.excess.append(np.maximum.reduceat(self.excess[-1], at))

    def colour(self, root: np.ndarray) -> None:
        """Smallest and largest component below every node."""
        self.first, self.last = [root[self.rows]], [root[self.rows]]
        for _ in self.bits[1:]:
            at = np.arange(0, len(self.first[-1]), FAN)
            self.first.append(np.minimum.reduceat(self.first[-1], at))
            self.last.append(np.maximum.reduceat(self.last[-1], at))

    def below(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of nodes of a level, and how many each has."""
        begin = node * FAN
        count = np.minimum(begin + FAN, len(self.bits[level - 1])) - begin
        return begin, count


class Meeting:
    """Spanning forest over components of the document pairs whose overlap can reach the similarity."""

    def __init__(self, component: np.ndarray, percent: int):
        self.component, self.percent = component, percent
        self.forest = _Forest()
        self.root = component.copy()

    def _recolour(self, *trees: Tree) -> None:
        names, back = np.unique(self.component, return_inverse=True)
        self.root = np.array([self.forest.root(c) for c in names.tolist()], np.int64)[back]
        for t in trees:
            t.colour(self.root)

    def _keep(self, a: Tree, b: Tree, level: tuple[int, int], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs of nodes that may hold a link between two components."""
        i, j = level
        apart = (a.first[i][x] != b.last[j][y]) | (a.last[i][x] != b.first[j][y])
        sizes = 100 * np.minimum(a.high[i][x], b.high[j][y]) >= self.percent * np.maximum(a.low[i][x], b.low[j][y])
        k = np.flatnonzero(apart & sizes)
        x, y = x[k], y[k]
        step = max(1, (1 << 21) // max(1, a.bits[i].shape[1]))
        common = np.concatenate([np.bitwise_count(a.bits[i][x[s:s + step]] & b.bits[j][y[s:s + step]]).sum(1, dtype=np.int64) for s in range(0, len(x), step)] or [np.zeros(0, np.int64)])
        most = np.minimum(common + np.minimum(a.excess[i][x], b.excess[j][y]), np.minimum(a.high[i][x], b.high[j][y]))
        return k[(100 + self.percent) * most >= self.percent * (a.low[i][x] + b.low[j][y])]

    def meet(self, a: Tree, b: Tree) -> None:
        """All pairs of a document of ``a`` and one of ``b``; pairs inside one tree where they are the same."""
        self._recolour(a, b)
        tops = len(a.bits) - 1, len(b.bits) - 1
        x, y = (g.ravel() for g in np.meshgrid(np.arange(len(a.bits[-1])), np.arange(len(b.bits[-1])), indexing="ij"))
        todo = [(tops, x, y)]
        while todo:
            level, x, y = todo.pop()
            if len(x) > PAIRS and level != (0, 0):
                todo.append((level, x[PAIRS:], y[PAIRS:]))
                x, y = x[:PAIRS], y[:PAIRS]
            if a is b:
                x, y = x[x <= y], y[x <= y]
            k = self._keep(a, b, level, x, y)
            x, y = x[k], y[k]
            if level == (0, 0):
                self._tie(a, b, x, y)
            elif len(x):
                # the taller side is opened, both where they are level
                i, j = level
                open_a, open_b = i >= j, j >= i
                bx, cx = a.below(i, x) if open_a else (x, np.ones_like(x))
                by, cy = b.below(j, y) if open_b else (y, np.ones_like(y))
                pair = np.repeat(np.arange(len(x)), cx * cy)
                place = np.arange(len(pair)) - np.repeat(np.cumsum(cx * cy) - cx * cy, cx * cy)
                todo.append(((i - open_a, j - open_b), bx[pair] + place // cy[pair], by[pair] + place % cy[pair]))

    def _tie(self, a: Tree, b: Tree, x: np.ndarray, y: np.ndarray) -> None:
        new = False
        left, right = a.rows[x], b.rows[y]
        while len(left):
            for p, q in zip(self.component[left[:PAIRS]].tolist(), self.component[right[:PAIRS]].tolist()):
                new |= self.forest.tie(p, q)
            left, right = left[PAIRS:], right[PAIRS:]
            if new:
                self._recolour(a, b)
                new, k = False, self.root[left] != self.root[right]
                left, right = left[k], right[k]


def prefix_length(n, percent: int):
    """How many of its rarest shingles a set of ``n`` must be found by."""
    return n - (percent * n + 99) // 100 + 1


def width(n: int) -> int:
    """Bits of the sketch of a set of ``n``: about one a shingle, a power of two."""
    return min(max(NARROW, 1 << max(0, n - 1).bit_length()), WIDE)


def _bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    flags = np.zeros(bits, np.uint8)
    flags[hashes & np.uint64(bits - 1)] = 1
    return np.packbits(flags, bitorder="little")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots that hold a frequent shingle of this task's rows: in one of 1,024 documents or more."""
    total, rows = np.zeros(SLOTS, np.int64), 0
    for b in pieces(batches, "text"):
        _, g = shingle_sets(b.column("text"))
        total += np.bincount((g >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
        rows += b.num_rows
    often = np.flatnonzero(total >= max(8, rows / 1024))
    yield pa.record_batch({"slot": pa.array(often), "k": pa.array(total[often])})


def _index(often: dict[int, int], percent: int):
    """Per document: set size, fingerprints, the hashes of its rarest shingles, its sketch, and its smallest hash."""
    slots = np.array(sorted(often), np.int64)
    known = np.array([often[s] for s in sorted(often)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            row, g = shingle_sets(b.column("text"))
            n = np.bincount(row, minlength=b.num_rows)
            ends = np.cumsum(n)
            slot = (g >> np.uint64(44)).astype(np.int64)
            at = np.minimum(np.searchsorted(slots, slot), max(0, len(slots) - 1))
            rank = np.where(slots[at] == slot, known[at], 0) if len(slots) else np.zeros(len(g), np.int64)
            order = np.lexsort((g, rank, row))
            by_rank = g[order]
            f1, f2, low = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
            some = np.flatnonzero(n)
            if len(some):
                f1[some] = np.add.reduceat(mix(g + np.uint64(1)), ends[some] - n[some])
                f2[some] = np.bitwise_xor.reduceat(mix(g ^ np.uint64(0x5851F42D4C957F2D)), ends[some] - n[some])
                low[some] = g[ends[some] - n[some]]
            keys = [by_rank[e - k:e - k + prefix_length(k, percent)].tobytes() if k else b"" for e, k in zip(ends.tolist(), n.tolist())]
            sketch = [_bitmap(g[e - k:e], width(k)).tobytes() if k else b"" for e, k in zip(ends.tolist(), n.tolist())]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n": pa.array(n, pa.int64()), "f1": signed(f1), "f2": signed(f2), "low": signed(low),
                                   "keys": pa.array(keys, pa.binary()), "bits": pa.array(sketch, pa.binary())})
    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "keys"):
        held = b.column("keys").to_pylist()
        ids = np.repeat(b.column("id").to_numpy(), [len(k) // 8 for k in held])
        yield pa.record_batch({"key": pa.array(np.frombuffer(b"".join(held), np.int64)), "id": pa.array(ids)})


def _folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


class _Sketches:
    """Trees over some rows' sketches by width; sets of different widths meet at the narrower one."""

    def __init__(self, rows: np.ndarray, n: np.ndarray, sketch: list[bytes]):
        size = np.array([len(sketch[r]) for r in rows.tolist()])
        self.at = {int(w): rows[size == w] for w in np.unique(size)}
        self.n = n
        self.bits = {w: np.frombuffer(b"".join(sketch[r] for r in k.tolist()), np.uint64).reshape(len(k), -1) for w, k in self.at.items()}

    def _tree(self, rows: np.ndarray, bits: np.ndarray) -> Tree:
        n = self.n[rows]
        return Tree(rows, bits, n, n - np.bitwise_count(bits).sum(1, dtype=np.int64))

    def own(self, w: int) -> Tree | None:
        return self._tree(self.at[w], self.bits[w]) if w in self.at else None

    def wider(self, w: int) -> Tree | None:
        """Sets of twice the width, at this width."""
        return self._tree(self.at[2 * w], _folded(self.bits[2 * w])) if 2 * w in self.at else None


def _inside(percent: int):
    """Possible links inside every (key, block): pairs of documents, a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, ["key", "block"]):
            ids, n, sketch = t.column("id").to_numpy(), t.column("n").to_numpy(), t.column("bits").to_pylist()
            trees = _Sketches(np.arange(len(ids)), n, sketch)
            met = Meeting(ids, percent)
            for w in trees.at:
                mine, wider = trees.own(w), trees.wider(w)
                met.meet(mine, mine)
                if wider is not None:
                    met.meet(mine, wider)
            if met.forest.edges:
                yield met.forest.batch()
    return run


def _across(percent: int):
    """Possible links between the components of two blocks of a key: a spanning forest over components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, ["key", "i", "j"]):
            n, sketch, side = t.column("n").to_numpy(), t.column("bits").to_pylist(), t.column("side").to_numpy()
            left, right = (_Sketches(np.flatnonzero(side == s), n, sketch) for s in (0, 1))
            met = Meeting(t.column("component").to_numpy(), percent)
            for w in sorted({*left.at, *right.at}):
                for a, b in ((left.own(w), right.own(w)), (left.own(w), right.wider(w)), (left.wider(w), right.own(w))):
                    if a is not None and b is not None:
                        met.meet(a, b)
            if met.forest.edges:
                yield met.forest.batch()
    return run


def _exact(percent: int):
    """Links between components of two blocks of a family, on bitmaps with a bit for each shingle that two documents share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, ["family", "i", "j"]):
            side = t.column("side").to_numpy()
            row, g = shingle_sets(t.column("text").combine_chunks())
            n = np.bincount(row, minlength=t.num_rows)
            _, col, df = np.unique(g, return_inverse=True, return_counts=True)
            place = np.cumsum(df > 1) - 1
            row, col = row[df[col] > 1], place[col[df[col] > 1]]
            words = max(1, -(-int((df > 1).sum()) // 64))
            bits = np.zeros((t.num_rows, words), np.uint64)
            np.bitwise_or.at(bits, (row, col // 64), np.uint64(1) << (col % 64).astype(np.uint64))
            tree = lambda k: Tree(k, bits[k], n[k], np.zeros(len(k), np.int64))  # noqa: E731, B023
            met = Meeting(t.column("component").to_numpy(), percent)
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left):
                continue
            a = tree(left)
            met.meet(a, tree(right) if len(right) else a)
            if met.forest.edges:
                yield met.forest.batch()
    return run


def _span(k: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), k - 1)


def _families(first: DataFrame, ties: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between the components of every family, on full sets: (src, dst) of a spanning forest.

    A family is what possible links join. Its largest component never meets
    itself; documents of the others meet all, in blocks of bounded size.
    """
    parts = ties.select(F.col("src").alias("id")).union(ties.select("dst")).distinct()
    families = components(parts, ties).select(F.col("id").alias("component"), F.col("component").alias("family"))
    inside = written(first.join(families, "component").join(classes.select("id", "n"), "id").select("family", "component", "id", "n"), "tree-families")
    size = inside.groupBy("family", "component").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    main = size.groupBy("family").agg(F.max(F.struct("k", "s", "component")).alias("m"), F.sum("k").alias("k"), F.sum("s").alias("s"))
    blocks = lambda k, s: F.ceil(F.greatest(k / FULL, s / FULL_SHINGLES))
    main = written(main.select("family", F.col("m.component").alias("main"), blocks(F.col("m.k"), F.col("m.s")).alias("mains"),
                               blocks(F.col("k") - F.col("m.k"), F.col("s") - F.col("m.s")).alias("others")), "tree-mains")
    member = _thinned(texts, inside.select("id")).join(inside.join(main, "family"), F.col("doc_id") == F.col("id"))
    is_main = F.col("component") == F.col("main")
    mine = F.pmod(F.xxhash64("id"), F.when(is_main, F.col("mains")).otherwise(F.col("others")))
    as_main = F.transform(_span(F.col("others")), lambda i: F.struct(i.alias("i"), (-1 - F.col("mine")).alias("j"), F.lit(1).alias("side")))
    with_main = F.transform(_span(F.col("mains")), lambda j: F.struct(F.col("mine").alias("i"), (-1 - j).alias("j"), F.lit(0).alias("side")))
    with_others = F.transform(_span(F.col("others")), lambda j: F.struct(
        F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j"), (F.col("mine") > j).cast("int").alias("side")))
    meets = member.withColumn("mine", mine).withColumn("m", F.explode(F.when(is_main, as_main).otherwise(F.concat(with_main, with_others)))).select(
        "family", "m.i", "m.j", "m.side", "component", "id", "text")
    dealt = meets.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "id")
    return written(dealt.mapInArrow(_exact(percent), "src long, dst long").distinct(), "tree-joined")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id.

    Documents link where 100 * intersection >= ``percent`` * union of their
    sets of four-word shingles (words between white space, A-Z lower-cased; a
    text of fewer words is one shingle). component_id is the smallest doc_id
    that links reach. Null, empty and wordless texts link with nothing. Rows
    without doc_id take no part and have no component; rows that repeat an id
    and its text get the same result. ``percent`` must be above 50, as sketches
    of neighbouring widths are all that meet.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    base = documents(docs)
    # at most SLOTS rows, whatever the input
    often = {r.slot: r.k for r in base.mapInArrow(_counts, "slot long, k long").groupBy("slot").agg(F.sum("k").alias("k")).collect()}
    sets = written(base.mapInArrow(_index(often, percent), "doc_id long, n long, f1 long, f2 long, low long, keys binary, bits binary"), "tree-sets")
    # equal sets have equal keys and sketches
    classes = written(sets.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(
        F.min("doc_id").alias("id"), F.min("low").alias("low"), F.min("keys").alias("keys"), F.min("bits").alias("bits")), "tree-classes")
    keys = classes.select("id", "keys").mapInArrow(_keys, "key long, id long")
    same = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("hub"), F.bit_xor(F.xxhash64("id")).alias("x1"),
                                   F.bit_xor(F.xxhash64(F.lit(5), "id")).alias("x2")).where("members > 1")
    groups = written(same.groupBy("members", "hub", "x1", "x2").agg(F.min("key").alias("key")).select(
        "key", "hub", F.ceil(F.col("members") / BLOCK).alias("blocks")), "tree-groups")
    shared = written(keys.join(groups, "key").join(classes.select("id", "n", "low", "bits"), "id").select("key", "id", "hub", "blocks", "n", "low", "bits"), "tree-shared")
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    here = F.when(F.col("id") == F.col("hub"), _span(F.col("blocks"))).otherwise(F.array(block))
    dealt = shared.withColumn("block", F.explode(here)).select("key", "block", "id", "n", "low", "bits").repartition("key", "block")
    ties = written(dealt.sortWithinPartitions("key", "block", "low", "id").mapInArrow(_inside(percent), "src long, dst long").distinct(), "tree-ties")
    texts = base.where("doc_id is not null and text is not null")
    links = _linked(texts, ties.select(F.col("src").alias("a"), F.col("dst").alias("b")), percent)
    first = components(shared.select("id").distinct(), links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    # trees in several blocks that are still in several components
    hot = shared.where("blocks > 1").join(first, "id")
    mixed = hot.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    other = F.explode(F.filter(_span(F.col("blocks")), lambda j: j != F.col("block")))
    pairs = hot.join(mixed, "key", "left_semi").withColumn("block", block).withColumn("other", other).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"),
        "component", "n", "low", "bits")
    across = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "low", "component").mapInArrow(_across(percent), "src long, dst long")
    name = lambda c: first.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
    failed = ties.join(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), ["src", "dst"], "left_anti").join(name("src"), "src").join(name("dst"), "dst")
    open_ties = written(failed.select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).where("src <> dst").union(across).distinct(), "tree-open")
    joined = _families(first, open_ties, classes, texts, percent)
    last = components(first.select(F.col("component").alias("id")).distinct(), joined).select(F.col("id").alias("c"), "component")
    final = first.select("id", F.col("component").alias("c")).join(last, "c").select("id", "component")
    named = written(classes.select("f1", "f2", "n", "id").join(final, "id", "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("component")), "tree-named")
    out = sets.select("doc_id", "f1", "f2", "n").join(named, ["f1", "f2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
