"""Benchmark items found in documents: a prefix-filtered set join on word shingles.

An item's windows are its runs of ``size`` words (the whole item, if shorter).
A document contains a window only if it contains all its shingles, so of each
window's shingles, ordered by how rare they are in the corpus, a prefix of one
is necessary: the rarest. Documents are joined on these prefix shingles alone;
the shingle's place in the window then bounds where the window can lie
(position and length), and the words there are verified.

The items are the stated query set. They are dealt into blocks of at most
``BLOCK`` (window, item) rows, so what is sent to the executors is bounded
however large the benchmark is; documents are read once per pass and never
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import lean, written
from .words import ALNUM, Words, pieces, segment_hash, signed

#: Words of a shingle.
SHINGLE = 2
#: (window, item) rows of a block; 32 bytes each.
BLOCK = 200_000


def _item_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w = Words(b.column("text"), ALNUM, lower=True)
            h = w.hashes()
            full = np.maximum(w.count - size + 1, np.minimum(w.count, 1))
            row = np.repeat(np.arange(len(full)), full)
            at = w.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
            n = np.minimum(size, w.count[row])
            k = np.minimum(SHINGLE, n)
            m = n - k + 1
            s = np.repeat(at, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            grams = segment_hash(h, s, s + np.repeat(k, m)).view(np.int64)
            yield pa.record_batch({"item": b.column("item").take(pa.array(row)), "window": signed(segment_hash(h, at, at + n)), "n": pa.array(n),
                                   "grams": pa.ListArray.from_arrays(np.append(0, np.cumsum(m)).astype(np.int32), pa.array(grams))})
    return run


def _grams(h: np.ndarray, w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = w.windows(k)
    return at, segment_hash(h, at, at + k)


def _count(wanted: dict[int, np.ndarray]):
    """How often the wanted shingles (sorted hashes, by their number of words) occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(v), np.int64) for k, v in wanted.items()}
        for b in pieces(batches, "text"):
            w = Words(b.column("text"), ALNUM, lower=True)
            h = w.hashes()
            for k, known in wanted.items():
                g = _grams(h, w, k)[1].view(np.int64)
                at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                total[k] += np.bincount(at[known[at] == g], minlength=len(known))
        for k, known in wanted.items():
            seen = total[k] > 0
            yield pa.record_batch({"gram": pa.array(known[seen]), "n": pa.array(total[k][seen])})
    return run


def _scan(index: dict[int, tuple], schema):
    """Adds the hits of one block to the bit mask and the item list of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w = Words(b.column("text"), ALNUM, lower=True)
            h, doc = w.hashes(), None
            marks, rows, items = [], [], []
            for k, (gram, offset, n, window, item) in index.items():
                at, g = _grams(h, w, k)
                g = g.view(np.int64)
                lo, hi = np.searchsorted(gram, g, "left"), np.searchsorted(gram, g, "right")
                hit = np.flatnonzero(hi > lo)
                many = (hi - lo)[hit]
                c = np.repeat(lo[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                s = np.repeat(at[hit], many) - offset[c]
                if doc is None:
                    doc = w.doc()
                home = doc[np.repeat(at[hit], many)]
                inside = (s >= w.first[home]) & (s + n[c] <= w.first[home + 1])
                c, s, home = c[inside], s[inside], home[inside]
                same = segment_hash(h, s, s + n[c]).view(np.int64) == window[c]
                c, s, home = c[same], s[same], home[same]
                marks.append((s, n[c]))
                rows.append(home)
                items.append(item[c])
            cover = np.zeros(len(h) + 1, np.int64)
            for s, n in marks:
                np.add.at(cover, s, 1)
                np.add.at(cover, s + n, -1)
            cover = np.cumsum(cover[:-1]) > 0
            rows, items = np.concatenate(rows), np.concatenate(items)
            found: dict[int, set] = {}
            for r, i in set(zip(rows.tolist(), items.tolist())):
                found.setdefault(r, set()).add(i)
            old_mask, old_items = b.column("__mask").to_pylist(), b.column("__items").to_pylist()
            mask, names = [], []
            for i in range(b.num_rows):
                mine = old_mask[i]
                if i in found:
                    bits = np.packbits(cover[w.first[i]:w.first[i + 1]])
                    mine = (bits if mine is None else bits | np.frombuffer(mine, np.uint8)).tobytes()
                mask.append(mine)
                names.append(sorted({*(old_items[i] or ()), *found.get(i, ())}))
            new = {"__n_words": pa.array(w.count, pa.int64()), "__mask": pa.array(mask, pa.binary()), "__items": pa.array(names, pa.list_(pa.string()))}
            yield pa.record_batch([new.get(f.name, b.column(i) if f.name not in new else None) for i, f in enumerate(b.schema)], names=b.schema.names)
    return run


def _blocks(docs: DataFrame, items: DataFrame, size: int):
    """Indexes of the windows, block by block: rarest shingle, its place, words, window hash, item; and whether it is the last."""
    flat = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")
    windows = flat.mapInArrow(_item_windows(size), "item string, window long, n long, grams array<long>").distinct()
    total = windows.count()
    n = -(-total // BLOCK)
    for i in range(n):
        rows = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(n)) == i).collect()
        by_k: dict[int, list] = {}
        for r in rows:
            by_k.setdefault(min(SHINGLE, r.n), []).append(r)
        wanted = {k: np.unique(np.array([g for r in v for g in r.grams], np.int64)) for k, v in by_k.items()}
        seen = dict(docs.select("text").mapInArrow(_count(wanted), "gram long, n long").groupBy("gram").agg(F.sum("n")).collect())
        index = {}
        for k, v in by_k.items():
            head = [min((seen.get(g, 0), g, o) for o, g in enumerate(r.grams)) for r in v]
            order = np.argsort(np.array([g for _, g, _ in head], np.int64), kind="stable")
            index[k] = tuple(np.array(x, kind)[order] for x, kind in (
                ([g for _, g, _ in head], np.int64), ([o for _, _, o in head], np.int64), ([r.n for r in v], np.int64),
                ([r.window for r in v], np.int64), ([r.item for r in v], object)))
        yield index, i + 1 == n


def with_leaks(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` with ``__n_words``, ``__mask`` (a bit per word that is hit; null: none) and ``__items`` (ids whose windows occur).

    Null and empty texts have no words. Items without id or without words have
    no windows; an item whose id or text repeats counts once for each id. With
    an empty benchmark nothing is hit. Columns of ``docs`` pass through.
    """
    wide = docs.withColumn("__n_words", F.lit(0).cast("long")).withColumn("__mask", F.lit(None).cast("binary")).withColumn(
        "__items", F.array().cast("array<string>"))
    none = {k: tuple(np.zeros(0, np.int64) for _ in range(5)) for k in (1,)}
    out, last = wide, False
    for index, last in _blocks(docs, items, size):
        out = out.mapInArrow(lean(_scan(index, wide.schema)), wide.schema)
        if not last:
            out = written(out, "leaks")  # so that the driver holds one block at a time
    return out if last else out.mapInArrow(_scan(none, wide.schema), wide.schema)


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_leaks(narrow, items, size).select(
        "doc_id", F.col("__n_words").alias("n_words"),
        # bits of the mask, counted as the ones of its binary digits
        F.coalesce(F.length(F.translate(F.expr("array_join(transform(sequence(1, octet_length(__mask)), i -> bin(conv(hex(substring(__mask, i, 1)), 16, 10))), '')"), "0", "")), F.lit(0)).cast("long").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"),
        F.col("__mask").isNotNull().alias("contaminated"))
