"""Best-two-fit packing of token sequences.

Only the lengths decide a packing, and there are at most ``capacity`` of them,
so the packing is planned on their histogram: a bin is filled greedily with
the longest pieces that still fit; then its smallest piece is exchanged for
two unpacked ones if a pair fills the widened gap more tightly. The same bin
is repeated as often as its lengths last. The plan is a few thousand rows
whatever the corpus holds; pieces find their places by their rank among the
pieces of the same length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import lean, written
from .token_ids import encoder
from .words import documents, pieces

#: Parts each length is ranked in, so that a common length is not one task.
PARTS = 128


def _emit(path: str, end: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, stop = encoder(path), np.uint32(end)
        for b in pieces(batches, "text"):
            ids, count = enc.encode(b.column("text").fill_null("").to_pylist())
            row, piece, start, length, crc, body = [], [], [], [], [], []
            for r, x in enumerate(np.split(ids, np.cumsum(count)[:-1])):
                x = np.append(x, stop).astype("<u4")
                at = 0
                for k in range(-(-len(x) // capacity)):
                    to = at + capacity if k else (len(x) - 1) % capacity + 1
                    row.append(r)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    raw = x[at:to].tobytes()
                    crc.append(zlib.crc32(raw))
                    body.append(raw)
                    at = to
            out = {"doc_id": b.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                   "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.record_batch(out | ({"ids": pa.array(body, pa.binary())} if with_ids else {}))
    return run


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths in order, how many such bins), longest pieces first."""
    size = np.array(sorted(k for k, v in histogram.items() if v), np.int64)
    left = np.array([histogram[int(k)] for k in size], np.int64)
    bins = []
    while len(size):
        items: Counter[int] = Counter()
        gap = capacity
        while True:
            j = int(np.searchsorted(size, gap, "right")) - 1
            while j >= 0 and left[j] <= items[j]:
                j -= 1
            if j < 0:
                break
            n = min(int(left[j]) - items[j], gap // int(size[j]))
            items[j] += n
            gap -= n * int(size[j])
        least = min(items)
        room = gap + int(size[least])
        if gap and sum(items.values()) > 1:
            items[least] -= 1
            free = left - np.array([items[j] for j in range(len(size))])
            a = np.flatnonzero((free > 0) & (size < room))
            b = np.searchsorted(size, room - size[a], "right") - 1
            best, pair = int(size[least]), None
            # the partner is the longest that fits and is still there; equal lengths need two
            have = np.where(free > 0, np.arange(len(size)), -1)
            last, last_two = np.maximum.accumulate(have), free >= 2
            for i, j in zip(a.tolist(), np.where(b >= 0, last[np.maximum(b, 0)], -1).tolist()):
                if j == i and not last_two[i]:
                    j = int(last[i - 1]) if i else -1
                if j >= 0 and size[i] + size[j] > best:
                    best, pair = int(size[i] + size[j]), (i, j)
                    if best == room:
                        break
            if pair:
                items.update(pair)
            else:
                items[least] += 1
        items = +items
        copies = min(int(left[j]) // n for j, n in items.items())
        bins.append(([int(size[j]) for j in sorted(items, reverse=True) for _ in range(items[j])], copies))
        for j, n in items.items():
            left[j] -= n * copies
        some = left > 0
        size, left = size[some], left[some]
    return bins


def _slots(bins: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of ranks: first rank, first sequence and offset of the run."""
    out: dict[int, list] = {}
    used: Counter[int] = Counter()
    first = 0
    for items, copies in bins:
        at = 0
        for n in items:
            out.setdefault(n, []).append((used[n], first, at))
            used[n] += copies
            at += n
        first += copies
    return {n: tuple(np.array(v, np.int64).T) for n, v in out.items()}


def pack(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset; ``ids`` too (little-endian 32 bit) if asked.

    A document's ids are the tokenizer's without special tokens, then ``end``.
    Only a document of more than ``capacity`` ids is cut: its first piece takes
    what full pieces leave over. Null and empty texts are the end id alone.
    Rows are packed as they come, with repeated and null ids as they are.
    Sequences are numbered from 0 and filled without gaps from offset 0.
    """
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    rows = written(documents(docs).mapInArrow(_emit(tokenizer, end, capacity, with_ids), kind), "pieces")
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(PARTS)).cast("int")
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("length", "part").count().collect()  # capacity * PARTS rows at most
    total: Counter[int] = Counter()
    base = {}
    for r in sorted(counts, key=lambda r: (r["length"], r["part"])):
        base[r["length"], r["part"]] = total[r["length"]]
        total[r["length"]] += r["count"]
    slots = _slots(plan(dict(total), capacity))
    before = np.zeros((capacity + 1, PARTS), np.int64)
    for (n, p), v in base.items():
        before[n, p] = v
    inner = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("rank", inner.cast("long"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, p = b.column("length").to_numpy(), b.column("part").to_numpy()
            rank = b.column("rank").to_numpy() + before[n, p]
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for v in np.unique(n):
                k = np.flatnonzero(n == v)
                from_rank, first, at = slots[int(v)]
                j = np.searchsorted(from_rank, rank[k], "right") - 1
                seq[k], off[k] = first[j] + rank[k] - from_rank[j], at[j]
            yield pa.record_batch([*b.columns[:len(b.columns) - 2], pa.array(seq), pa.array(off)], names=[*b.schema.names[:-2], "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place), kind + ", sequence_id long, offset long")
