"""Removal of repeated word spans on a compacted de Bruijn graph.

A window of ``size`` words is an edge between its first and its last
``size - 1`` words. The graph is never spelled out edge by edge:

1. Consecutive windows of a document that hold the same rarest ``SEED``-gram
   at the same place (their leftmost minimum hash) form a path. Equal windows
   always agree on that seed, so a seed's bucket holds every copy of its edges.
2. Paths are grouped by (seed, words of the path). A bucket with one path is
   nonbranching: the path stays compact however often it occurs, and its
   earliest source coordinate stands for all its edges. Only where paths of a
   bucket differ are the first occurrences expanded into single edges.
3. A Spark join on the source coordinate brings both back to the documents: a
   path that is not the first of its kind lies wholly in a repeated span; an
   expanded edge is repeated where it is not the earliest with its words.

Paths are grouped by two independent 64-bit hashes over all their words (the
seed's and the path's), edges by the seed's and the window's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import grouped, lean, written
from .words import BLANK, Words, documents, pieces, segment_hash, signed

#: Words of a seed.
SEED = 8


def _leftmost(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of every run of ``width`` values."""
    n = len(values) - width + 1
    v, at, have = values, np.arange(len(values)), 1
    while have < width:
        d = min(have, width - have)
        m = len(v) - d
        less = v[d:] < v[:m]
        v, at, have = np.where(less, v[d:], v[:m]), np.where(less, at[d:], at[:m]), have + d
    return at[:n]


def _paths(w: Words, h: np.ndarray, size: int):
    """(first word, windows, row, seed hash, path hash) of all paths of some texts."""
    win = w.windows(size)
    if not len(win):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    lead = np.arange(len(h) - SEED + 1)
    grams = segment_hash(h, lead, lead + SEED)
    seed = _leftmost(grams, size - SEED + 1)[win]
    new = np.ones(len(win), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (win[1:] != win[:-1] + 1)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(win)))
    first = win[at]
    # the place of the seed is part of what makes two paths equal
    path = segment_hash(h, first, first + n + size - 1) ^ (seed[at] - first).astype(np.uint64)
    return first, n, w.doc()[first], grams[seed[at]], path


def _emit_paths(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w = Words(b.column("text"))
            first, n, row, seed, path = _paths(w, w.hashes(), size)
            if not len(first):
                continue
            doc = np.asarray(b.column("doc_id"))[row]
            pos = ((first - w.first[row]) << 8) | n
            # copies inside the piece are counted here, so a hot path costs one row a piece
            k = np.lexsort((pos, doc, path, seed))
            new = np.ones(len(k), bool)
            new[1:] = (seed[k][1:] != seed[k][:-1]) | (path[k][1:] != path[k][:-1])
            k = k[new]
            yield pa.record_batch({"seed": signed(seed[k]), "path": signed(path[k]), "doc_id": pa.array(doc[k]), "pos": pa.array(pos[k])})
    return run


def _joined(w: Words, keep: np.ndarray) -> list[str]:
    """SHA-256 of the kept words of every text, joined by one space."""
    k = np.flatnonzero(keep)
    s, size = w.start[k], w.end[k] - w.start[k] + 1
    to = np.cumsum(size)
    at = np.arange(to[-1] if len(to) else 0) - np.repeat(to - size - s, size)
    data = np.append(w.data, np.uint8(32))[at]
    data[to - 1] = 32
    edge = np.append(0, to)[np.searchsorted(k, w.first)]
    view = memoryview(data)
    return [hashlib.sha256(view[a:max(a, b - 1)]).hexdigest() for a, b in zip(edge[:-1], edge[1:])]


def _cover(n: int, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Words inside any of the spans."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, first + length, -1)
    return np.cumsum(mark[:-1]) > 0


_STATE = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("cover", pa.binary()), ("seed", pa.int64()),
                    ("edge", pa.int64()), ("pos", pa.int64()), ("mask", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                    ("kept_sha256", pa.string())])
_STATE_SQL = "kind int, doc_id long, text string, cover binary, seed long, edge long, pos long, mask binary, n_words long, n_removed long, kept_sha256 string"
SETTLED, OPEN, EDGE = 0, 1, 2


def _rows(n: int, **cols) -> pa.RecordBatch:
    return pa.record_batch([cols[f.name].cast(f.type) if f.name in cols else pa.nulls(n, f.type) for f in _STATE], schema=_STATE)


def _settled(w: Words, ids: pa.Array, rows: np.ndarray, cover: np.ndarray, hashes: list[str], kind: int) -> pa.RecordBatch:
    removed = np.add.reduceat(np.append(cover, False).astype(np.int64), np.minimum(w.first[:-1], len(cover)))
    removed[w.count == 0] = 0
    bits = [np.packbits(cover[a:b]).tobytes() for a, b in zip(w.first[rows], w.first[rows + 1])]
    return _rows(len(rows), kind=pa.array(np.full(len(rows), kind)), doc_id=ids.take(pa.array(rows)), mask=pa.array(bits, pa.binary()),
                 n_words=pa.array(w.count[rows]), n_removed=pa.array(removed[rows]), kept_sha256=pa.array([hashes[i] for i in rows], pa.string()))


def _resolve_paths(size: int):
    """Documents with the known coordinates of first paths; the others are copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "doc_id", "text"):
            here = t.column("kind").to_numpy()
            docs = t.filter(pa.array(here < 0)).to_batches()
            if not docs:
                continue
            docs = pa.Table.from_batches(docs).combine_chunks().to_batches()[0]
            ids = docs.column("doc_id")
            w = Words(docs.column("text"))
            h = w.hashes()
            first, n, row, seed, _ = _paths(w, h, size)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(-1).to_numpy()
            # coordinates as (place of the document in this table, position), both small
            keys = np.unique(doc[known])
            f = t.filter(pa.array(here >= 0))
            fd, fp, fk = f.column("doc_id").to_numpy(), f.column("pos").to_numpy(), f.column("kind").to_numpy()
            slot = np.searchsorted(keys, fd)
            slot[slot >= len(keys)] = 0
            ok = keys[slot] == fd if len(keys) else np.zeros(len(fd), bool)
            fkey = (slot[ok] << 40) | (fp[ok] >> 8)
            order = np.argsort(fkey)
            fkey, fk = fkey[order], fk[ok][order]
            mine = (np.searchsorted(keys, doc[row]) << 40) | (first - w.first[row])
            at = np.minimum(np.searchsorted(fkey, mine), max(len(fkey) - 1, 0))
            listed = fkey[at] == mine if len(fkey) else np.zeros(len(mine), bool)
            state = np.where(listed, fk[at] if len(fkey) else 0, 2)
            state[~known[row]] = 0
            copy = state == 2
            cover = _cover(len(h), first[copy], n[copy] + size - 1)
            branch = np.flatnonzero(state == 1)
            waits = np.zeros(len(w.count), bool)
            waits[row[branch]] = True
            hashes = _joined(w, ~cover)
            yield _settled(w, ids, np.flatnonzero(~waits), cover, hashes, SETTLED)
            if not len(branch):
                continue
            rows = np.flatnonzero(waits)
            bits = [np.packbits(cover[a:b]).tobytes() for a, b in zip(w.first[rows], w.first[rows + 1])]
            yield _rows(len(rows), kind=pa.array(np.full(len(rows), OPEN)), doc_id=ids.take(pa.array(rows)),
                        text=docs.column("text").take(pa.array(rows)), cover=pa.array(bits, pa.binary()))
            m = n[branch]
            e = np.repeat(first[branch], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            r = np.repeat(row[branch], m)
            yield _rows(len(e), kind=pa.array(np.full(len(e), EDGE)), doc_id=pa.array(doc[r]), pos=pa.array(e - w.first[r]),
                        seed=signed(np.repeat(seed[branch], m)), edge=signed(segment_hash(h, e, e + size)))
    return run


def _resolve_edges(size: int):
    """Open documents with the outcome of their expanded edges: kind 0 the earliest of its words, 1 a repeated one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "doc_id", "text"):
            here = t.column("kind").to_numpy()
            docs = t.filter(pa.array(here < 0))
            if not docs.num_rows:
                continue
            docs = docs.combine_chunks().to_batches()[0]
            w = Words(docs.column("text"))
            doc = docs.column("doc_id").to_numpy()
            cover = np.zeros(len(w.start), bool)
            for i, bits in enumerate(docs.column("cover").to_pylist()):
                a, b = w.first[i], w.first[i + 1]
                cover[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
            f = t.filter(pa.array(here == 1))
            fd, fp = f.column("doc_id").to_numpy(), f.column("pos").to_numpy()
            # rows of one document share an id, so each takes all its marks
            lo, hi = np.searchsorted(fd, doc, "left"), np.searchsorted(fd, doc, "right")
            at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)] or [np.zeros(0, np.int64)]).astype(np.int64)
            where = np.repeat(w.first[:-1], hi - lo) + fp[at]
            cover |= _cover(len(cover), where, np.full(len(where), size))
            yield _settled(w, docs.column("doc_id"), np.arange(len(doc)), cover, _joined(w, ~cover), SETTLED)
    return run


def repeated_spans(docs: DataFrame, size: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and ``mask``, a bit per word that is set where it goes.

    A word goes if a window of ``size`` words over it also starts earlier
    (smaller doc_id, or earlier in the same document); windows are judged on
    the texts as given. Words are runs of bytes other than white space.

    Null texts have no words. Rows without doc_id have no place in the order:
    they are kept whole and give no copies. ``doc_id`` names a document: rows
    that repeat it with the same text are one document read twice, and both
    are returned. Other columns are ignored.
    """
    if not SEED <= size <= 120:
        raise ValueError(f"windows have {SEED} to 120 words")
    base = documents(docs)
    paths = base.where("doc_id is not null and text is not null").mapInArrow(lean(_emit_paths(size)), "seed long, path long, doc_id long, pos long")
    # Copies were counted inside every piece of text, so no seed holds more than a small share of the rows that are dealt out here.
    bucket = Window.partitionBy("seed")
    kinds = (paths.repartition("seed").groupBy("seed", "path").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
             .withColumn("kind", (F.count("*").over(bucket) > 1).cast("int")))
    null = lambda kind: F.lit(None).cast(kind)
    stream = base.select("doc_id", F.lit(-1).alias("kind"), null("long").alias("pos"), "text").union(
        kinds.select("at.doc_id", "kind", "at.pos", null("string")))
    state = written(stream.repartition(F.coalesce("doc_id", F.xxhash64("text"))).sortWithinPartitions("doc_id", "kind").mapInArrow(_resolve_paths(size), _STATE_SQL), "paths")
    edges = state.where(F.col("kind") == EDGE).select("seed", "edge", F.struct("doc_id", "pos").alias("at"))
    firsts = edges.groupBy("seed", "edge").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    # All occurrences but the first. Those that were expanded are one row for each differing path, not one for each copy.
    again = written(firsts.select("seed", "edge", "first"), "edges")
    marks = edges.join(again, ["seed", "edge"]).where("at <> first").select("at.doc_id", F.lit(1).alias("kind"), "at.pos", null("string"), null("binary"))
    opened = state.where(F.col("kind") == OPEN).select("doc_id", F.lit(-1).alias("kind"), null("long").alias("pos"), "text", "cover")
    last = opened.union(marks).repartition("doc_id").sortWithinPartitions("doc_id", "kind").mapInArrow(_resolve_edges(size), _STATE_SQL)
    out = ["doc_id", "n_words", "n_removed", "kept_sha256", "mask"]
    return state.where(F.col("kind") == SETTLED).select(out).union(last.select(out))


def kept_texts(docs: DataFrame, size: int = 20) -> DataFrame:
    """The documents with their repeated spans taken out: words that stay, joined by one space.

    A text of which nothing goes is left as it is; one of which nothing stays
    becomes empty. All other columns pass through unchanged.
    """
    spans = repeated_spans(docs, size).where("n_removed > 0 and doc_id is not null").select("doc_id", "mask").distinct()
    fields = docs.schema

    def run(batches):
        for b in pieces(batches, "text"):
            w = Words(b.column("text"), BLANK)
            masks, raw, out = b.column("__mask").to_pylist(), w.data.tobytes(), b.column("text").to_pylist()
            for i, m in enumerate(masks):
                if m is not None:
                    lo, hi = w.first[i], w.first[i + 1]
                    gone = np.unpackbits(np.frombuffer(m, np.uint8), count=hi - lo).astype(bool)
                    k = lo + np.flatnonzero(~gone)
                    out[i] = b" ".join(raw[s:e] for s, e in zip(w.start[k], w.end[k])).decode()
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field("text"), pa.array(out, b.schema.field("text").type)).drop_columns(["__mask"])

    return docs.join(spans.withColumnRenamed("mask", "__mask"), "doc_id", "left").select(*docs.columns, "__mask").mapInArrow(lean(run), fields)
