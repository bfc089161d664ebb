"""Token files: one wavelet matrix per shard.

A shard holds the ids of consecutive documents as bit planes, highest bit
first; each plane is the last one stably split into zeros and ones. Counts of
ones before every ``STEP`` bits give rank in constant time, and rank and
select on the planes give access, counting and occurrence lookup on the
stored planes themselves. Files are Parquet with zstd, a shard a row, so
writing is Spark's: committed once, whatever executors are lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .token_ids import encoder
from .words import documents, pieces

#: Ids after which a shard is closed; only one longer document makes it larger.
SHARD = 1 << 20
STEP = 512

FORMAT = ("shard long, n_tokens long, n_docs long, first_id long, last_id long, doc_ids binary, doc_known binary, lengths binary, "
          "zeros array<long>, planes array<binary>, ranks array<binary>")


class WaveletMatrix:
    """Access, rank, select and count over a sequence of unsigned ids."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            one = (a >> a.dtype.type(level)) & a.dtype.type(1) != 0
            packed = np.packbits(one)
            planes.append(packed)
            padded = np.zeros(-(-len(packed) * 8 // STEP) * STEP // 8, np.uint8)
            padded[:len(packed)] = packed
            ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, STEP // 64).sum(1)
            ranks.append(np.append(0, np.cumsum(ones)).astype(np.uint32))
            zero = ~one
            zeros.append(int(np.count_nonzero(zero)))
            a = np.concatenate([a[zero], a[one]])
        return cls(len(ids), zeros, planes, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        at = i // STEP
        total = int(self.ranks[level][at])
        bits = self.planes[level][at * STEP // 8:(i + 7) // 8]
        if len(bits):
            total += int(np.bitwise_count(bits).sum())
            if i % 8:
                total -= (int(bits[-1]) & (0xFF >> (i % 8))).bit_count()
        return total

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][i // 8]) >> (7 - i % 8) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, symbol: int, i: int, j: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self._ones(level, i), self._ones(level, j)
            i, j = (self.zeros[level] + a, self.zeros[level] + b) if symbol >> (len(self.planes) - 1 - level) & 1 else (i - a, j - b)
        return i, j

    def count(self, symbol: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in start..end."""
        if symbol >> len(self.planes):
            return 0
        i, j = self._range(symbol, start, self.n if end is None else end)
        return j - i

    rank = count

    def _select(self, level: int, k: int, bit: int) -> int:
        """Position of the k-th (from 0) zero or one of a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * STEP - ranks
        at = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][at * STEP // 8:(at + 1) * STEP // 8])
        return at * STEP + int(np.flatnonzero(bits == bit)[k - int(before[at])])

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of an id."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        i = self._range(symbol, 0, self.n)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - level) & 1
            i = self._select(level, i - self.zeros[level] if bit else i, bit)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def ids(self) -> np.ndarray:
        """The whole sequence: the splits of all planes undone, last plane first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            up = np.empty_like(a)
            up[~one] = a[:self.zeros[level]]
            up[one] = a[self.zeros[level]:] | kind(1 << (len(self.planes) - 1 - level))
            a = up
        return a

    @classmethod
    def of(cls, row) -> WaveletMatrix:
        """From a row of the file format."""
        return cls(row["n_tokens"], list(row["zeros"]), [np.frombuffer(p, np.uint8) for p in row["planes"]], [np.frombuffer(r, np.uint32) for r in row["ranks"]])


def _shards(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at, made = encoder(path), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        docs: list = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal made
            lengths = np.array([len(x) for x in held], "<i8")
            m = WaveletMatrix.build(np.concatenate(held))
            known = [d for d in docs if d is not None]
            row = {"shard": at << 32 | made, "n_tokens": m.n, "n_docs": len(docs), "first_id": min(known, default=None), "last_id": max(known, default=None),
                   "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(), "doc_known": np.packbits([d is not None for d in docs]).tobytes(),
                   "lengths": lengths.tobytes(), "zeros": m.zeros, "planes": [p.tobytes() for p in m.planes], "ranks": [r.tobytes() for r in m.ranks]}
            made += 1
            kinds = {"doc_ids": pa.binary(), "doc_known": pa.binary(), "lengths": pa.binary(), "zeros": pa.list_(pa.int64()), "planes": pa.list_(pa.binary()), "ranks": pa.list_(pa.binary())}
            return pa.record_batch({k: pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()})

        for b in pieces(batches, "text"):
            ids, count = enc.encode(b.column("text").fill_null("").to_pylist())
            for d, x in zip(b.column("doc_id").to_pylist(), np.split(ids, np.cumsum(count)[:-1])):
                if held and size + len(x) >= SHARD:
                    yield close()
                    held, docs, size = [], [], 0
                held.append(np.append(x, np.uint32(end)))
                docs.append(d)
                size += len(x) + 1
        if held:
            yield close()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 1) -> None:
    """Token files of all documents under ``path``, in ascending order of doc_id (null first), ``end`` after each document.

    Null and empty texts are the end id alone. Documents that share an id stand
    next to each other, by the hash of their text.
    """
    rows = documents(docs).repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(_shards(tokenizer, end), FORMAT).write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            ids = WaveletMatrix.of(row).ids().astype("<u4")
            n = np.frombuffer(row["lengths"], "<i8")
            known = np.unpackbits(np.frombuffer(row["doc_known"], np.uint8), count=len(n)).astype(bool)
            to = np.cumsum(n)
            view = memoryview(ids).cast("B")
            yield pa.record_batch({
                "shard": pa.array(np.full(len(n), row["shard"])), "doc_id": pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=~known), "inner": pa.array(to - n),
                "n_tokens": pa.array(n.astype(np.int64)), "ids_crc32": pa.array([zlib.crc32(view[4 * (b - a):4 * b]) for a, b in zip(n.tolist(), to.tolist())], pa.int64())})


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32."""
    files = spark.read.schema(FORMAT).parquet(path)
    per = files.select("shard", "n_tokens", F.shiftright("shard", 32).alias("part"))
    within = per.withColumn("inner_shard", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    # one row for each task that wrote, in order
    parts = per.groupBy("part").agg(F.sum("n_tokens").alias("t")).withColumn("before", F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    base = within.join(parts, "part").select("shard", (F.coalesce("inner_shard", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("base"))
    rows = files.mapInArrow(_read, "shard long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(spark: SparkSession, path: str, symbol: int) -> DataFrame:
    """(shard, position) of every occurrence of an id, by select on the stored planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                at = WaveletMatrix.of(row).occurrences(symbol)
                yield pa.record_batch({"shard": pa.array([row["shard"]] * len(at), pa.int64()), "position": pa.array(at, pa.int64())})

    return spark.read.schema(FORMAT).parquet(path).mapInArrow(run, "shard long, position long")
