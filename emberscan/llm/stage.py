"""Intermediate tables in the folder all executors share, and streams of rows grouped by document."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library other than glibc
        pass


def lean(run: Callable) -> Callable:
    """``run`` for workers that serve one stage after another and share their executor's memory.

    What an earlier stage left is given up first: the encoder of a tokenizer,
    and the holes between its arrays.
    """

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sys.modules.get("emberscan.llm.token_ids")
        if tokens is not None:
            tokens.release()
        trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return lean_run


def grouped(batches: Iterator[pa.RecordBatch], key: str, text: str, limit: int = 1 << 20) -> Iterator[pa.Table]:
    """Rows that arrive sorted by ``key``, in tables that never cut a key in two.

    A table is passed on once it holds ``limit`` bytes of text or 200,000 rows;
    only the rows of one key can make it larger. Rows without a key belong to
    no group and may be cut anywhere.
    """
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            held.append(batch)
            rows += batch.num_rows
            size += int(pc.sum(pc.binary_length(batch.column(text))).as_py() or 0)
            if rows < 200_000 and size < limit:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key)
            last = keys[-1]
            cut = pc.index(pc.fill_null(pc.equal(keys, last), False), True).as_py() if last.is_valid else table.num_rows
            if cut <= 0:
                held = table.to_batches()
                continue
            yield table.slice(0, cut)
            rest = table.slice(cut)
            held, rows = rest.to_batches(), rest.num_rows
            size = int(pc.sum(pc.binary_length(rest.column(text))).as_py() or 0)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_key(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal integer keys, from rows that arrive sorted by them."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        key = np.stack([t.column(c).to_numpy() for c in names], 1)
        cut = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1)
        for lo, hi in zip(cut[:-1], cut[1:]):
            yield t.slice(lo, hi - lo).combine_chunks()
        held = t.slice(cut[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks()
