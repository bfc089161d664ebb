"""Words, lines and hashes of whole texts, computed on Arrow string buffers with numpy.

A word is a maximal run of bytes outside a separator set that is plain ASCII,
so words of UTF-8 text can be found byte by byte. Hashes depend on nothing but
the bytes of a run: equal runs have equal hashes on every machine and in every
batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are turned into arrays at once; a longer document is handled alone.
PIECE_BYTES = 1 << 19

#: Flags of the first 0 to 8 bytes of a 64-bit number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Bytes of a word that are mixed eight at a time; a longer word is hashed alone.
_SHORT = 256


def separators(*spans: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags, False for the bytes inside the spans."""
    table = np.ones(256, bool)
    for a, b in spans:
        table[a:b + 1] = False
    return table


#: Words between white space: space and the controls 09 to 0D.
BLANK = separators((0x20, 0x20), (0x09, 0x0D))
#: Words of letters and digits; every byte above 7F belongs to a word.
ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]``, bytes or 32-bit numbers, for every pair.

    Eight bytes are mixed in at a time. The mix is a bijection and not linear,
    so runs of one length of up to eight bytes never collide, and no pattern of
    letters makes longer ones collide whatever the constants.
    """
    wide = values.itemsize
    per = 8 // wide
    padded = np.append(values, np.zeros(per, values.dtype))
    eight = np.ndarray(len(values) + 1, "<u8", padded, strides=(wide,))
    size = end - start
    h = mix(size.astype(np.uint64) * _A + _C)
    alone = size * wide > _SHORT
    at = np.flatnonzero((size > 0) & ~alone)
    pos, left = start[at], size[at]
    while len(at):
        h[at] = mix(h[at] ^ (eight[pos] & _FIRST[np.minimum(left, per) * wide]))
        more = left > per
        at, pos, left = at[more], pos[more] + per, left[more] - per
    view = memoryview(padded).cast("B")
    for i in np.flatnonzero(alone):
        h[i] = int.from_bytes(hashlib.blake2b(view[int(start[i]) * wide:int(end[i]) * wide], digest_size=8).digest(), "little")
    return h


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in their order."""
    x = b >> np.uint64(29)
    x ^= b
    x *= _A
    x += a * _B
    x ^= x >> np.uint64(32)
    x *= _C
    return x


def _pairs(v: np.ndarray, apart: int) -> np.ndarray:
    """``_pair`` of all values that stand ``apart``, a block that stays in cache at a time."""
    n = len(v) - apart
    out = np.empty(max(n, 0), np.uint64)
    for at in range(0, n, 1 << 14):
        to = min(at + (1 << 14), n)
        out[at:to] = _pair(v[at:to], v[at + apart:to + apart])
    return out


def segment_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the hashes ``values[start:end]`` for every pair, independent of where the run stands.

    Runs of 1, 2, 4, ... values are hashed by pairs of shorter ones; a run is
    put together from those that its length is the sum of, so runs of one
    length meet in the same way everywhere. Each step ends in a mix that is not
    linear: there is no pattern (such as the Thue-Morse sequence and its
    complement) whose terms cancel.
    """
    size = end - start
    h, at, doubled, k = np.zeros(len(size), np.uint64), start, values, 0
    longest = int(size.max()) if len(size) else 0
    alike = longest == (int(size.min()) if len(size) else 0)
    while longest >> k:
        mine = slice(None) if alike else np.flatnonzero(size >> k & 1)
        if not alike or longest >> k & 1:
            run = doubled[at[mine]]
            lower = size[mine] & ((1 << k) - 1) > 0  # a part of the run is hashed already
            h[mine] = np.where(lower, _pair(h[mine], run), run) if lower.any() else run
            at = at + (size & (1 << k))
        if longest >> (k + 1):
            doubled = _pairs(doubled, 1 << k)
        k += 1
    return mix(h + size.astype(np.uint64) * _A)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        _, offs = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
            to = min(max(to, at + 1), at + 4096, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of some texts: where each begins and ends, its hash, and the first word of every text."""

    def __init__(self, col: pa.Array, table: np.ndarray = BLANK, lower: bool = False):
        data, offs = text_bytes(col)
        if lower:
            data = LOWER[data]
        self.data, self.offs = data, offs
        inside = table[data]
        edge = np.zeros(len(data), bool)
        full = offs[1:] > offs[:-1]
        edge[offs[:-1][full]] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[edge] = False
        self.start = np.flatnonzero(inside & ~before)
        last = np.zeros(len(data), bool)
        last[offs[1:][full] - 1] = True
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[last] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return run_hash(self.data, self.start, self.end)

    def doc(self) -> np.ndarray:
        """Row of every word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of ``size`` words that lie inside one text."""
        n = len(self.start)
        if n < size:
            return np.zeros(0, np.int64)
        d = self.doc()
        return np.flatnonzero(d[:n - size + 1] == d[size - 1:])


def word_hash(text: str, table: np.ndarray = BLANK, lower: bool = False) -> np.ndarray:
    """Word hashes of one text, as every batch would give them."""
    return Words(pa.array([text]), table, lower).hashes()


def signed(h: np.ndarray) -> pa.Array:
    """Unsigned hashes as the signed 64-bit column Spark can hold."""
    return pa.array(h.view(np.int64))


def documents(df: DataFrame, *more: str) -> DataFrame:
    """Only ``doc_id`` and ``text`` (and named others), whatever else the table carries."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


