"""De-duplication by keys, by content and by signatures."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions import text as tx
from ..session import cut


def first_by_key(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Earliest row per key with its repeat count.

    A minimum over structs combines on the map side, so a key with a third of
    the rows reaches its task as one row per input partition.
    """
    first = F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("f")
    out = rows.groupBy(*keys).agg(first, F.count("*").alias("copies"))
    return out.select(*keys, *[F.col(f"f.{c}").alias(c) for c in keep], "copies")


def first_within_ttl(rows: DataFrame, keys: list[str], t: str, order: str, ttl_seconds: int = 7 * 86400) -> DataFrame:
    """Kept rows of every key: the first, and then the first that comes after the mark of the one before has run out.

    A mark is set when a row is kept and is not renewed by repeats. Each round
    finds the next kept row of all keys at once as a minimum, which combines on
    the map side; marks are at least a TTL apart, so the clock bounds the rounds.
    Returns (keys, us, ``order``). Rows without time or with a null key are left out.
    """
    us = F.unix_micros(F.col(t).cast("timestamp"))
    base = rows.where(F.greatest(*[F.col(k).isNull() for k in keys], us.isNull()) == F.lit(False)).select(*keys, us.alias("us"), F.col(order))
    first = lambda df: df.groupBy(*keys).agg(F.min(F.struct("us", order)).alias("f")).select(*keys, "f.us", f"f.{order}")
    last = cut(first(base))
    kept = last
    while True:
        ends = last.select(*keys, (F.col("us") + F.lit(ttl_seconds * 1_000_000)).alias("ends"))
        last = cut(first(base.join(ends, keys).where("us >= ends")))
        if not last.limit(1).count():
            return kept
        kept = kept.unionByName(last)


def gap_starts(rows: DataFrame, keys: list[str], t: str, order: str, gap_seconds: int, chunk_seconds: int = 60) -> DataFrame:
    """Rows that open a new run: the previous row of the key is more than ``gap`` back.

    Within a chunk shorter than the gap only the first row can open a run, so the
    rows are first reduced to (key, chunk). The window then sees chunks, whose
    number per key is bounded by the clock, not by the traffic of the key.
    """
    if chunk_seconds > gap_seconds:
        raise ValueError("the chunk must not be longer than the gap")
    us = F.unix_micros(F.col(t).cast("timestamp"))
    per = rows.groupBy(*keys, F.floor(us / F.lit(chunk_seconds * 1_000_000)).alias("chunk")).agg(
        F.min(F.struct(us.alias("us"), F.col(order).alias("id"))).alias("first"), F.max(us).alias("last_us"), F.count("*").alias("n"))
    prev = F.lag("last_us").over(Window.partitionBy(*keys).orderBy("chunk"))
    is_start = prev.isNull() | (F.col("first.us") - prev > F.lit(gap_seconds * 1_000_000))
    return per.select(*keys, "chunk", F.col("first.id").alias(order), F.col("first.us").alias("us"), "last_us", "n", is_start.alias("opens"))


def sessions(rows: DataFrame, keys: list[str], t: str, order: str, gap_seconds: int, chunk_seconds: int = 3600) -> DataFrame:
    """Quiet-gap sessions per key: number, first and last time, size."""
    c = gap_starts(rows, keys, t, order, gap_seconds, chunk_seconds)
    no = F.sum(F.col("opens").cast("int")).over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("session", no).groupBy(*keys, "session").agg(
        F.min("us").alias("start_us"), F.max("last_us").alias("end_us"), F.sum("n").alias("n"))


def content_dedup(rows: DataFrame, hash_col: str, t: str, order: str, ttl_seconds: int = 21600) -> DataFrame:
    """Kept rows: first sight of a content hash, or first after a quiet TTL."""
    return gap_starts(rows, [hash_col], t, order, ttl_seconds).where("opens").select(hash_col, order)


def dedup_ratio(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Share of dropped repeats per source and the investigation flag."""
    per = rows.groupBy("source", *[k for k in keys if k != "source"]).agg(F.count("*").alias("n"))
    r = 1 - F.count("*") / F.sum("n")
    return per.groupBy("source").agg(F.sum("n").alias("mentions"), F.count("*").alias("kept"), r.alias("ratio"), (r > 0.7).alias("suspicious"))


def url_rule(mentions: DataFrame, min_sources: int = 3) -> DataFrame:
    """A url in many sources is kept and boosted; within one source the oldest wins."""
    key = F.struct("published_at", "external_id")
    per = mentions.groupBy("url", "source").agg(
        F.min(key).alias("first"), F.count_distinct("author_id").alias("authors"))
    wide = per.groupBy("url").agg(F.count("*").alias("n_sources"))
    facts = per.join(wide, "url").select(
        "url", "source", F.col("first.external_id").alias("keeper"), "authors", (F.col("n_sources") >= min_sources).alias("boost"))
    dup = ~F.col("boost") & (F.col("authors") > 1) & (F.col("external_id") != F.col("keeper"))
    return mentions.join(facts, ["url", "source"]).select("external_id", "boost", F.when(dup, F.col("keeper")).alias("dup_of"))


def collapse_reposts(posts: DataFrame) -> DataFrame:
    """Fold text-less reposts into their parent as ``amplification_count``."""
    bare = F.coalesce(F.trim("text"), F.lit("")) == ""
    pure = posts.where(bare & F.col("reply_to").isNotNull()).groupBy(F.col("reply_to").alias("external_id")).agg(
        F.count("*").alias("amplification_count"))
    kept = posts.where(~(bare & F.col("reply_to").isNotNull()))
    return kept.join(pure, "external_id", "left").fillna({"amplification_count": 0})


def merge_keyed(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """First non-empty value per field in order, and the number of repeats."""
    def first_filled(c):
        filled = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        return F.min_by(F.when(filled, F.col(c)), F.when(filled, F.col(order))).alias(c)

    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[first_filled(c) for c in fields], (F.count("*") - 1).alias("duplicates"))


#: Modulus of the permutations: the least prime above 2**32.
PRIME = 4_294_967_311


def permutation(j: int) -> tuple[int, int]:
    """Factor and shift of permutation ``j``: multiples of two odd constants, the factor below 2**31."""
    return (j + 1) * 715_827_883 % 2_147_483_647 + 1, (j + 1) * 1_013_904_223 % PRIME


def hash32(col: Column, part: int = 0) -> Column:
    """32 bits of the MD5 of a string as BIGINT, so that any engine can repeat them."""
    return F.conv(F.substring(F.md5(col), 1 + 8 * part, 8), 16, 10).cast("bigint")


def minhash(docs: DataFrame, id_col: str, words: Column, num_perm: int = params.NUM_PERM) -> DataFrame:
    """MinHash signatures: ``sig`` is an ARRAY of ``num_perm`` BIGINT.

    A task hashes the different words of a batch of texts once and permutes
    those; a text takes the minimum over the places of its words. Only
    signatures are shuffled, and rows of one id make one signature. Texts
    without tokens get a sentinel signature.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.array_distinct(words).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    each = rows.mapInArrow(_signer(num_perm), f"id {kind}, sig array<bigint>, n_tokens bigint")
    least = F.aggregate("sigs", F.get("sigs", F.lit(0)), lambda a, s: F.zip_with(a, s, lambda x, y: F.least(x, y)))  # nulls are left out
    whole = each.groupBy("id").agg(F.collect_list("sig").alias("sigs"), F.sum("n_tokens").alias("n_tokens"))
    sentinel = F.array_repeat(F.lit(-1).cast("bigint"), num_perm)
    return whole.select(F.col("id").alias(id_col), F.coalesce(F.when(F.size("sigs") > 1, least).otherwise(F.get("sigs", F.lit(0))), sentinel).alias("sig"), "n_tokens")


def _signer(num_perm: int):
    """Batches of (id, t) to (id, sig or null, number of words)."""
    factors = [permutation(j) for j in range(num_perm)]

    def sign(batches):
        for batch in batches:
            t = batch.column(1)
            n = pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = t.flatten().cast(pa.binary()).dictionary_encode()
            h = np.array([int.from_bytes(hashlib.md5(w).digest()[:4], "big") for w in coded.dictionary.to_pylist()], np.uint64)
            at, full = coded.indices.to_numpy(), n > 0
            starts = (np.cumsum(n) - n)[full]
            sig = np.empty((starts.size, num_perm), np.int64)
            for j, (a, b) in enumerate(factors):
                if starts.size:
                    sig[:, j] = np.minimum.reduceat(((np.uint64(a) * h + np.uint64(b)) % np.uint64(PRIME)).astype(np.int64)[at], starts)
            ends = np.append(0, np.cumsum(full) * num_perm).astype(np.int32)
            sigs = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~full, False)), pa.array(sig.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), sigs, pa.array(n)], ["id", "sig", "n_tokens"])

    return sign


def bands(signatures: DataFrame, id_col: str, n_bands: int = params.BANDS, rows: int = params.ROWS) -> DataFrame:
    """One row per (band, band hash, id)."""
    keys = F.array(*[F.md5(F.array_join(F.slice("sig", b * rows + 1, rows), ",")) for b in range(n_bands)])
    return signatures.select(id_col, F.posexplode(keys).alias("band", "band_hash"))


def tight_bands(num_perm: int = params.NUM_PERM, threshold: float = params.JACCARD_MIN) -> list[tuple[int, int]]:
    """Split of a signature that cannot miss a pair at or above ``threshold``.

    Such a pair differs in at most ``d`` positions. Cut into ``d + 1`` slices, at
    least one slice is untouched. Wider slices than the usual four rows mean far
    fewer chance collisions, at no loss.
    """
    d = num_perm - math.ceil(threshold * num_perm - 1e-9)
    edges = [round(i * num_perm / (d + 1)) for i in range(d + 2)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(d + 1)]


def lossless_bands(signatures: DataFrame, id_col: str, threshold: float = params.JACCARD_MIN, num_perm: int = params.NUM_PERM) -> DataFrame:
    keys = F.array(*[
        F.xxhash64(F.lit(i), F.slice("sig", start + 1, length)) for i, (start, length) in enumerate(tight_bands(num_perm, threshold))])
    return signatures.select(id_col, F.explode(keys).alias("bucket"))


def signature_jaccard(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return same / F.size(a)


#: Bytes of the signatures of one side; a task holds two sides. Pairs that are compared at once.
SIDE_BYTES, PAIRS = 128 << 20, 1 << 15


def candidate_pairs(signatures: DataFrame, id_col: str, n_bands: int = params.BANDS, rows: int = params.ROWS) -> DataFrame:
    """Pairs of distinct signatures that share a band: a, b (smallest ids), the texts each stands for, shared bands, estimated Jaccard.

    Equal signatures are one class first, so copies give no pairs among
    themselves. Every pair of classes that shares a band is there. Classes are
    dealt to sides; two sides meet in one task, which finds the shared bands and
    compares the signatures at hand. So signatures travel once for every side
    and a pair is a row of the result only.
    """
    classes = cut(signatures.groupBy("sig").agg(F.min(id_col).alias("id"), F.count("*").alias("docs")))
    facts = classes.agg(F.count("*").alias("n"), F.max(F.size("sig")).alias("size")).first()
    # more sides than the bytes ask for where every core is to have some tasks
    sides = max(math.isqrt(6 * signatures.sparkSession.sparkContext.defaultParallelism), math.ceil(4 * facts["n"] * (facts["size"] or 0) / SIDE_BYTES), 1)
    kind = classes.schema["id"].dataType.simpleString()
    side = F.pmod(F.xxhash64("id"), F.lit(sides)).cast("int")
    # The sentinel of texts without tokens is one class and shares a band with no other.
    packed = classes.where(F.get("sig", F.lit(0)) >= 0).select("sig", "id", "docs").mapInArrow(_packed, f"id {kind}, docs bigint, low binary, high binary").withColumn("side", side)
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    cells = met.select(F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), (F.col("side") > F.col("other")).alias("second"), "id", "docs", "low", "high")
    return cells.groupBy("i", "j").applyInArrow(_pairs_of_sides(n_bands, rows), f"a {kind}, b {kind}, docs_a bigint, docs_b bigint, shared bigint, jaccard_est double")


def _packed(batches):
    """(sig, id, docs) to (id, docs, low, high): values as 32 bits, and what lies above them where there is anything."""
    for batch in batches:
        sig = [np.asarray(v.values, dtype=np.int64) for v in batch.column("sig")]
        high = [(v >> 32).astype(np.uint32) for v in sig]
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), batch.column("docs"), pa.array([v.astype(np.uint32).tobytes() for v in sig], pa.binary()),
            pa.array([h.tobytes() if h.any() else None for h in high], pa.binary())], names=["id", "docs", "low", "high"])


def _unpacked(table: pa.Table) -> np.ndarray:
    """Signatures as rows, of 32 bits unless a value needs more."""
    low, high = table.column("low"), table.column("high")
    size = len(low[0].as_py()) // 4
    sig = np.frombuffer(b"".join(low.to_pylist()), np.uint32).reshape(-1, size)
    if high.null_count < len(high):
        none = bytes(4 * size)
        sig = sig + (np.frombuffer(b"".join(h or none for h in high.to_pylist()), np.uint32).reshape(-1, size).astype(np.uint64) << np.uint64(32))
    return sig


def _pairs_of_sides(n_bands: int, rows: int):
    """Rows of two sides (or of one, which meets itself) to their pairs, ``PAIRS`` at a time. A pair is given in the first band it shares."""
    odd = np.array([0x9E3779B97F4A7C15 + 2 * i * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF | 1 for i in range(rows)], np.uint64)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, docs, sig = table.column("id"), table.column("docs"), _unpacked(table)
        second = table.column("second").to_numpy()
        alone = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        one = np.flatnonzero(~second)
        two = one if alone else np.flatnonzero(second)
        for k in range(n_bands):
            # a key may stand for two bands: what counts is the comparison below
            key = (sig[:, k * rows:(k + 1) * rows].astype(np.uint64) * odd).sum(axis=1, dtype=np.uint64)
            there = two[np.argsort(key[two], kind="stable")]
            lo, hi = (np.searchsorted(key[there], key[one], side) for side in ("left", "right"))
            ends = np.cumsum(hi - lo)
            for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                n = np.arange(at, min(at + PAIRS, int(ends[-1])))
                of = np.searchsorted(ends, n, "right")
                x, y = one[of], there[hi[of] - (ends[of] - n)]
                if alone:
                    x, y = x[x < y], y[x < y]
                same = sig[x] == sig[y]
                band = same[:, :n_bands * rows].reshape(len(x), n_bands, rows).all(axis=2)
                new = band[:, k] & ~band[:, :k].any(axis=1)
                if not new.any():
                    continue
                x, y, shared, jaccard = x[new], y[new], band[new].sum(axis=1), same[new].sum(axis=1) / sig.shape[1]
                p, q = ids.take(pa.array(x)), ids.take(pa.array(y))
                later = pc.greater(p, q).to_numpy()
                a, b = pa.array(np.where(later, y, x)), pa.array(np.where(later, x, y))
                made = [ids.take(a), ids.take(b), docs.take(a), docs.take(b), pa.array(shared, pa.int64()), pa.array(jaccard)]
                made = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made]
                yield pa.RecordBatch.from_arrays(made, names=["a", "b", "docs_a", "docs_b", "shared", "jaccard_est"])

    return visit


def simhash(docs: DataFrame, id_col: str, words: Column) -> DataFrame:
    """64-bit SimHash: sign of the summed token-hash bits, combined on the map side."""
    tok = docs.select(id_col, F.explode(F.array_distinct(words)).alias("tok")).select(id_col, hash32(F.col("tok")).alias("h0"), hash32(F.col("tok"), 1).alias("h1"))
    sums = tok.groupBy(id_col).agg(*[
        F.sum(F.when(F.getbit(f"h{i // 32}", F.lit(i % 32)) == 1, 1).otherwise(-1)).alias(f"b{i}") for i in range(64)])
    bits = F.concat(*[F.when(F.col(f"b{i}") > 0, "1").otherwise("0") for i in range(63, -1, -1)])
    return sums.select(id_col, bits.alias("bits"))


def near_simhashes(hashes: DataFrame, id_col: str, most: int = 3) -> DataFrame:
    """Ids whose hash is within ``most`` bits of that of a smaller id.

    Equal hashes are one class: all its ids but the first have a copy. Two
    classes within ``most`` bits agree in one of ``most + 1`` parts, so the first
    id of a class is compared with the classes that share a part, and none is
    missed. The join keeps an id once, however many it is near to.
    """
    classes = cut(hashes.groupBy("bits").agg(F.min(id_col).alias("first")))
    width = 64 // (most + 1)
    parts = F.array(*[F.substring("bits", 1 + i * width, width if i < most else 64 - i * width) for i in range(most + 1)])
    spread = classes.select("first", "bits", F.posexplode(parts).alias("part", "value"))
    earlier = spread.select("part", "value", F.col("first").alias("f"), F.col("bits").alias("fb"))
    near = spread.join(earlier, (spread["part"] == earlier["part"]) & (spread["value"] == earlier["value"]) & (earlier["f"] < spread["first"])
                       & (hamming(spread["bits"], earlier["fb"]) <= most), "left_semi").select(F.col("first").alias(id_col)).distinct()
    copies = hashes.join(classes, "bits").where(F.col(id_col) != F.col("first")).select(id_col)
    return copies.union(near)


def hamming(bits_a: Column, bits_b: Column) -> Column:
    parts = [F.bit_count(F.conv(F.substring(bits_a, 32 * i + 1, 32), 2, 10).cast("bigint").bitwiseXOR(
        F.conv(F.substring(bits_b, 32 * i + 1, 32), 2, 10).cast("bigint"))) for i in range(2)]
    return parts[0] + parts[1]
