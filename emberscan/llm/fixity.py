"""Fixity audit of WARC records: Merkle trees over ordered records, compared from the roots down.

Records are ordered by page_id in shards of ``SPAN`` ids. A leaf stands for
the records of one id: their number, bytes and a sum of their SHA-256 digests
(so that any number of repeats combines before a shuffle). An inner node hashes
the (place, length, digest) of its up to ``FAN`` children in order and covers
their offset range. Two replicas agree where roots agree; below a differing
root only the children of differing nodes are ever compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import written

#: Ids of a shard, and children of a node.
SPAN, FAN = 4096, 16


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record as text; null url and html are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
                    F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """shard, idx, page_id, records, offset, length, digest: one row per id, in the order of the shard.

    Rows without id are the leaf 0 of shard -1; they add up like repeats of one id.
    """
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(record).cast("long").alias("bytes"), F.sha2(record, 256).alias("d"))
    part = lambda i: F.sum(F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))  # noqa: E731  60 bits each
    per = hashed.groupBy("page_id").agg(F.count("*").alias("records"), F.sum("bytes").alias("length"),
                                        F.sha2(F.concat_ws(":", F.count("*"), *(part(i) for i in range(4))), 256).alias("digest"))
    shard = F.coalesce(F.floor(F.col("page_id") / SPAN), F.lit(-1)).cast("long")
    idx = F.coalesce(F.pmod(F.col("page_id"), F.lit(SPAN)), F.lit(0)).cast("long")
    before = Window.partitionBy("shard").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("shard", shard).withColumn("idx", idx).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(
        "shard", "idx", "page_id", "records", "offset", "length", "digest")


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels of nodes (shard, idx, offset, length, digest), leaves first; the last has one root for each shard."""
    levels, width = [leaf.select("shard", "idx", "offset", "length", "digest")], SPAN
    while width > 1:
        child = F.array_sort(F.collect_list(F.struct("idx", "length", "digest")))  # FAN at most
        text = F.concat_ws(";", F.transform(child, lambda c: F.concat_ws(":", c["idx"] % FAN, c["length"], c["digest"])))
        levels.append(levels[-1].groupBy("shard", F.floor(F.col("idx") / FAN).alias("idx")).agg(
            F.min("offset").alias("offset"), F.sum("length").alias("length"), F.sha2(text, 256).alias("digest")))
        width = -(-width // FAN)
    return levels


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Ids whose records differ: shard, page_id, fault, records and length on both sides, offset in the primary's shard.

    ``fault`` is missing (not in the replica), extra (not in the primary) or
    changed (other bytes, or another number of records). Offsets and lengths
    of the side that lacks the id are null. Empty tables have no shards.
    """
    a, b = written(leaves(primary), "primary"), written(leaves(replica), "replica")
    pairs = list(zip(tree(a), tree(b)))

    def differ(level: tuple[DataFrame, DataFrame], above: DataFrame | None) -> DataFrame:
        x, y = (df.select("shard", "idx", "digest") for df in level)
        if above is not None:
            x, y = (df.withColumn("up", F.floor(F.col("idx") / FAN)).join(above, ["shard", "up"], "left_semi") for df in (x, y))
        both = x.select("shard", "idx", F.col("digest").alias("p")).join(y.select("shard", "idx", F.col("digest").alias("q")), ["shard", "idx"], "full_outer")
        return both.where(~F.col("p").eqNullSafe(F.col("q"))).select("shard", F.col("idx").alias("up"))

    last = reduce(lambda above, level: written(differ(level, above), "differ"), reversed(pairs), None).withColumnRenamed("up", "idx")
    p = a.select("shard", "idx", F.col("page_id").alias("pa"), F.col("records").alias("records_primary"), "offset", F.col("length").alias("length_primary"))
    q = b.select("shard", "idx", F.col("page_id").alias("pb"), F.col("records").alias("records_replica"), F.col("length").alias("length_replica"))
    fault = F.when(F.col("records_replica").isNull(), "missing").when(F.col("records_primary").isNull(), "extra").otherwise("changed")
    return last.join(p, ["shard", "idx"], "left").join(q, ["shard", "idx"], "left").select(
        "shard", F.coalesce("pa", "pb").alias("page_id"), fault.alias("fault"), "records_primary", "records_replica", "offset", "length_primary", "length_replica")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known faults: of every 97 ids one record is altered, of every 89 one is lost, of every 83 one is there twice."""
    html = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("~"), F.coalesce("html", F.lit("")))).otherwise(F.col("html"))
    twice = F.when(F.col("page_id") % 83 == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return pages.where("page_id is null or page_id % 89 <> 7").select("page_id", "url", html.alias("html"), F.explode(twice).alias("copy")).drop("copy")


_RECORD = ("'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e || "
           "'Content-Type: text/html' || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e")

ORACLE = f"""
WITH r AS (SELECT page_id, strlen({_RECORD}) n FROM pages, (SELECT chr(13) || chr(10) AS e)),
o AS (SELECT page_id, n, page_id // {SPAN} s, coalesce(sum(n) OVER (PARTITION BY page_id // {SPAN} ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) f FROM r),
x AS (SELECT *, page_id % 97 = 13 c, page_id % 89 = 7 m, page_id % 83 = 5 d,
             n + CASE WHEN page_id % 97 = 13 THEN 1 + strlen(((SELECT strlen(coalesce(html, '')) FROM pages p WHERE p.page_id = o.page_id) + 1)::VARCHAR)
                      - strlen((SELECT strlen(coalesce(html, '')) FROM pages p WHERE p.page_id = o.page_id)::VARCHAR) ELSE 0 END k FROM o)
SELECT s::BIGINT AS shard, page_id, CASE WHEN m THEN 'missing' ELSE 'changed' END AS fault, 1::BIGINT AS records_primary,
       CASE WHEN m THEN NULL WHEN d THEN 2 ELSE 1 END::BIGINT AS records_replica, f::BIGINT AS "offset", n::BIGINT AS length_primary,
       CASE WHEN m THEN NULL WHEN d THEN 2 * k ELSE k END::BIGINT AS length_replica
FROM x WHERE c OR m OR d"""
