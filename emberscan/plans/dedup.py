"""Duplicates, vectors and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.times import fmt
from ..operators import clusters, dedup, graph, vectors
from .registry import query
from .text import normalise_sql, tokens_sql
from .views import documents, mentions, posts, posts_sql, sql, table, text_hashes


@query("d1_exact_dedup", sql("""
, r AS (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY published_at, external_id) AS rn, count(*) OVER (PARTITION BY source, url) AS copies FROM m)
SELECT source, url, external_id, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS first_seen, copies FROM r WHERE rn = 1"""))
def d1(spark, sf):
    return dedup.first_by_key(mentions(spark, sf), ["source", "url"], ["published_at", "external_id"], ["published_at", "external_id"]).select(
        "source", "url", "external_id", fmt(F.col("published_at")).alias("first_seen"), "copies")


@query("d1_exact_dedup_ttl", sql("""
, a AS (SELECT source, url, epoch_us(published_at) AS us, external_id FROM m),
k AS (SELECT source, url, min(us) AS us FROM a GROUP BY ALL
  UNION ALL SELECT k.source, k.url, n.us FROM k, LATERAL (SELECT min(us) AS us FROM a WHERE a.source = k.source AND a.url = k.url AND a.us >= k.us + 604800000000) n WHERE n.us IS NOT NULL)
SELECT k.source, k.url, k.us, min(external_id) AS external_id FROM k JOIN a USING (source, url, us) GROUP BY ALL""").replace("WITH p AS", "WITH RECURSIVE p AS"))
def d1t(spark, sf):
    """Keys are forgotten seven days after the row that set them."""
    return dedup.first_within_ttl(mentions(spark, sf), ["source", "url"], "published_at", "external_id")


@query("d2_content_dedup_gap", sql(f"""
, t AS (SELECT doc_id, sha1({normalise_sql('text')}) AS h FROM documents),
g AS (SELECT h, external_id, published_at, lag(published_at) OVER (PARTITION BY h ORDER BY published_at) AS prev FROM m JOIN t USING (doc_id))
SELECT h AS text_hash, external_id FROM g WHERE prev IS NULL OR published_at - prev > INTERVAL 6 HOUR"""))
def d2(spark, sf):
    h = text_hashes(spark, sf).select("doc_id", "text_hash")
    rows = mentions(spark, sf).select("doc_id", "published_at", "external_id").join(h, "doc_id")
    return dedup.content_dedup(rows, "text_hash", "published_at", "external_id")


# The permutations of ``dedup.permutation`` as SQL.
SIGS = f"""
WITH tk AS (SELECT doc_id, unnest(list_distinct({tokens_sql('text')})) AS tok FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS h FROM tk),
pm AS (SELECT j, (j + 1) * 715827883 % 2147483647 + 1 AS a, (j + 1) * 1013904223 % {dedup.PRIME} AS b FROM (SELECT unnest(range(128)) AS j)),
mn AS (SELECT doc_id, j, min((a * h + b) % {dedup.PRIME}) AS v FROM h, pm GROUP BY ALL),
sg AS (SELECT d.doc_id, coalesce(s, list_transform(range(128), lambda i: CAST(-1 AS BIGINT))) AS sig, coalesce(n, 0) AS n_tokens FROM documents d
  LEFT JOIN (SELECT doc_id, list(v ORDER BY j) AS s FROM mn GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM h GROUP BY 1) USING (doc_id)),
bd AS (SELECT doc_id, CAST(band AS INTEGER) AS band, md5(array_to_string(sig[band * 4 + 1:band * 4 + 4], ',')) AS band_hash FROM (SELECT *, unnest(range(32)) AS band FROM sg))
"""


def signatures(spark, sf):
    return dedup.minhash(documents(spark, sf), "doc_id", tx.tokens(F.col("text")))


@query("d3_minhash_signatures", SIGS + "SELECT doc_id, array_to_string(sig, ',') AS sig, n_tokens FROM sg")
def d3(spark, sf):
    return signatures(spark, sf).withColumn("sig", F.array_join("sig", ","))


@query("d4_lsh_bands", SIGS + "SELECT doc_id, band, band_hash FROM bd")
def d4(spark, sf):
    return dedup.bands(signatures(spark, sf), "doc_id")


@query("d5_d6_j1_lsh_candidates", SIGS + """
, cl AS (SELECT sig, min(doc_id) AS id, count(*) AS docs FROM sg GROUP BY 1),
sh AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM bd x JOIN bd y USING (band, band_hash) WHERE x.doc_id < y.doc_id AND x.doc_id IN (SELECT id FROM cl) AND y.doc_id IN (SELECT id FROM cl) GROUP BY ALL)
SELECT a, b, p.docs AS docs_a, q.docs AS docs_b, shared, round(len(list_filter(list_zip(p.sig, q.sig), lambda z: z[1] = z[2])) / 128.0, 6) AS jaccard_est
FROM sh JOIN cl p ON p.id = a JOIN cl q ON q.id = b""")
def d5(spark, sf):
    """All pairs of distinct signatures that share one of the 32x4 bands, with their estimated Jaccard."""
    from ..session import cut

    return dedup.candidate_pairs(cut(signatures(spark, sf).select("doc_id", "sig")), "doc_id").withColumn("jaccard_est", F.round("jaccard_est", 6))


GROUPS = f"""
WITH RECURSIVE s AS (SELECT doc_id AS id, list_sort(list_distinct({tokens_sql('text')})) AS t FROM documents),
tk AS (SELECT id, unnest(t) AS tok FROM s),
sz AS (SELECT id, len(t) AS n FROM s),
ov AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM tk a JOIN tk b ON a.tok = b.tok AND a.id < b.id GROUP BY ALL),
e AS (SELECT x, y FROM ov JOIN sz a ON a.id = x JOIN sz b ON b.id = y WHERE c / (a.n + b.n - c) >= 0.85 - 1e-12),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT id AS src, id AS dst FROM s UNION SELECT reach.src, u.y FROM reach JOIN u ON reach.dst = u.x),
comp AS (SELECT src AS id, min(dst) AS component FROM reach GROUP BY 1)
"""


def groups(spark, sf):
    d = documents(spark, sf).select(F.col("doc_id").alias("id"), tx.token_set(F.col("text")).alias("toks"))
    return graph.near_duplicate_groups(d)


@query("d7_c2_near_duplicate_groups", GROUPS + "SELECT id, component FROM comp")
def d7(spark, sf):
    return groups(spark, sf)


SHINGLES = f"""list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN length(j) >= 2 THEN list_transform(range(1, length(j)), lambda i: substr(j, i, 2)) WHEN length(j) = 1 THEN [j] ELSE [] END))"""


@query("d7_shingle_groups", GROUPS.replace(
    f"s AS (SELECT doc_id AS id, list_sort(list_distinct({tokens_sql('text')})) AS t FROM documents)",
    f"w AS (SELECT doc_id AS id, {tokens_sql('text')} AS w FROM documents), s AS (SELECT id, {SHINGLES} AS t FROM (SELECT id, w, array_to_string(w, ' ') AS j FROM w))")
    + "SELECT id, component FROM comp")
def d7s(spark, sf):
    """The same groups on shingles of five words."""
    w = documents(spark, sf).select(F.col("doc_id").alias("id"), tx.tokens(F.col("text")).alias("w"))
    d = w.select("id", tx.shingles(F.col("w")).alias("toks"))  # inside the lambda the words must be a column, or they are cut again for each shingle
    return graph.near_duplicate_groups(d)


@query("d8_keep_earliest", GROUPS + "SELECT id, CASE WHEN id = component THEN NULL ELSE component END AS dup_of FROM comp")
def d8(spark, sf):
    return groups(spark, sf).select("id", F.nullif("component", "id").alias("dup_of"))


@query("d9_url_rule", sql("""
, w AS (SELECT url, source, count(DISTINCT author_id) AS authors, first(external_id ORDER BY published_at, external_id) AS keeper FROM m GROUP BY ALL),
n AS (SELECT url, count(*) AS n_sources FROM w GROUP BY 1)
SELECT external_id, n_sources >= 3 AS boost, CASE WHEN NOT n_sources >= 3 AND authors > 1 AND external_id <> keeper THEN keeper END AS dup_of
FROM m JOIN w USING (url, source) JOIN n USING (url)"""))
def d9(spark, sf):
    return dedup.url_rule(mentions(spark, sf))


@query("d10_repost_collapse", sql(posts_sql() + """
, q AS (SELECT external_id, reply_to, CASE WHEN external_id % 3 = 1 THEN '' ELSE text END AS text FROM po),
a AS (SELECT reply_to AS external_id, count(*) AS c FROM q WHERE text = '' AND reply_to IS NOT NULL GROUP BY 1)
SELECT external_id, coalesce(c, 0) AS amplification_count FROM q LEFT JOIN a USING (external_id) WHERE NOT (text = '' AND reply_to IS NOT NULL)"""))
def d10(spark, sf):
    p = posts(spark, sf).withColumn("text", F.when(F.col("external_id") % 3 == 1, "").otherwise(F.col("text")))
    return dedup.collapse_reposts(p).select("external_id", "amplification_count")


@query("d11_semantic_duplicates", """
, p AS (SELECT a.vec_id, b.vec_id AS duplicate_of, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c
  FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id)
SELECT vec_id, first(duplicate_of ORDER BY c DESC, duplicate_of) AS duplicate_of, round(max(c), 6) AS cosine FROM p WHERE c >= 0.4 GROUP BY 1""".replace(", p AS", "WITH p AS", 1))
def d11(spark, sf):
    """Cosine 0.4 instead of 0.92: the vectors of the tables are nearly orthogonal."""
    return vectors.semantic_duplicates(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.4).withColumn("cosine", F.round("cosine", 6))


@query("d12_dedup_ratio", sql("""
, g AS (SELECT source, doc_id, count(*) AS n FROM m GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS kept, round(1 - count(*) / sum(n), 6) AS ratio, 1 - count(*) / sum(n) > 0.7 AS suspicious FROM g GROUP BY 1"""))
def d12(spark, sf):
    return dedup.dedup_ratio(mentions(spark, sf), ["source", "doc_id"]).withColumn("ratio", F.round("ratio", 6))


@query("d13_stable_cluster_id", f"""
WITH d AS (SELECT doc_id, 'cl_' || substr(sha1(substr({normalise_sql('text')}, 1, 200)), 1, 12) AS cluster_id, sha1({normalise_sql('text')}) AS h FROM documents)
SELECT cluster_id, count(*) AS docs, count(DISTINCT h) AS texts FROM d GROUP BY 1""")
def d13(spark, sf):
    """Id from the first 200 normalised characters; ``texts`` > 1 shows shared ids."""
    n = tx.normalise(F.col("text"))
    d = documents(spark, sf).select(
        F.concat(F.lit("cl_"), F.substring(F.sha1(F.substring(n, 1, 200)), 1, 12)).alias("cluster_id"), F.sha1(n).alias("h"))
    return d.groupBy("cluster_id").agg(F.count("*").alias("docs"), F.count_distinct("h").alias("texts"))


@query("d14_keyed_merge", sql("""
, r AS (SELECT author_id, external_id, CASE WHEN external_id % 3 = 0 THEN source END AS venue, CASE WHEN external_id % 4 = 0 THEN '' ELSE community END AS title,
   CASE WHEN external_id % 5 = 0 THEN reach END AS reach FROM m)
SELECT author_id, arg_min(venue, external_id) FILTER (venue IS NOT NULL AND venue <> '') AS venue, arg_min(title, external_id) FILTER (title IS NOT NULL AND title <> '') AS title,
  arg_min(reach, external_id) FILTER (reach IS NOT NULL) AS reach, count(*) - 1 AS duplicates FROM r GROUP BY 1"""))
def d14(spark, sf):
    i = F.col("external_id")
    r = mentions(spark, sf).select(
        "author_id", "external_id", F.when(i % 3 == 0, F.col("source")).alias("venue"),
        F.when(i % 4 == 0, "").otherwise(F.col("community")).alias("title"), F.when(i % 5 == 0, F.col("reach")).alias("reach"))
    return dedup.merge_keyed(r, "author_id", "external_id", ["venue", "title", "reach"])


@query("d14_expanded_seeds", sql("""
SELECT DISTINCT author_id AS paper, reply_to AS seed FROM m WHERE reply_to IS NOT NULL"""))
def d14s(spark, sf):
    """Set union of the seeds named by the merged items, as rows and not as one list."""
    return mentions(spark, sf).where("reply_to is not null").select(F.col("author_id").alias("paper"), F.col("reply_to").alias("seed")).distinct()


@query("d15_simhash_distinct", f"""
WITH tk AS (SELECT doc_id, unnest(list_distinct({tokens_sql('text')})) AS tok FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS h0, ('0x' || substr(md5(tok), 9, 8))::BIGINT AS h1 FROM tk),
b AS (SELECT doc_id, i, sum(CASE WHEN (CASE WHEN i < 32 THEN h0 >> i ELSE h1 >> (i - 32) END) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS one FROM h, (SELECT unnest(range(64)) AS i) GROUP BY ALL),
s AS (SELECT doc_id, string_agg(CASE WHEN one THEN '1' ELSE '0' END, '' ORDER BY i DESC) AS bits FROM b GROUP BY 1),
n AS (SELECT x.doc_id FROM s x WHERE EXISTS (SELECT 1 FROM s y WHERE y.doc_id < x.doc_id AND hamming(x.bits, y.bits) <= 3))
SELECT source, count(*) AS docs, count(DISTINCT bits) AS distinct_contents, count(n.doc_id) AS near_copies FROM documents d JOIN s USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY 1""")
def d15(spark, sf):
    """Per source: documents, distinct SimHashes, and documents within three bits of an earlier one.

    Documents without tokens have no SimHash but count as documents; the SQL leaves them out.
    """
    from ..session import cut

    s = cut(dedup.simhash(documents(spark, sf), "doc_id", tx.tokens(F.col("text"))))
    near = dedup.near_simhashes(s, "doc_id").withColumn("near", F.lit(1))
    d = documents(spark, sf).select("doc_id", "source").join(s, "doc_id", "left").join(near, "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.count_distinct("bits").alias("distinct_contents"), F.count("near").alias("near_copies"))


# ---- vectors ---------------------------------------------------------------------------
def embedding_sql(text: str, sizes: tuple[int, ...], signed: bool, padded: bool) -> str:
    """Hashed n-grams of a text expression, as the normalised vector in millionths."""
    ready = f"CASE WHEN {text} = '' THEN '' ELSE ' ' || {text} || ' ' END" if padded else text
    grams = []
    for n in sizes:
        h = "2166136261"
        for j in range(n):
            h = f"(xor({h}, c[i + {j}]) * 16777619 % 4294967296)"
        grams.append(f"SELECT doc_id, {h} AS h FROM (SELECT doc_id, c, unnest(range(1, len(c) - {n} + 2)) AS i FROM c)")
    sign = "CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END" if signed else "1"
    return f"""
WITH t AS (SELECT doc_id, {text} AS x FROM documents),
c AS (SELECT doc_id, list_transform(string_split(x, ''), lambda z: CAST(unicode(z) AS BIGINT)) AS c FROM (SELECT doc_id, {ready.replace(text, 'x')} AS x FROM t) WHERE x <> ''),
g AS ({' UNION ALL '.join(grams)}),
w AS (SELECT doc_id, h % 384 AS pos, sum({sign}) AS w FROM g GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1),
v AS (SELECT doc_id, pos, w / n AS x FROM w JOIN n USING (doc_id) WHERE n > 0)
SELECT doc_id, array_to_string(list(CAST(round(coalesce(x, 0) * 1000000) AS BIGINT) ORDER BY p.pos), ',') AS embedding
FROM (SELECT doc_id, pos FROM documents, (SELECT unnest(range(384)) AS pos)) p LEFT JOIN v USING (doc_id, pos) GROUP BY doc_id"""


def _millionths(col):
    return F.array_join(F.transform(col, lambda x: F.round(x * 1000000).cast("bigint")), ",")


@query("e1_embed_signed", embedding_sql(f"trim(regexp_replace(regexp_replace(lower(text), 'https?://{tx.NON_SPACE}+', ' ', 'g'), '{tx.SPACE}+', ' ', 'g'))", (3, 4), True, False))
def e1(spark, sf):
    return documents(spark, sf).select("doc_id", _millionths(vectors.embed_text(F.col("text"), double=True)).alias("embedding"))


@query("e2_embed_padded", embedding_sql(normalise_sql("text"), (3,), False, True))
def e2(spark, sf):
    return documents(spark, sf).select("doc_id", _millionths(vectors.embed_text(F.col("text"), "padded", True)).alias("embedding"))


@query("e3_cosine_to_centroid", """
WITH c AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL),
a AS (SELECT label, list(x ORDER BY pos) AS c FROM c GROUP BY 1)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 6) AS cosine FROM embeddings JOIN a USING (label)""")
def e3(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.join(vectors.centroids(e, "label"), "label").select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("centroid")), 6).alias("cosine"))


@query("e4_centroids", """
WITH c AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL)
SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM c""")
def e4(spark, sf):
    c = vectors.centroids(table(spark, sf, "embeddings"), "label")
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("e5_nearest_clusters", """
WITH c AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL),
a AS (SELECT label, list(x ORDER BY pos) AS c FROM c GROUP BY 1),
s AS (SELECT vec_id, CAST(a.label AS BIGINT) AS cluster, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS s FROM embeddings, a),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cluster) AS rank FROM s WHERE s >= 0.1)
SELECT vec_id, cluster, round(s, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def e5(spark, sf):
    """Five nearest cluster centroids per vector. Cosine floor 0.1 for these vectors."""
    e = table(spark, sf, "embeddings")
    # Negative ids keep cluster ids apart from vector ids.
    c = vectors.centroids(e, "label").select((-1 - F.col("label")).cast("bigint").alias("vec_id"), F.col("centroid").alias("embedding"))
    q = e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    near = vectors.nearest(q, c, 10, 0.1, "vec_id", "embedding")
    w_rank = near.select("vec_id", (-1 - F.col("neighbour")).alias("cluster"), "cosine")
    from pyspark.sql import Window

    w = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "cluster")
    return w_rank.withColumn("rank", F.row_number().over(w)).where("rank <= 5").withColumn("cosine", F.round("cosine", 6))


@query("e5_recent_clusters", """
WITH e AS (SELECT vec_id, embedding, label, vec_id % 400 AS hour FROM embeddings),
l AS (SELECT CAST(label AS BIGINT) AS cluster, max(hour) FILTER (vec_id % 3 = 0 AND hour < label * 40) AS last_hour FROM e GROUP BY 1),
c AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL),
a AS (SELECT label, list(x ORDER BY pos) AS c FROM c GROUP BY 1),
s AS (SELECT vec_id, hour, CAST(a.label AS BIGINT) AS cluster, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS s FROM e, a),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cluster) AS rank FROM s WHERE s >= 0.1)
SELECT vec_id, cluster, round(s, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM r JOIN l USING (cluster) WHERE rank <= 5 AND hour - last_hour <= 168""")
def e5r(spark, sf):
    """Of the five nearest clusters those whose last post is at most seven days back. The tables hold no times of vectors: hours are made from ids."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("cluster"), (F.col("vec_id") % 400).alias("hour"))
    at = F.timestamp_seconds(F.col("hour") * 3600)
    seen = e.where("vec_id % 3 = 0 and hour < cluster * 40").groupBy("cluster").agg(F.max(at).alias("last_seen"))
    return vectors.seen_recently(e5(spark, sf), e.select("vec_id", at.alias("published_at")), seen, "vec_id")


@query("e6_centroid_drift", """
WITH r AS (SELECT label, embedding, row_number() OVER w AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
x AS (SELECT label, CASE WHEN rn = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - rn) END AS w, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM r)
SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(sum(w * x), 6) AS x FROM x GROUP BY ALL""")
def e6(spark, sf):
    d = vectors.drift(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    return d.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("c1_leader_clusters")
def c1(spark, sf):
    return clusters.leader_clusters(documents(spark, sf).select(F.col("doc_id").alias("id"), "text"))
