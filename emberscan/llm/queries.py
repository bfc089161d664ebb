"""The registered query of every operator of this folder, and its SQL where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import ann_lsh, crf_quality, debruijn, decontaminate, filter_audit, fixity, hamming_join, licences, packing, signature_trees, url_templates, vector_codes, wavelet
from .words import documents


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_crf_quality(spark, sf):
    """Every document scored by a field fitted on the labels that are not held out."""
    docs = _table(spark, sf, "documents")
    field = crf_quality.fit(docs, _table(spark, sf, "labels"))
    return crf_quality.quality(documents(docs), field).select(
        "doc_id", crf_quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= crf_quality.LIMIT).cast("int").alias("predicted"))


def op2_multiprobe_lsh(spark, sf):
    """The five nearest vectors of every vector whose id 50 divides."""
    return ann_lsh.nearest(_table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_debruijn_spans(spark, sf):
    """Words of every document that lie in a window of 20 words seen earlier."""
    return debruijn.repeated_spans(_table(spark, sf, "documents")).drop("mask")


def op4_hamming_near_duplicates(spark, sf):
    """Components of documents whose shingle sets are similar by 0.8 or more."""
    return hamming_join.near_duplicates(_table(spark, sf, "documents"))


def op5_best_two_fit(spark, sf):
    """All documents packed into sequences of at most 2048 ids."""
    return packing.pack(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_decontaminate(spark, sf):
    """Documents that hold windows of benchmark items."""
    return decontaminate.contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op7_merkle_fixity(spark, sf):
    """Records of all pages against a replica with planted faults: what the audit locates."""
    pages = _table(spark, sf, "pages")
    return fixity.audit(pages, fixity.damaged(pages))


def op8_wavelet_tokens(spark, sf):
    """Token files of all documents, and their index as read back from the files."""
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    wavelet.write_tokens(_table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return wavelet.read_index(spark, path)


def op9_url_templates(spark, sf):
    """Every page's url judged by the rules, and else by its path template."""
    return url_templates.judge(_table(spark, sf, "pages")).drop("template")


def op10_licence_scan(spark, sf):
    """The best licence notice of every document."""
    return licences.licence_scan(_table(spark, sf, "documents"))


def op10_licence_windows(spark, sf):
    """The run of words of every document that is most like a licence notice or text."""
    return licences.notice_scan(_table(spark, sf, "documents"))


def op11_adaptive_bounds(spark, sf):
    """Every vector coded by codebooks of its 16 parts."""
    return vector_codes.vector_codes(_table(spark, sf, "embeddings"))


def op12_filter_audit(spark, sf):
    """Five filters in all their orders: what each step keeps, removes and loses in every source."""
    return filter_audit.interaction_audit(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op13_signature_trees(spark, sf):
    """Components of documents whose shingle sets are similar by 0.85 or more."""
    return signature_trees.jaccard_components(_table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_crf_quality, op2_multiprobe_lsh, op3_debruijn_spans, op4_hamming_near_duplicates, op5_best_two_fit, op6_decontaminate,
    op7_merkle_fixity, op8_wavelet_tokens, op9_url_templates, op10_licence_scan, op10_licence_windows,
    op11_adaptive_bounds, op12_filter_audit, op13_signature_trees)}

_BLANK = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _near_sql(percent: int, kept: str = "") -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_BLANK}) w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) s FROM d),
n AS (SELECT doc_id, count(*) n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= {percent} * (a.n + b.n - k)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, u.y FROM reach JOIN u ON u.x = reach.r),
c AS (SELECT doc_id, min(r) c FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id{kept} FROM c LEFT JOIN n USING (doc_id)"""


ORACLES = {
    "op3_debruijn_spans": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK}) w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) s FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) r FROM win) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) g FROM (SELECT doc_id, unnest(range(s, s + 20)) p FROM rep) GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) n, coalesce(len(g), 0) r,
                list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: g IS NULL OR NOT list_contains(g, x[2])) k FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(list_transform(k, lambda x: x[1]), ' ')) AS kept_sha256 FROM kept""",
    "op4_hamming_near_duplicates": _near_sql(80, ", c = c.doc_id AS kept"),
    "op6_decontaminate": f"""
WITH i AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) s FROM i)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) w FROM documents),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, s, n FROM dw JOIN iw USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT p) c FROM (SELECT doc_id, unnest(range(s, s + n)) p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) c, string_agg(i, ',' ORDER BY i) l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR i FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.c, 0)::BIGINT AS n_hit, coalesce(it.c, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(hit.c, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op7_merkle_fixity": fixity.ORACLE,
    "op10_licence_scan": licences.oracle(),
    "op11_adaptive_bounds": vector_codes.oracle(),
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_signature_trees": _near_sql(85),
}
