"""A training corpus from raw documents, in stages that are each written and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the next stage's documents. ``run`` applies them to ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscan.llm import crf_quality, debruijn, decontaminate, hamming_join, packing
from emberscan.llm.stage import written
from emberscan.session import prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores below its limit go."""
    prepare(spark)
    field = crf_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return crf_quality.quality(docs, field).where(F.col("score") >= crf_quality.LIMIT).drop("score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays. Rows without id stay, as do rows that repeat the id that stays."""
    prepare(spark)
    gone = hamming_join.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside a window of 20 words that occurs earlier in the corpus go; n_chars follows the text."""
    prepare(spark)
    kept = debruijn.kept_texts(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    prepare(spark)
    marked = decontaminate.with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where("__mask is null").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 ids."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_spans", repeated_spans), ("decontamination", decontamination), ("packing", pack)]

#: The fitted field of the first stage can't be said in SQL; tests/llm holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
