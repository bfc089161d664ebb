"""File scans: CSV tables and run results spread over many JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = ("summary struct<pass_rate:double,passed:bigint,failed:bigint,total:bigint>, timing struct<total_duration_seconds:double>, "
       "execution_metrics struct<total_tool_calls:bigint,output_chars:bigint,errors_encountered:bigint>")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema; bad lines are dropped into NULL columns."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", multiLine=False)


def run_results(spark: SparkSession, path: str, file_glob: str = "grading.json") -> DataFrame:
    """Run results below ``eval-*/<config>/run-*``; names come from the file path."""
    df = spark.read.schema(RUN).option("recursiveFileLookup", "true").option("pathGlobFilter", file_glob).option("multiLine", "true").json(path)
    at = r"eval[-=]([^/]+)/(?:config=)?([^/]+)/run[-=]([0-9]+)/"
    p = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(p, at, i)
    return df.select(
        part(1).alias("eval_id"), part(2).alias("config"), part(3).cast("int").alias("run_number"),
        F.coalesce("summary.pass_rate", F.lit(0.0)).alias("pass_rate"), F.coalesce("summary.passed", F.lit(0)).alias("passed"),
        F.coalesce("summary.failed", F.lit(0)).alias("failed"), F.coalesce("summary.total", F.lit(0)).alias("total"),
        F.coalesce("timing.total_duration_seconds", F.lit(0.0)).alias("time_seconds"), F.coalesce("execution_metrics.total_tool_calls", F.lit(0)).alias("tool_calls"),
        F.coalesce("execution_metrics.output_chars", F.lit(0)).alias("tokens"), F.coalesce("execution_metrics.errors_encountered", F.lit(0)).alias("errors"))
