"""General table jobs: pivot, run statistics, counts, ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params

_METHODS = {"sum": F.sum, "count": F.count, "average": F.avg, "min": F.min, "max": F.max}


def pivot(df: DataFrame, rows: list[str], column: str, values: list, measures: list[tuple[str, str]]) -> DataFrame:
    """Rows by column values; missing cells are zero, results have two decimals."""
    aggs = [F.round(_METHODS[how](c).cast("double"), 2).alias(f"{c}_{how}") for c, how in measures]
    return df.groupBy(*rows).pivot(column, values).agg(*aggs).na.fill(0)


def run_statistics(df: DataFrame, config: str, metric: str) -> DataFrame:
    """Mean, sample deviation (0 for one run), minimum and maximum per configuration."""
    r = lambda c: F.round(c, 4)
    return df.groupBy(config).agg(
        r(F.avg(metric)).alias("mean"), r(F.coalesce(F.stddev_samp(metric), F.lit(0.0))).alias("stddev"),
        r(F.min(metric)).alias("min"), r(F.max(metric)).alias("max"), F.count("*").alias("runs"))


def run_delta(stats: DataFrame, config: str) -> DataFrame:
    """Difference of means of the first two configurations."""
    two = stats.orderBy(config).limit(2).agg(F.min_by("mean", config).alias("a"), F.max_by("mean", config).alias("b"))
    return two.select(F.round(F.col("a") - F.col("b"), 4).alias("delta"))


def count_by_year(df: DataFrame, year: str, title: str) -> DataFrame:
    key = F.coalesce(F.nullif(F.col(year).cast("string"), F.lit("")), F.lit("unknown"))
    return df.groupBy(key.alias("year")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(title), F.lit("")) == "").alias("missing_title"))


def mastery(results: DataFrame, key: str, order: str, score: str, chunk: int = 1024) -> DataFrame:
    """Level, weakness and next review interval per key from ordered scores.

    Level starts at 1, goes up on a score of 0.6 or more (at most 3) and down
    otherwise (at least 1). A step is ``clamp(x + d, 1, 3)``, and such functions
    are closed under composition, so each slice of ``order`` is folded on its own
    to (shift, low, high) and the slices are composed afterwards: a key with very
    many results is never one list. Weakness is set or cleared by the latest
    result that does either. The review stage is the run of passes at the end.
    """
    ok = F.col(score) >= 0.6
    rows = results.where(F.col(score).isNotNull()).select(key, order, score, F.when(ok, 1).otherwise(-1).alias("d"), F.floor(F.col(order) / chunk).alias("slice"))

    def compose(items):
        first = F.struct(F.lit(0).alias("s"), F.lit(1).alias("lo"), F.lit(3).alias("hi"))
        fit = lambda v, x: F.least(x["hi"], F.greatest(x["lo"], v + x["s"]))
        return F.aggregate(items, first, lambda f, x: F.struct(
            (f["s"] + x["s"]).alias("s"), fit(f["lo"], x).alias("lo"), fit(f["hi"], x).alias("hi")))

    step = F.struct(order, F.col("d").alias("s"), F.lit(1).alias("lo"), F.lit(3).alias("hi"))
    inner = F.transform(F.array_sort(F.collect_list(step)), lambda x: F.struct(x["s"].alias("s"), x["lo"].alias("lo"), x["hi"].alias("hi")))
    per = rows.groupBy(key, "slice").agg(
        compose(inner).alias("f"), F.count("*").alias("n"), F.min_by(score, order).alias("first"), F.max_by(score, order).alias("last"),
        F.max(F.when(F.col("d") < 0, F.col(order))).alias("last_fail"))
    w = Window.partitionBy(key, "slice").orderBy(order)
    prev = F.lag(score).over(w)
    edge = per.select(key, "slice", F.lag("last").over(Window.partitionBy(key).orderBy("slice")).alias("carry"))
    pair = rows.withColumn("prev", prev).join(edge, [key, "slice"]).withColumn("prev", F.coalesce("prev", "carry"))
    cur = F.col(score)
    flag = F.when((cur < 0.6) & (F.col("prev") < 0.6), True).when(cur < 0.5, True).when((cur >= 0.8) & (F.col("prev") >= 0.8), False)
    weak = pair.withColumn("flag", flag).where("flag is not null").groupBy(key).agg(F.max_by("flag", order).alias("weak"))
    whole = per.groupBy(key).agg(
        compose(F.transform(F.array_sort(F.collect_list(F.struct("slice", "f"))), lambda x: x["f"])).alias("f"),
        F.sum("n").alias("attempts"), F.max("last_fail").alias("last_fail"))
    passes = rows.join(whole.select(key, "last_fail"), key).where(F.col("last_fail").isNull() | (F.col(order) > F.col("last_fail"))).groupBy(key).agg(F.count("*").alias("streak"))
    out = whole.join(weak, key, "left").join(passes, key, "left")
    level = F.least(F.col("f.hi"), F.greatest(F.col("f.lo"), F.lit(1) + F.col("f.s")))
    stage = F.least(F.lit(len(params.REVIEW_DAYS) - 1), F.coalesce("streak", F.lit(0)))
    return out.select(key, "attempts", level.alias("level"), F.coalesce("weak", F.lit(False)).alias("is_weak"),
                      F.get(F.array(*[F.lit(d) for d in params.REVIEW_DAYS]), stage.cast("int")).alias("review_days"))
