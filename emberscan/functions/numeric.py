"""Arithmetic used by many operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Round half up towards +infinity, to a BIGINT."""
    return F.floor(x + F.lit(0.5))


def js_round2(x: Column) -> Column:
    """Round half up to two decimals."""
    return js_round(x * 100) / F.lit(100.0)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clamp01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as DOUBLE, NULL for a zero denominator."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def xlog2x(c: Column) -> Column:
    """``c * log2(c)`` with the usual 0 for ``c = 0``."""
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def entropy(total: Column, sum_xlog2x: Column, classes: Column) -> Column:
    """Shannon entropy over ``classes`` bins, scaled to 0..1.

    Uses ``H = log2(T) - sum(c*log2 c)/T``, so the inputs are plain sums and the
    aggregation combines on the map side.
    """
    h = F.log2(total.cast("double")) - sum_xlog2x / total
    return h / F.log2(classes.cast("double"))


def ordered_mean(counted: Column, field: str) -> Column:
    """Mean of ``field`` over ARRAY<STRUCT<..., n>>, every struct ``n`` times; null values do not count.

    Values are added one after another in sorted order. A plain average adds up
    the sums of partitions, whose last bit depends on how rows lie in files, and
    a threshold on the mean of equal values turns on that bit.
    """
    rows = F.array_sort(F.filter(counted, lambda r: r[field].isNotNull()))
    total = F.aggregate(rows, F.lit(0.0), lambda s, r: F.aggregate(F.sequence(F.lit(1).cast("bigint"), r["n"]), s, lambda t, _: t + r[field]))
    return total / F.nullif(F.aggregate(rows, F.lit(0).cast("bigint"), lambda s, r: s + r["n"]), F.lit(0).cast("bigint"))


def fixed1(x: Column) -> Column:
    """Non-negative ``x`` with one decimal as text, rounded on its exact binary value.

    The whole part is taken off first, which is exact, so 39.05 (a little less
    than that in binary) gives 39.0.
    """
    whole = F.floor(x)
    n = whole * 10 + js_round((x - whole) * 10)
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))
