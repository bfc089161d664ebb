"""URL filter: rules first, then a tree of path templates for each host.

A rule is (host, path, verdict); it fits its host and all subdomains if the
URL's path begins with the rule's, and the longest rule wins. The pages that
rules decide are the labelled examples for the rest: paths are read as a tree
under their host, variable segments become wildcards, and sibling branches
whose labels do not differ statistically share their counts. The purity of a
node, its share of allowed examples, is smoothed towards that of its parent;
a host's towards that of all hosts, and that towards one half. So a branch
without examples is judged by the nearest part of its host that has some, and
a host without any by all hosts. A template is rejected if its purity is
below one half.

The tree is built on counts of distinct (host, path shape), never on pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import written

# The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Depth of the tree; deeper segments are one wildcard.
DEPTH = 8
#: Children of a node beyond which they are values of a variable.
CHILDREN = 32
#: Pseudo-examples of the smoothing, the share of allowed ones behind all hosts, least smoothed purity, and the z-score from which branches differ.
WEIGHT, PRIOR, PURITY, DIFFERENT = 2.0, 0.5, 0.5, 1.96

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return (F.translate(F.coalesce(F.regexp_extract(rest, "^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER),
            F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")))


def _rule(host: Column, path: Column, rules, pick) -> Column:
    out = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(pick(h, p, verdict))).otherwise(out)
    return out


def _segments(path: Column) -> Column:
    """Segments that are not empty; one with a digit is a value."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s))


def _templates(shapes: DataFrame) -> tuple[DataFrame, int]:
    """(host, shape, known, good, nodes, template) and the depth: ``nodes`` are the tree's nodes from the host's child down to the shape's own."""
    depth = min(DEPTH, shapes.agg(F.max(F.size("segs"))).first()[0] or 0)
    cur = shapes.withColumn("prefix", F.lit("")).withColumn("nodes", F.array().cast("array<string>"))
    for d in range(1, depth + 1):
        seg = F.get("segs", F.lit(d - 1))
        children = cur.where(seg.isNotNull()).groupBy("host", "prefix", seg.alias("seg")).agg(F.sum("n").alias("n"))
        wide = children.groupBy("host", "prefix").agg(F.count("*").alias("k")).where(F.col("k") > CHILDREN).select("host", "prefix", F.lit(True).alias("wide"))
        step = F.concat("prefix", F.lit("/"), F.when(F.col("wide"), F.lit("*")).otherwise(seg))
        cur = written(cur.join(wide, ["host", "prefix"], "left").withColumn("prefix", F.coalesce(step, F.col("prefix"))).withColumn(
            "nodes", F.when(seg.isNotNull(), F.concat("nodes", F.array("prefix"))).otherwise(F.col("nodes"))).drop("wide"), "tree")
    template = F.when(F.size("segs") > depth, F.concat("prefix", F.lit("/**"))).otherwise(F.col("prefix"))
    return cur.select("host", "shape", "known", "good", "nodes", template.alias("template")), depth


def _pooled(nodes: DataFrame) -> DataFrame:
    """``nodes`` (host, parent, node, known, good) with the counts of the siblings that do not differ from them.

    Siblings with examples are read in order of their share; a group ends where
    the next differs from the one before by a two-proportion test.
    """
    # Siblings are few: more than CHILDREN of them have become one wildcard.
    order = Window.partitionBy("host", "parent", F.col("known") > 0).orderBy(F.col("good") / F.greatest("known", F.lit(1)), "node")
    last = lambda c: F.lag(c).over(order)
    both = (F.col("good") + last("good")) / (F.col("known") + last("known"))
    spread = F.sqrt(both * (1 - both) * (1 / F.col("known") + 1 / last("known")))
    apart = F.abs(F.col("good") / F.col("known") - last("good") / last("known")) > DIFFERENT * spread
    steps = nodes.withColumn("new", F.when(F.col("known") == 0, 1).otherwise(F.coalesce(apart, F.lit(True)).cast("int")))
    pool = Window.partitionBy("host", "parent", F.col("known") > 0, "group")
    return steps.withColumn("group", F.sum("new").over(order)).select(
        "host", "parent", "node", F.sum("known").over(pool).alias("known"), F.sum("good").over(pool).alias("good"))


def _verdicts(shapes: DataFrame) -> DataFrame:
    """(host, shape, template, learnt) from shapes with ``n`` pages, of which ``known`` are examples and ``good`` allowed ones."""
    placed, depth = _templates(shapes)
    placed = written(placed, "templates")
    seen = placed.agg(F.sum("good"), F.sum("known")).first()
    pure = lambda prior: (F.col("good") + WEIGHT * prior) / (F.col("known") + WEIGHT)
    overall = ((seen[0] or 0) + WEIGHT * PRIOR) / ((seen[1] or 0) + WEIGHT)
    levels = [placed.groupBy("host").agg(F.sum("known").alias("known"), F.sum("good").alias("good")).select("host", F.lit("").alias("node"), pure(F.lit(overall)).alias("purity"))]
    for d in range(depth):
        here = placed.where(F.size("nodes") > d).groupBy("host", F.get("nodes", F.lit(d)).alias("node"), F.coalesce(F.get("nodes", F.lit(d - 1)), F.lit("")).alias("parent")).agg(
            F.sum("known").alias("known"), F.sum("good").alias("good"))
        above = levels[-1].select("host", F.col("node").alias("parent"), F.col("purity").alias("prior"))
        levels.append(written(_pooled(here).join(above, ["host", "parent"]).select("host", "node", pure(F.col("prior")).alias("purity")), "purity"))
    judged = levels[0]
    for level in levels[1:]:
        judged = judged.union(level)
    mine = placed.select("host", "shape", "template", F.coalesce(F.try_element_at("nodes", F.lit(-1)), F.lit("")).alias("node"))
    return mine.join(judged, ["host", "node"]).select("host", "shape", "template", F.when(F.col("purity") >= PURITY, "allow").otherwise("block").alias("learnt"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every page.

    ``rule`` is the rule's host and path (null: none fits). A null or odd url
    has an empty host and path and is judged as such. Repeated rows are judged
    alike; other columns are ignored. Without rules, or where none fits any
    page, every purity is one half and every template allowed.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    segs = _segments(F.col("path"))
    base = base.withColumn("rule", _rule(F.col("host"), F.col("path"), rules, lambda h, p, v: h + p)).withColumn(
        "said", _rule(F.col("host"), F.col("path"), rules, lambda h, p, v: v)).withColumn("shape", F.concat_ws("/", segs))
    shapes = written(base.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("said").alias("known"), F.count_if(F.col("said") == "allow").alias("good"))
                     .withColumn("segs", F.filter(F.split("shape", "/"), lambda s: s != "")), "shapes")
    learnt = written(_verdicts(shapes), "verdicts")
    return base.join(learnt, ["host", "shape"], "left").select("page_id", "host", "path", "rule", F.coalesce("said", "learnt").alias("verdict"), "template")
