"""Exact quantiles of groups of any size, by counts in ranges that are refined around the ranks sought.

A group of few rows is sorted in one buffer. Of a larger one a pass draws some range edges from an approximate sketch, counts rows
in the ranges exactly, before the shuffle already, and keeps of each rank only the range that it lies in. The least value is an edge of its own, so each
pass takes something off, and as edges lie at about equal counts a range shrinks by their number: a billion rows take four or five passes. No buffer
grows with a group, and a value that fills a whole range is found at once.

Cases: null values are left out, and a group without others has no row; NaN is greater than any number; a null in the group's columns is a value; between two ranks the quantile is
interpolated; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyagree.sources.files import stored


def quantiles(rows: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, float], most: int = 1 << 16, parts: int = 32) -> DataFrame:
    """(by, names of `wanted`): the quantiles of a value in each group, exact. `most`: rows of a group that are sorted in one buffer."""
    group = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("all"))
    rows = rows.where(F.col(value).isNotNull()).select(group.alias("g"), F.col(value).cast("double").alias("v"))
    sizes = stored(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    in_one = rows.groupBy("g").agg(*(F.percentile("v", F.lit(q)).alias(name) for name, q in wanted.items()))
    large = sizes.where(F.col("n") > most)
    names = [F.col(f"g.{c}").alias(c) for c in by]
    if not large.limit(1).count():
        return in_one.select(*names, *wanted)
    few = rows.join(sizes.where(F.col("n") <= most).select("g"), "g", "left_semi").groupBy("g").agg(*(F.percentile("v", F.lit(q)).alias(name) for name, q in wanted.items()))
    return few.unionByName(_refined(rows, large, wanted, parts)).select(*names, *wanted)


def _refined(rows: DataFrame, large: DataFrame, wanted: Mapping[str, float], parts: int) -> DataFrame:
    place = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in wanted.items()}
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p).cast("long"), F.ceil(p).cast("long")) for p in place.values()))))
    found = stored(large.select("g", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("base")), "ranks")
    shares = [i / parts for i in range(1, parts)]
    span = ["g", "lo", "hi"]
    while found.where("lo < hi").limit(1).count():
        open_ = found.where("lo < hi")
        spans = open_.select(*span, "base").distinct()
        inside = rows.join(spans, (rows.g == spans.g) & rows.v.between(F.col("lo"), F.col("hi"))).select(spans.g, "lo", "hi", "base", "v")
        edges = inside.groupBy(*span).agg(F.percentile_approx("v", shares, F.lit(10000)).alias("e"))
        edges = stored(edges.select(*span, F.array_sort(F.array_union(F.array("lo"), "e")).alias("e")), "edges")
        counted = inside.join(edges, span).groupBy(*span, "base", F.size(F.filter("e", lambda x: x < F.col("v"))).alias("range"))
        counted = counted.agg(F.count("*").alias("c"), F.min("v").alias("from"), F.max("v").alias("to"))
        before = Window.partitionBy(*span).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # parts + 1 rows at most
        counted = counted.withColumn("before", F.col("base") + F.coalesce(F.sum("c").over(before), F.lit(0))).drop("base")
        hit = open_.join(counted, span).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c")))
        found = stored(found.where("not lo < hi").unionByName(hit.select("g", "rank", F.col("from").alias("lo"), F.col("to").alias("hi"), F.col("before").alias("base"))), "ranks")
    at = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at"))  # two ranks a quantile at most
    both = large.join(at, "g")
    value_at = lambda p: F.col("at")[p.cast("long")]
    return both.select("g", *((value_at(F.floor(p)) + F.when(F.ceil(p) > F.floor(p), (value_at(F.ceil(p)) - value_at(F.floor(p))) * (p - F.floor(p))).otherwise(0.0)).alias(name) for name, p in place.items()))
