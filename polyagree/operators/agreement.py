"""Plurality agreement among services: how many give the same term, within a variant, across variants, and in pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plurality(cells: DataFrame, key: list[str], voter: str = "service", term: str = "term", **carried: Column) -> DataFrame:
    """best_candidate, confidence, total_services, agreeing_services, unique_candidates for each key; ties go to the first voter, then to the least term.

    Two levels: cells by key and term, combined before the shuffle, then terms by key. `carried`: aggregates over the cells of the
    best candidate, by the names they get.
    """
    counts = cells.where(F.col(term).isNotNull() & (F.col(term) != "")).groupBy(*key, term).agg(F.count("*").alias("n"), F.min(voter).alias("first_voter"), *(c.alias(name) for name, c in carried.items()))
    best = F.struct((-F.col("n")).alias("n"), "first_voter", term)
    out = counts.groupBy(*key).agg(F.min_by(F.struct(F.col(term).alias("best_candidate"), *carried), best).alias("best"), F.max("n").alias("agreeing_services"), F.sum("n").alias("total_services"), F.count("*").alias("unique_candidates"))
    return out.select(*key, "best.*", "agreeing_services", "total_services", "unique_candidates", F.round(F.col("agreeing_services") / F.col("total_services"), 4).alias("confidence"))


def distribution(cells: DataFrame, key: list[str], term: str = "term") -> DataFrame:
    """(key, distribution): the terms of each key with their numbers, most first, as `term (n); term (n)`."""
    counts = cells.where(F.col(term).isNotNull() & (F.col(term) != "")).groupBy(*key, term).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), term, F.format_string("%s (%d)", term, "n").alias("x"))))
    return counts.groupBy(*key).agg(F.array_join(listed.getField("x"), "; ").alias("distribution"))


def spread(rows: DataFrame, key: list[str], value: str, digits: int = 6) -> DataFrame:
    """n, mean, median, sample deviation and variation of a value."""
    d = F.stddev_samp(value)
    return rows.groupBy(*key).agg(F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean"), F.round(F.percentile(value, F.lit(0.5)), digits).alias("median"), F.round(d, digits).alias("std"), F.round(F.when(F.avg(value) != 0, d / F.avg(value)), digits).alias("cv"))


def pairwise(cells: DataFrame, item: list[str], voter: str = "service", term: str = "term", by: Sequence[str] = ()) -> DataFrame:
    """For each pair of voters: items both name, items they name alike, and the rate. Joined on the item; voters are few. `by`: columns of the item to count by."""
    a = cells.where(F.col(term).isNotNull()).select(*item, F.col(voter).alias("a"), F.col(term).alias("ta"))
    b = a.withColumnsRenamed({"a": "b", "ta": "tb"})
    both = a.join(b, item).where("a < b").groupBy(*by, "a", "b").agg(F.count("*").alias("shared"), F.count_if(F.col("ta") == F.col("tb")).alias("alike"))
    return both.withColumn("rate", F.round(F.col("alike") / F.col("shared"), 6))


def standard_residuals(counts: DataFrame, row: str, column: str, n: str = "n") -> DataFrame:
    """Expected counts from the margins, and (observed - expected) / sqrt(expected). Sums by small windows of counts."""
    rows = counts.groupBy(row).agg(F.sum(n).alias("__r"))
    columns = counts.groupBy(column).agg(F.sum(n).alias("__c"))
    total = counts.agg(F.sum(n).cast("double").alias("__t"))  # one row
    joined = counts.join(rows, row).join(columns, column).crossJoin(F.broadcast(total))
    expected = F.col("__r") * F.col("__c") / F.col("__t")
    return joined.withColumns({"expected": F.round(expected, 6), "residual": F.round((F.col(n) - expected) / F.sqrt(expected), 6)}).drop("__r", "__c", "__t")


def grid(rows: DataFrame, *columns: str) -> DataFrame:
    """Counts over all combinations of the columns' values, zero where there is none. For columns of few values."""
    dims = [rows.select(c).distinct() for c in columns]
    full = dims[0]
    for d in dims[1:]:
        full = full.crossJoin(d)
    return full.join(rows.groupBy(*columns).agg(F.count("*").alias("n")), list(columns), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def similarity_matrix(pairs: DataFrame, voters: DataFrame) -> DataFrame:
    """pairwise() both ways round and with each voter beside itself: a, b, rate. voters: a."""
    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "rate")
    return pairs.select("a", "b", "rate").unionByName(turned).unionByName(voters.select("a", F.col("a").alias("b"), F.lit(1.0).alias("rate")))


def mean_ranks(rows: DataFrame, column: str, name: str, parts: int = 256, by: Sequence[str] = (), n: str | None = None) -> DataFrame:
    """(by, column, name): the mean rank of each value among all rows, or those of its group, without all values of one in one task. Groups are few. With `n`, a row stands for that many.

    Values are parted at about equal quantiles; sums of earlier parts, `parts` rows, are added to the running count within a part.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg((F.sum(n) if n else F.count("*")).alias("__n"))
    quantiles = F.percentile_approx(column, [i / parts for i in range(1, parts)], 10000).alias("__edges")
    edges = F.broadcast(counts.groupBy(*by).agg(quantiles))  # one row, or one a group
    counts = counts.join(edges, [*by]) if by else counts.crossJoin(edges)
    counts = counts.withColumn("__part", F.size(F.filter("__edges", lambda e: e < F.col(column)))).drop("__edges")
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy(*by, "__part").agg(F.sum("__n").alias("__s")).select(*by, "__part", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*by, "__part").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("__upto", F.sum("__n").over(inside)).join(F.broadcast(base), [*by, "__part"])
    return ranked.select(*by, column, (F.col("__base") + F.col("__upto") - (F.col("__n") - 1) / 2).alias(name))
