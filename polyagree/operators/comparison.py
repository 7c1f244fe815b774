"""Comparing runs and services: differences of agreement, influence, anchors, what is kept of the source, what a step costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyagree.functions import text as X
from polyagree.operators import agreement


def deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, rate, other, delta): agreement of the pairs that both runs have, and the first run's less the other's."""
    both = a.select("a", "b", "rate").join(b.select("a", "b", F.col("rate").alias("other")), ["a", "b"])
    return both.withColumn("delta", F.round(F.col("rate") - F.col("other"), 6))


def influence(pairs: DataFrame) -> DataFrame:
    """(service, agreement, rank): the mean rate at which the others agree with each service, most first; equal means share a rank. Voters are few."""
    each = pairs.select(F.explode(F.array("a", "b")).alias("service"), "rate").groupBy("service").agg(F.round(F.avg("rate"), 6).alias("agreement"))
    return each.withColumn("rank", F.rank().over(Window.orderBy(F.desc("agreement"))))


def agreement_by(cells: DataFrame, item: list[str], by: list[str]) -> DataFrame:
    """(by, pairs, items, agreement): the mean over pairs of services of how often they agree, for each group of items; `by` is among the columns of `item`."""
    each = agreement.pairwise(cells, item, by=by).groupBy(*by).agg(F.count("*").alias("pairs"), F.round(F.avg("rate"), 6).alias("agreement"))
    return cells.groupBy(*by).agg(F.count_distinct(*item).alias("items")).join(each, by)


def anchored_spread(items: DataFrame, anchored: DataFrame, key: list[str], value: str) -> DataFrame:
    """(anchored, n, mean, median, std, cv) of a value of items, by whether the item is among the `anchored` ones."""
    flags = anchored.select(*key).distinct().withColumn("anchored", F.lit(True))
    return agreement.spread(items.join(flags, key, "left").withColumn("anchored", F.coalesce("anchored", F.lit(False))), ["anchored"], value)


def retention(cells: DataFrame, by: list[str], term: str, source: str) -> DataFrame:
    """(by, n, exact, inside, by_word): of the cells with a term, the shares that are the source term, that hold one of its words
    anywhere but are not it, and that have one of its words as a word but are not it; case does not count."""
    low, words = F.lower(X.stripped(F.col(term))), sorted(set(source.lower().split()))
    exact = low == source.lower()
    inside = F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, w))
    by_word = F.arrays_overlap(X.words(low), F.array(*(F.lit(w) for w in words)))
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return cells.where(X.present(F.col(term))).groupBy(*by).agg(F.count("*").alias("n"), share(exact).alias("exact"), share(~exact & inside).alias("inside"), share(~exact & by_word).alias("by_word"))


def impact(rows: DataFrame, service: str, item: list[str], before: Column, after: Column) -> DataFrame:
    """(service, covered, still, lost): items that a service covers before a step, after it, and before but not after."""
    each = rows.groupBy(service, *item).agg(F.bool_or(before).alias("b"), F.bool_or(after).alias("a"))
    return each.groupBy(service).agg(F.count_if("b").alias("covered"), F.count_if("a").alias("still"), F.count_if(F.col("b") & ~F.col("a")).alias("lost"))


def synthesis(cells: DataFrame, item: list[str], variant: str, service: str = "service") -> DataFrame:
    """One row a variant: cells, its services' mean, least and greatest coverage in items, mean confidence and mean number of candidates."""
    covered = cells.where(X.present(F.col("term"))).groupBy(variant, service).agg(F.count_distinct(*item).alias("items"), F.count("*").alias("cells"))
    wide = covered.groupBy(variant).agg(F.sum("cells").alias("cells"), F.round(F.avg("items"), 6).alias("mean_coverage"), F.min("items").alias("least_coverage"), F.max("items").alias("most_coverage"))
    best = agreement.plurality(cells, [*item, variant], service).groupBy(variant).agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg("unique_candidates"), 6).alias("candidates"))
    return wide.join(best, variant)


def correlations(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, pearson, spearman) of two numbers, over all rows or for each group; rows that lack one of them don't count.

    Rows become counts of pairs of values first, so ranks meet each pair once and not each row. Sums are taken around the means, which
    keeps their digits. A correlation is null where a number does not vary. Groups are few.
    """
    number = lambda c: F.col(c).cast("double")
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, number(x).alias("x"), number(y).alias("y")).agg(F.count("*").alias("n"))
    ranked = pairs
    for c in ("x", "y"):
        ranked = ranked.join(agreement.mean_ranks(pairs, c, f"r{c}", by=by, n="n"), [*by, c])
    names = ("x", "y", "rx", "ry")
    group = ranked.groupBy(*by)
    means = group.agg(*((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"m{c}") for c in names))
    off = lambda c: F.col(c) - F.col(f"m{c}")
    around = ranked.join(F.broadcast(means), [*by]) if by else ranked.crossJoin(F.broadcast(means))
    together = lambda a, b: F.sum(F.col("n") * off(a) * off(b)) / F.nullif(F.sqrt(F.sum(F.col("n") * off(a) ** 2)) * F.sqrt(F.sum(F.col("n") * off(b) ** 2)), F.lit(0.0))
    return around.groupBy(*by).agg(F.sum("n").alias("n"), F.round(together("x", "y"), 6).alias("pearson"), F.round(together("rx", "ry"), 6).alias("spearman"))
