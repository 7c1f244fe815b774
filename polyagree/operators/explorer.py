"""Wide tables for reading: what disagrees, how sure each is, what each source said, worst first; and what sources lack."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyagree.functions import text as X
from polyagree.operators import ordering, shaping


def confidences(scores: DataFrame, key: list[str], variant: str, variants: Sequence[str], pools: Sequence[str]) -> DataFrame:
    """(key, mean_<pool> and std_<pool>, mean_agreeing, n_total) over the variants of each key; n_total is that of the first variant that has one.

    scores: key, variant, a confidence for each pool, agreeing_services, total_services.
    """
    parts = [c for p in pools for c in (F.round(F.avg(p), 6).alias(f"mean_{p}"), F.round(F.stddev_samp(p), 6).alias(f"std_{p}"))]
    first = F.min_by("total_services", F.when(F.col("total_services").isNotNull(), ordering.custom(F.col(variant), variants)))
    return scores.groupBy(*key).agg(*parts, F.round(F.avg("agreeing_services"), 6).alias("mean_agreeing"), first.alias("n_total"))


def lengths(cells: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, mean_length): characters of the texts of each key on average; blank and missing ones count as empty, null ones not at all."""
    size = F.when(X.present(F.col(text)), F.char_length(text)).when(F.col(text).isNotNull(), 0)
    return cells.groupBy(*key).agg(F.round(F.avg(size), 1).alias("mean_length"))


def export(base: DataFrame, frames: Sequence[DataFrame], key: list[str], category: str, order: Sequence[str], most: str) -> DataFrame:
    """`base` with the columns of the frames, one row a key each, and `place`: categories in their order, within them the greatest `most` first, then by key.

    Ranks come from ranges of that order, so no task holds all rows.
    """
    for frame in frames:
        base = shaping.keeping_left(base, frame, key)
    places = ordering.ranked(base.select(*key, ordering.custom(F.col(category), order).alias("__c"), F.col(most).alias("__m")), F.asc("__c"), F.desc("__m"), *(F.asc(k) for k in key), name="place")
    return base.join(places.select(*key, "place"), key)


def missing(cells: DataFrame, item: list[str], source: str, sources: Sequence, term: str = "term") -> DataFrame:
    """(item, n_services, missing, tier): the sources that give an item no term in any of its rows, in the order given, and its tier of coverage."""
    has = F.array_compact(F.collect_set(F.when(X.present(F.col(term)), F.col(source).cast("string"))))
    out = cells.groupBy(*item).agg(has.alias("__has"))
    every = F.array(*(F.lit(str(s)) for s in sources))
    n = F.size(F.array_intersect("__has", every))
    tier = F.when(n == 0, "none").when(n <= 2, "sparse").when(n <= 5, "partial").otherwise("rich")
    return out.select(*item, n.alias("n_services"), F.array_join(F.array_except(every, "__has"), "; ").alias("missing"), tier.alias("tier"))
