"""How the terms of an item differ: all pairs of its different spellings in one fold, over pools of sources in one pass.

An item's spellings are a set, so a pair of equal terms costs nothing and no row is made for any pair. A hot item has as many spellings as
differ, not as many as cells.

Cases: null terms are left out; one term or none is `no_differences`, more of one spelling `all_identical`; else the kinds that occur, in order, joined by
commas. A null direction counts as left to right; of several directions of an item, right to left counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyagree.functions import text as X
from polyagree.operators import agreement


def kinds(terms: Column, rtl: Column) -> Column:
    """The kinds of difference among the pairs of an array's terms, each once, in order; equal ones are none."""
    pairs = F.flatten(F.transform(terms, lambda a, i: F.transform(F.slice(terms, i + 2, F.size(terms)), lambda b: X.difference(a, b, rtl))))
    return F.array_sort(F.array_remove(F.array_distinct(pairs), "identical"))


def summary(n: Column, terms: Column, rtl: Column) -> Column:
    """From the number of cells with a term and the set of terms."""
    return F.when(n <= 1, "no_differences").when(F.size(terms) <= 1, "all_identical").otherwise(F.array_join(kinds(terms, rtl), ","))


def summarised(cells: DataFrame, key: Sequence[str], term: str = "term", rtl: Column | None = None) -> DataFrame:
    """(key, n_terms, n_spellings, differences) of each key."""
    side = F.coalesce(F.bool_or(rtl if rtl is not None else F.lit(False)), F.lit(False))
    sets = cells.groupBy(*key).agg(F.count(term).alias("n_terms"), F.array_sort(F.collect_set(term)).alias("__terms"), side.alias("__rtl"))
    return sets.select(*key, "n_terms", F.size("__terms").alias("n_spellings"), summary(F.col("n_terms"), F.col("__terms"), F.col("__rtl")).alias("differences"))


def pooled(cells: DataFrame, pools: Mapping[str, Column]) -> DataFrame:
    """A row of each cell for each pool that it belongs to (`pool`)."""
    return cells.withColumn("pool", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in pools.items())))))


def agreement_by_pool(cells: DataFrame, key: Sequence[str], pools: Mapping[str, Column], voter: str = "service", term: str = "term", rtl: Column | None = None) -> DataFrame:
    """(key, pool) with the plurality of the pool's terms and how they differ."""
    rows = pooled(cells if rtl is None else cells.withColumn("__side", rtl), pools)
    by = [*key, "pool"]
    side = None if rtl is None else F.col("__side")
    said = summarised(rows, by, term, side).select(*(F.col(c).alias(f"__{c}") for c in by), "n_spellings", "differences")
    best = agreement.plurality(rows, by, voter, term)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return best.join(said, same).drop(*(f"__{c}" for c in by))
