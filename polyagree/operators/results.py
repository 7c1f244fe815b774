"""What searches find: results beside the terms that found them, by kind, direction and category of terms, by language and family.

results: kind, id, search_term; one id may come by many terms. terms: search_term, one row each, with its languages as delimited text.
Terms meet without case and white space at their edges; results of other terms than those given don't count. Kinds are few and given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyagree.functions import text as X
from polyagree.operators import shaping


def _low(column: str) -> Column:
    return F.lower(X.stripped(F.col(column)))


def of_terms(results: DataFrame, terms: DataFrame) -> DataFrame:
    """(kind, id, term) of the results whose term, made comparable, is among the terms; repeats stay, as does a null id."""
    return results.select("kind", "id", _low("search_term").alias("term")).join(terms.select(_low("search_term").alias("term")), "term", "left_semi")


def found_by(results: DataFrame, terms: DataFrame) -> DataFrame:
    """(kind, term, ids): how many different ids each term finds. Ids are made distinct first, so a term's many ids lie in many tasks."""
    return of_terms(results, terms).where("id is not null").distinct().groupBy("kind", "term").agg(F.count("*").alias("ids"))


def repeats(results: DataFrame, terms: DataFrame) -> DataFrame:
    """(kind, raw_rows, unique_items, terms_that_hit, avg_term_hits): how often an item is found on average."""
    rows = of_terms(results, terms).groupBy("kind", "id", "term").agg(F.count("*").alias("n"))
    ids = rows.groupBy("kind", "id").agg(F.sum("n").alias("n"))
    ids = ids.groupBy("kind").agg(F.sum("n").alias("raw_rows"), F.count("id").alias("unique_items"))
    names = rows.select("kind", "term").distinct().groupBy("kind").agg(F.count("term").alias("terms_that_hit"))
    return ids.join(names, "kind").withColumn("avg_term_hits", F.round(F.col("raw_rows") / F.nullif("unique_items", F.lit(0)), 1))


def hits(results: DataFrame, terms: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """`terms` with `term`, n_<kind> for each kind, total and any_hit; a term that finds nothing has zeros."""
    counts = found_by(results, terms).where(F.col("kind").isin(*kinds)).groupBy("term").agg(*(F.sum(F.when(F.col("kind") == k, F.col("ids"))).alias(f"n_{k}") for k in kinds))
    names = [f"n_{k}" for k in kinds]
    out = terms.withColumn("term", _low("search_term")).join(counts, "term", "left").na.fill(0, names)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return out.withColumns({"total": total, "any_hit": total > 0})


def productivity(found: DataFrame, by: str) -> DataFrame:
    """(by, total_terms, terms_with_hits, total_results, hit_rate_pct, avg_per_hit) of hits(); the average is null where no term hits."""
    out = found.groupBy(by).agg(F.count("*").alias("total_terms"), F.count_if("any_hit").alias("terms_with_hits"), F.sum("total").alias("total_results"))
    return out.withColumns({"hit_rate_pct": F.round(100 * F.col("terms_with_hits") / F.col("total_terms"), 1), "avg_per_hit": F.round(F.col("total_results") / F.nullif("terms_with_hits", F.lit(0)), 1)})


def primary(category: Column, separator: str = ",") -> Column:
    """The first of delimited categories."""
    return F.trim(F.split_part(category, F.lit(separator), F.lit(1)))


def languages_of(terms: DataFrame, languages: str = "natural_language") -> DataFrame:
    """(term, language): a row for each language of each term."""
    return shaping.delimited(terms.select(_low("search_term").alias("term"), F.col(languages).alias("language")), "language").distinct()


def added_value(results: DataFrame, terms: DataFrame, first: str, major: Sequence[str], languages: str = "natural_language") -> DataFrame:
    """A row a kind: ids found by terms of the first language, by those of major ones, by all, what all add to each, and their shares in percent.

    What finds an id becomes two flags of the term, so ids are counted by one aggregate and no sets of ids are compared.
    """
    flags = languages_of(terms, languages).groupBy("term").agg(F.bool_or(F.col("language") == first).alias("first"), F.bool_or(F.col("language").isin(first, *major)).alias("major"))
    ids = of_terms(results, terms).where("id is not null").join(flags, "term", "left")
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    ids = ids.groupBy("kind", "id").agg(has("first"), has("major")).groupBy("kind")
    out = ids.agg(F.count_if("first").alias("first_only"), F.count_if("major").alias("major_only"), F.count("*").alias("full"))
    share = lambda c: F.round(100 * F.col(c) / F.col("full"), 1)
    return out.withColumns({"added_over_first": F.col("full") - F.col("first_only"), "added_over_major": F.col("full") - F.col("major_only"), "first_pct": share("first_only"), "major_pct": share("major_only")})


def reached(results: DataFrame, terms: DataFrame, groups: DataFrame, kinds: Sequence[str], first: str, major: Sequence[str], group: str = "family", languages: str = "natural_language") -> DataFrame:
    """(group, n_<kind> for each kind, total, unique, reach) of groups of languages: `groups` (language, group), where a language may be its own group.

    An id counts once for a group and kind. `unique`: ids that no term of the first language finds. reach: `first` where the group has an id of a
    term of the first language, `major` where of a major one only, else `multilingual only`. Groups of languages are few and go to all tasks; a
    term has its groups as a list and an id those of its terms, so there is no shuffle by language and none with a row for each id and group.
    """
    found = of_terms(results, terms).where("id is not null").distinct()
    named = languages_of(terms, languages)
    few = F.broadcast(groups.select("language", group).distinct())
    facts = named.join(few, "language", "left").groupBy("term").agg(
        F.bool_or(F.col("language") == first).alias("f"), F.bool_or(F.col("language").isin(first, *major)).alias("m"), F.array_sort(F.collect_set(group)).alias("__groups")
    )
    ids = found.join(facts, "term").groupBy("kind", "id").agg(F.bool_or("f").alias("f"), F.bool_or("m").alias("m"), F.collect_set("__groups").alias("__groups"))
    each = ids.select("kind", "id", "f", "m", F.explode(F.array_distinct(F.flatten("__groups"))).alias(group))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds]
    out = each.where(F.col("kind").isin(*kinds)).groupBy(group).agg(*counts, F.count("*").alias("total"), F.count_if(~F.col("f")).alias("unique"), F.bool_or("f").alias("f"), F.bool_or("m").alias("m"))
    return out.select(group, *(f"n_{k}" for k in kinds), "total", "unique", F.when(F.col("f"), "first").when(F.col("m"), "major").otherwise("multilingual only").alias("reach"))
