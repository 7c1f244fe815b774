"""The long table of cells: one row for each item, service and variant, with a term, a rationale and a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyagree.functions.text import is_empty_rationale, present


def keep_latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key, the last by `order`, which must not leave ties.

    A row number held to 1 is a group limit to Spark, which drops all but the last of a key in each task before the shuffle.
    """
    last = Window.partitionBy(*key).orderBy(*(o.desc_nulls_last() for o in order))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def enforce_pairs(cells: DataFrame) -> DataFrame:
    """A term without a real rationale, and a rationale without a term, become null."""
    term, why = present(F.col("term")), ~is_empty_rationale(F.col("rationale"))
    return cells.withColumns({"term": F.when(term & why, F.col("term")), "rationale": F.when(term & why, F.col("rationale"))})


def fill_merge(parts: list[DataFrame], key: list[str], values: list[str]) -> DataFrame:
    """Parts in order; each value is the first that is not null, in one shuffle."""
    long = reduce(DataFrame.unionByName, (p.select(*key, *values, F.lit(i).alias("__part")) for i, p in enumerate(parts)))
    return fill_in_order(long, key, values, F.col("__part"))


def fill_in_order(rows: DataFrame, key: list[str], values: list[str], order: Column) -> DataFrame:
    """fill_merge() of parts that lie in one table, told apart by `order`; of equal order the least value counts."""
    return rows.groupBy(*key).agg(*(F.min(F.when(F.col(v).isNotNull(), F.struct(order.alias("o"), F.col(v).alias("v"))))["v"].alias(v) for v in values))


def apply_exclusions(cells: DataFrame, tiers: DataFrame, key: list[str], mode: str) -> DataFrame:
    """Terms of excluded cells become null, rows stay. full: none; quality: likely errors; search_ready: complications too."""
    out = {"full": [], "quality": ["likely_error"], "search_ready": ["likely_error", "likely_search_complication"]}[mode]
    if not out:
        return cells
    joined = cells.join(tiers.select(*key, F.col("tier").alias("__tier")).where(F.col("__tier").isin(*out)).dropDuplicates(key), key, "left")
    return joined.withColumn("term", F.when(F.col("__tier").isNull(), F.col("term"))).drop("__tier")


def corrected(cells: DataFrame, corrections: DataFrame, key: list[str]) -> DataFrame:
    return cells.join(corrections.select(*key, F.col("corrected_term").alias("__c")), key, "left").withColumn("term", F.coalesce("__c", "term")).drop("__c")


def compact_errors(log: DataFrame, key: list[str], transient: Column, *order: Column) -> DataFrame:
    """The latest error of each key and kind; transient ones only where the key has no permanent one."""
    latest = keep_latest(log.withColumn("transient", transient), [*key, "transient"], *order)
    lasting = F.max((~F.col("transient")).cast("int")).over(Window.partitionBy(*key))
    return latest.withColumn("__lasting", lasting).where("not transient or __lasting = 0").drop("__lasting")


def snapshot_merge(old: DataFrame, new: DataFrame, key: str, today: str) -> DataFrame:
    """first_seen stays, last_seen moves for rows seen again, rows that went stay as they were."""
    a, b = old.alias("a"), new.select(F.col(key).alias("__k"))
    joined = a.join(b, F.col(f"a.{key}") == F.col("__k"), "full_outer")
    return joined.select(
        F.coalesce(key, "__k").alias(key),
        F.coalesce("first_seen", F.lit(today)).alias("first_seen"),
        F.when(F.col("__k").isNull(), F.col("last_seen")).otherwise(F.lit(today)).alias("last_seen"),
        F.when(F.col(f"a.{key}").isNull(), "added").when(F.col("__k").isNull(), "gone").otherwise("kept").alias("status"),
    )
