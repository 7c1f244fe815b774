"""How definitions are phrased: registers and glosses of rationales by patterns, over services and variants, beside flags of review."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyagree.functions import text as X


def marked(rows: DataFrame, text: str, registers: Mapping[str, Sequence[str]], **unions: Sequence[str]) -> DataFrame:
    """`rows` that have a text, with a truth value for each register, whose patterns are looked for in any case; `unions`: any of several registers."""
    rows = rows.where(X.present(F.col(text))).withColumns({name: X.says(F.col(text), patterns) for name, patterns in registers.items()})
    return rows.withColumns({name: F.greatest(*(F.col(p) for p in parts)) for name, parts in unions.items()}) if unions else rows


def prevalence(rows: DataFrame, by: list[str], names: Sequence[str]) -> DataFrame:
    """(by, n, a percentage for each register) of marked()."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(100 * F.count_if(n) / F.count("*"), 1).alias(n) for n in names))


def asymmetry(rows: DataFrame, by: list[str], one: str, other: str) -> DataFrame:
    """(by, n, both percentages, gap): how much oftener one component is glossed than the other, in points, of rounded percentages."""
    return prevalence(rows, by, [one, other]).withColumn("gap", F.round(F.col(one) - F.col(other), 1))


def by_variant(rows: DataFrame, service: str, variant: str, names: Sequence[str], base: str) -> DataFrame:
    """(service, variant, register, n, percent, effect): the effect is the percentage less that of the service's base variant, null where it has none.

    One aggregate, and one of its few rows; the texts are read once.
    """
    table = prevalence(rows, [service, variant], names).unpivot([service, variant, "n"], list(names), "register", "percent")
    start = table.where(F.col(variant) == base).select(service, "register", F.col("percent").alias("__base"))
    return table.join(F.broadcast(start), [service, "register"], "left").select(service, variant, "register", "n", "percent", F.round(F.col("percent") - F.col("__base"), 1).alias("effect"))


def flags_by(rows: DataFrame, flags: str, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, register, with_n, without_n, with_mean, without_mean, difference) of a number of flags, null counting as none, over texts of a register and the others."""
    long = rows.withColumn("__f", F.coalesce(flags, F.lit(0))).unpivot([*by, "__f"], list(names), "register", "has").groupBy(*by, "register")
    mean = lambda c: F.avg(F.when(c, F.col("__f")))
    yes, no = F.col("has"), ~F.col("has")
    return long.agg(
        F.count_if(yes).alias("with_n"), F.count_if(no).alias("without_n"), F.round(mean(yes), 6).alias("with_mean"), F.round(mean(no), 6).alias("without_mean"),
        F.round(mean(yes) - mean(no), 6).alias("difference"),
    )
