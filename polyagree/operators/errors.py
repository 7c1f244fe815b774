"""Errors of services by kind: beside signals, by keys that several services fail on, and by how refusals begin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyagree.functions.text import opening


def signals_by_kind(signals: DataFrame, errors: DataFrame, key: Sequence[str], names: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """(signal, kind, n): keys that have both, zero where none has, for at most 63 signals and kinds each.

    signals: key, signal. errors: key, kind. What a key has is one number a table, a bit for each name, so the join sees a key once a side,
    and keys are counted by their two numbers before these are taken apart.
    """
    bit = lambda column, of: F.call_function("shiftleft", F.lit(1).cast("long"), F.array_position(F.array(*map(F.lit, of)), F.col(column)).cast("int") - 1)
    a = signals.where(F.col("signal").isin(*names)).groupBy(*key).agg(F.bit_or(bit("signal", names)).alias("__s"))
    b = errors.where(F.col("kind").isin(*kinds)).groupBy(*key).agg(F.bit_or(bit("kind", kinds)).alias("__k"))
    both = a.join(b, [*key]).groupBy("__s", "__k").agg(F.count("*").alias("m"))
    every = F.array(*(F.struct(F.lit(x).alias("signal"), F.lit(y).alias("kind"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i, x in enumerate(names) for j, y in enumerate(kinds)))
    held = lambda mask, at: F.expr(f"getbit({mask}, x.{at})") == 1
    found = both.select("__s", "__k", "m", F.explode(every).alias("x")).where(held("__s", "i") & held("__k", "j")).groupBy("x.signal", "x.kind").agg(F.sum("m").alias("n"))
    full = errors.sparkSession.range(1).select(F.inline(every)).drop("i", "j")
    return full.join(F.broadcast(found), ["signal", "kind"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def several_services(errors: DataFrame, key: Sequence[str], service: str, kind: Column, honest: Column, least: int = 2) -> DataFrame:
    """(key, n_services, services, n_honest, honest): keys on which `least` services or more fail by `kind`, and those that refuse honestly but do not fail so. Services of a key are few."""
    failed, told = F.collect_set(F.when(kind, F.col(service))), F.collect_set(F.when(honest, F.col(service)))
    out = errors.groupBy(*key).agg(F.array_sort(failed).alias("__f"), F.array_sort(told).alias("__h")).where(F.size("__f") >= least)
    out = out.withColumn("__h", F.array_except("__h", "__f"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select(*key, F.size("__f").alias("n_services"), text("__f").alias("services"), F.size("__h").alias("n_honest"), text("__h").alias("honest"))


def openings(messages: DataFrame, by: Sequence[str], message: Column, words: int = 8, top: int = 8) -> DataFrame:
    """(by, rank, opening, n, share, cumulative): the most frequent first words of messages of each group, with shares of all its messages.

    Messages are counted by opening before anything is ordered; of a group only `top` openings reach its window, as ranks are cut within
    partitions first. Ties go by the opening.
    """
    counts = messages.select(*by, opening(message, words).alias("opening")).where("opening is not null").groupBy(*by, "opening").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__all"))
    down = Window.partitionBy(*by).orderBy(F.desc("n"), "opening")
    best = counts.withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= top)
    running = F.sum("n").over(Window.partitionBy(*by).orderBy("rank"))
    return best.withColumn("__sum", running).join(totals, [*by]).select(*by, "rank", "opening", "n", F.round(F.col("n") / F.col("__all"), 6).alias("share"), F.round(F.col("__sum") / F.col("__all"), 6).alias("cumulative"))
