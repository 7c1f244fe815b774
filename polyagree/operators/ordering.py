"""Orders that are more than a sort: by a group's rate, by a list of values, by chance, and rows dealt evenly over folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyagree.sources.files import stored


def by_group_rate(counts: DataFrame, group: str, label: str, of: str, n: str = "n") -> DataFrame:
    """`counts` (group, label, n) with rate, the group's share of the label `of`, and place, groups of greatest rate first and then by name. Groups are few."""
    rates = counts.groupBy(group).agg((F.sum(F.when(F.col(label) == of, F.col(n)).otherwise(0)) / F.sum(n)).alias("rate"))
    placed = rates.select(group, F.round("rate", 6).alias("rate"), F.row_number().over(Window.orderBy(F.desc("rate"), group)).alias("place"))
    return counts.join(F.broadcast(placed), group)


def reindexed(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Exactly the given values in their order (`place`, from 0), numbers that lack zero; rows of other values go."""
    places = F.posexplode(F.array(*(F.lit(v) for v in values))).alias("place", column)
    frame = rows.sparkSession.range(1).select(places)
    return frame.join(rows, column, "left").na.fill(0)


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """`n` rows by chance, the same for a seed on every run: those of the least digests of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("__d", digest).orderBy("__d", key).limit(n).drop("__d")


def ranked(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """`rows` with their place from 1 in a total order, without all rows in one task.

    Rows are parted by ranges of the order, sorted within, and written with their place there; the sizes of earlier ranges, one row a range, are added.
    End the order with what tells rows apart: ties take any place, and only such an order can part the rows of a hot value.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = stored(placed, "ranges").withColumn("__part", F.shiftright("__id", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(sizes), "__part").withColumn(name, F.col("__before") + inside).drop("__id", "__part", "__before")


def custom(column: Column, values: Sequence[str], otherwise: int = 9) -> Column:
    """The place of a value in a list of one's own, from 0; what is not in it comes at `otherwise`."""
    return F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(v) for v in values)), column).cast("int"), F.lit(0)) - 1, F.lit(otherwise))


def folds(rows: DataFrame, key: str, label: str, n: int, seed: int = 0, name: str = "fold", parts: int = 256) -> DataFrame:
    """`rows` with a fold from 0 to n - 1, dealt in turn within each label, so that a label's rows differ by one at most between folds.

    Rows of a label are numbered in the order of a hash of the seed and the key, in `parts` ranges of the hash: within a range by a window,
    and sums of earlier ranges, `parts` rows a label, are added. No label is in one task; equal keys follow one another. A null label is one too.
    """
    place = F.xxhash64(F.lit(seed), key)
    rows = rows.withColumns({"__h": place, "__part": F.shiftrightunsigned(place, 32).cast("long") * parts / F.lit(2**32)}).withColumn("__part", F.floor("__part").cast("int"))
    inside = Window.partitionBy(label, "__part").orderBy("__h", key)
    before = Window.partitionBy("__l").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(F.col(label).alias("__l"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    base = base.select("__l", "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    numbered = rows.withColumn("__i", F.row_number().over(inside)).join(F.broadcast(base), F.col(label).eqNullSafe(F.col("__l")) & (F.col("__part") == F.col("__p")))
    return numbered.withColumn(name, F.pmod(F.col("__base") + F.col("__i") - 1, F.lit(n)).cast("int")).drop("__h", "__part", "__l", "__p", "__base", "__i")
