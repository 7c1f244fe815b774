"""Coverage of items by sources as bitmaps: a bit for each source, combinations counted once, and all else from these counts.

Sources are few (62 at most, else ValueError); items are any number. One pass makes a mask for each item and one counts masks, of
which there are no more than combinations that occur. Overlap, union, verification, expansion and what one source alone has are sums over that
small table.

Cases: a null source or item is left out; an item named twice by a source counts once; items without a source have mask 0 and count only where all items are given;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyagree.sources.files import stored

MOST = 62


class Coverage:
    """Counts of masks of `members` (item, source); `items` has all items, those without a source too."""

    def __init__(self, members: DataFrame, item: str, source: str, items: DataFrame | None = None):
        members = members.where(F.col(item).isNotNull() & F.col(source).isNotNull()).select(F.col(item).alias("item"), F.col(source).alias("source"))
        self.sources = sorted(r[0] for r in members.select("source").distinct().limit(MOST + 1).collect())
        if len(self.sources) > MOST:
            raise ValueError(f"more than {MOST} sources")
        bit = F.lit(0).cast("long")
        for i, s in enumerate(self.sources):
            bit = F.when(F.col("source") == F.lit(s), F.lit(1 << i).cast("long")).otherwise(bit)
        self.kind = members.schema["source"].dataType
        masks = members.groupBy("item").agg(F.bit_or(bit).alias("mask"))
        if items is not None:
            every = items.where(F.col(item).isNotNull()).select(F.col(item).alias("item")).distinct()
            masks = every.join(masks, "item", "left").select("item", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
        self.counts = stored(masks.groupBy("mask").agg(F.count("*").alias("n")), "masks")

    def _each(self, name: str) -> Column:
        """Sources with the mask of each."""
        return F.explode(F.array(*(F.struct(F.lit(s).cast(self.kind).alias("source"), F.lit(1 << i).cast("long").alias("bit")) for i, s in enumerate(self.sources)))).alias(name)

    def _sum(self, hit: Column) -> Column:
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))

    def depth(self) -> DataFrame:
        """(n_sources, items, share): how many items so many sources have."""
        total = F.broadcast(self.counts.agg(F.sum("n").alias("total")))  # one row
        rows = self.counts.groupBy(F.bit_count("mask").alias("n_sources")).agg(F.sum("n").alias("items"))
        return rows.crossJoin(total).select("n_sources", "items", F.round(F.col("items") / F.col("total"), 6).alias("share"))

    def pairs(self) -> DataFrame:
        """(a, b, both, either, share): items that both sources have, that one of them has, and the share of a's that b has too; each with itself as well."""
        if not self.sources:
            return self.counts.select(F.lit(None).cast(self.kind).alias("a"), F.lit(None).cast(self.kind).alias("b"), F.lit(0).cast("long").alias("both"), F.lit(0).cast("long").alias("either"), F.lit(0.0).alias("share")).limit(0)
        rows = self.counts.where("mask <> 0").select("mask", "n", self._each("x")).select("*", self._each("y"))
        has = lambda name: F.col("mask").bitwiseAND(F.col(f"{name}.bit")) != 0
        out = rows.groupBy(F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(self._sum(has("x") & has("y")).alias("both"), self._sum(has("x") | has("y")).alias("either"), self._sum(has("x")).alias("own"))
        return out.select("a", "b", "both", "either", F.round(F.col("both") / F.col("own"), 6).alias("share"))

    def against(self, reference) -> DataFrame:
        """(source, covered, verified, expanded, verification, expansion): what each other source shares with the reference, and what it adds."""
        if reference not in self.sources:
            raise ValueError(f"no source {reference!r}")
        own, ref = F.col("mask").bitwiseAND(F.col("x.bit")) != 0, F.col("mask").bitwiseAND(F.lit(1 << self.sources.index(reference)).cast("long")) != 0
        rows = self.counts.select("mask", "n", self._each("x")).where(F.col("x.source") != F.lit(reference))
        out = rows.groupBy(F.col("x.source").alias("source")).agg(self._sum(own).alias("covered"), self._sum(own & ref).alias("verified"), self._sum(own & ~ref).alias("expanded"))
        return out.withColumns({"verification": F.round(F.col("verified") / F.col("covered"), 6), "expansion": F.round(F.col("expanded") / F.col("covered"), 6)})

    def sole(self) -> DataFrame:
        """(source, covered, sole, share): items that no other source has."""
        if not self.sources:
            return self.counts.select(F.lit(None).cast(self.kind).alias("source"), F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("sole"), F.lit(0.0).alias("share")).limit(0)
        rows = self.counts.select("mask", "n", self._each("x"))
        own = F.col("mask").bitwiseAND(F.col("x.bit")) != 0
        out = rows.groupBy(F.col("x.source").alias("source")).agg(self._sum(own).alias("covered"), self._sum(F.col("mask") == F.col("x.bit")).alias("sole"))
        return out.withColumn("share", F.round(F.col("sole") / F.col("covered"), 6))
