"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Each document has an exponential key, -ln(u) / weight, with u from a hash of its id and the weight its quality: what is left
of 1 by symbols, repeated lines, repeated words and words of an odd length. Within a source, documents are taken in order of
the key until the source's budget of words is met. A budget above the source's size first takes complete epochs of it; the
rest is the fractional selection.

No source is sorted. Keys fall into BUCKETS bins, whose word counts by source are summed before they shuffle; a prefix sum
over bins finds the bin in which the budget ends, that bin is parted again in the same way, and only the documents of the
small bin that is found last are put in order. What results is one row for each source, so the choice on a document needs its
own row and its source's. Targets are found by windows over one row for each source, and never on the driver.

Cases: null text has no words; a null source is one, last; a null doc_id is an id; repeated rows count each and share their
fate, also at the cut, where a source then exceeds its budget by the repeats of one document; empty tables give empty results;
other columns stay untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .quality_rules import SYMBOLS, let, words_of

WEIGHTS, MOST_EPOCHS, BUCKETS, SEED = (5, 2, 1), 3, 4096, 20
LEAST_WEIGHT = 0.05


def n_words(text: Column) -> Column:
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")


def size_and_weight(text: Column) -> Column:
    """Struct of size (words) and weight, LEAST_WEIGHT to 1: the product of the shares of characters that are no symbols, of lines
    that repeat no earlier one, of the mean of 1 and the share of distinct words, and of 1 for words of 3 to 10 characters on average."""
    text = F.coalesce(text, F.lit(""))
    part = lambda n, of: n / F.greatest(of, F.lit(1))
    clean = 1 - part(F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, "")), F.length(text))
    lines = let(F.split(text, "\n"), lambda x: part(F.size(F.array_distinct(x)), F.size(x)))

    def of(w: Column) -> Column:
        n = F.size(w)
        mean = part(F.length(F.array_join(w, "")), n)
        usual = F.least(F.lit(1.0), mean / 3, 10 / F.greatest(mean, F.lit(1.0)))
        weight = F.greatest(F.lit(LEAST_WEIGHT), clean * lines * (0.5 + 0.5 * part(F.size(F.array_distinct(w)), n)) * usual)
        return F.struct(n.cast("long").alias("size"), weight.alias("weight"))

    return let(words_of(text), of)


def exponential_key(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(u) / weight


def bin_of(key: Column, level: int) -> Column:
    """Bins that rise with the key, about as full as one another; of a further level, within those of the one before."""
    place = F.least(F.floor((1 - F.exp(-key)) * float(BUCKETS ** (level + 1))), F.lit(BUCKETS ** (level + 1) - 1))
    return place if level == 0 else place % BUCKETS


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """`sizes` (source, source_size) with target: all words shared by weight, what is above `most` times a size shared anew among the others.

    Sources stand in order of size by weight: those above their limit come first, and each is above it by what the ones before
    leave. One row a source, so one task does it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    all_of_it = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sizes.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(by_name) - 1) % len(weights)))
    before = F.coalesce(F.sum("source_size").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("unit", (F.sum("source_size").over(all_of_it) - most * before) / weight_left)
    rows = rows.withColumn("full", F.col("unit") * F.col("weight") > most * F.col("source_size"))
    unit = F.min(F.when(~F.col("full"), F.struct((F.col("source_size") / F.col("weight")).alias("room"), "unit"))).over(all_of_it)["unit"]
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("source_size") * float(most)).otherwise(unit * F.col("weight")).alias("target"))


def _end(binned: DataFrame, budgets: DataFrame) -> DataFrame:
    """source_, end (bin) and rest: the bin of each source in which its budget ends, and the words of it that are in."""
    up_to = Window.partitionBy("source_").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = binned.withColumnRenamed("source", "source_").withColumn("upto", F.sum("words").over(up_to))
    ends = ends.join(budgets, F.col("source_").eqNullSafe(F.col("source")))
    ends = ends.where((F.col("upto") >= F.col("budget")) & (F.col("upto") - F.col("words") < F.col("budget")))
    return ends.select("source_", F.col("bin").alias("end"), (F.col("budget") - F.col("upto") + F.col("words")).alias("rest"))


def _bins(rows: DataFrame, level: int) -> DataFrame:
    return rows.groupBy("source", bin_of(F.col("key"), level).alias("bin")).agg(F.sum("size").alias("words"))


def plan(sized: DataFrame) -> DataFrame:
    """A row for each source: source_size, target, epochs, and where its fractional selection ends (cut_key, cut_id, cut_words).

    sized: doc_id, source, size, key.
    """
    binned = shared.staged(_bins(sized, 0), "bins")
    table = targets(binned.groupBy("source").agg(F.sum("words").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_EPOCHS))).otherwise(0).cast("int")
    table = table.withColumn("epochs", epochs)
    rest = F.least(F.rint(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"), "source_size")
    table = shared.staged(table.withColumn("budget", F.when(F.col("epochs") < MOST_EPOCHS, rest).otherwise(F.lit(0).cast("long"))), "targets")
    inside, budgets = sized.where("size > 0"), table.select("source", "budget")
    for level in (0, 1):
        ends = _end(binned, budgets)
        here = (F.col("source").eqNullSafe(F.col("source_"))) & (bin_of(F.col("key"), level) == F.col("end"))
        inside = shared.staged(inside.join(ends, here).drop("source_", "end", "rest"), "end-bins")
        budgets = shared.staged(ends.select(F.col("source_").alias("source"), F.col("rest").alias("budget")), "budgets")
        binned = _bins(inside, 1)
    in_order = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("upto", F.sum("size").over(in_order)).join(budgets.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")))
    last = last.where((F.col("upto") >= F.col("budget")) & (F.col("upto") - F.col("size") < F.col("budget")))
    last = last.select("source_", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), (F.col("budget") - F.col("upto") + F.col("size")).alias("cut_words"))
    return shared.staged(table.drop("budget").join(last, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_"), "plan")


def before_cut(doc_id: Column, key: Column) -> Column:
    """Whether a document comes before the one at which its source's selection ends."""
    return F.coalesce((key < F.col("cut_key")) | ((key == F.col("cut_key")) & ~doc_id.eqNullSafe(F.col("cut_id")) & (doc_id < F.col("cut_id"))), F.lit(False))


def at_cut(doc_id: Column, key: Column) -> Column:
    return F.coalesce((key == F.col("cut_key")) & doc_id.eqNullSafe(F.col("cut_id")), F.lit(False))


def taken(doc_id: Column, size: Column, key: Column) -> Column:
    """Words the mix takes of a document, repeats counted, beside its source's columns of plan()."""
    part = F.when(before_cut(doc_id, key), size).when(at_cut(doc_id, key), F.col("cut_words")).otherwise(0)
    return (F.col("epochs") * size + part).cast("long")


def sized(docs: DataFrame, *others: Column) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source"), size_and_weight(F.col("text")).alias("w"), *others)
    names = [c for c in rows.columns if c not in ("doc_id", "source", "w")]
    return rows.select("doc_id", "source", "w.size", exponential_key(F.col("doc_id"), F.col("w.weight")).alias("key"), *names)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key, source_size, target, epochs and taken for each row."""
    rows = shared.staged(sized(docs), "sized")
    chosen = plan(rows).withColumnRenamed("source", "source_")
    joined = rows.join(chosen, F.col("source").eqNullSafe(F.col("source_")))
    return joined.select("doc_id", "source", "size", "key", "source_size", "target", "epochs", taken(F.col("doc_id"), F.col("size"), F.col("key")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` in the mix, each as often as it is taken, the last time in part; the columns stay."""
    chosen = plan(shared.staged(sized(docs), "sized")).withColumnRenamed("source", "source_")
    rows = sized(docs, F.struct("*").alias("document"))
    joined = rows.join(chosen, F.col("source").eqNullSafe(F.col("source_")))
    last = before_cut(F.col("doc_id"), F.col("key")) | at_cut(F.col("doc_id"), F.col("key"))
    times = F.when(F.col("size") > 0, F.col("epochs") + last.cast("int")).otherwise(0)
    return joined.select("document", times.alias("times")).where("times > 0").select("document", F.explode(F.sequence(F.lit(1), F.col("times")))).select("document.*")
