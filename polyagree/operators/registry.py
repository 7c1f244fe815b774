"""Registries of codes: hierarchies, candidate lookups, overlap of sources and what each source adds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyagree.functions.text import canonical_tag, present
from polyagree.sources.files import stored


def roots(edges: DataFrame) -> DataFrame:
    """(code, root, depth) of (code, parent): the ancestor without a parent and the steps to it, for each different code.

    A code whose way up ends at a parent that has no row, or goes round, is its own root, and its depth is null. Of several parents of a
    code the least counts; rows without a code are left out.

    Pointers double in each round, so a chain of a thousand takes ten. Only codes that have not arrived are looked up, and a round in
    which none arrives shows that all of them go round: any that did arrive later would have an ancestor that arrives now. Each round is
    written to the shared folder. All rows come to share a few roots; the side that is looked up has one row a code, so Spark can split the
    hot keys of the other.
    """
    up = edges.where("code is not null").groupBy("code").agg(F.min("parent").alias("parent"))
    state = F.when(F.col("parent").isNull(), "root").otherwise("open")
    up = stored(up.select("code", F.coalesce("parent", "code").alias("at"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps"), state.alias("state")), "roots")
    left = up.where("state = 'open'").count()
    while left:
        next_ = up.select(F.col("code").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("state").alias("then"))
        moved = up.where("state = 'open'").join(next_, "at", "left").select("code", F.coalesce("next", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("then", F.lit("lost")).alias("state"))
        up = stored(up.where("state <> 'open'").unionByName(moved), "roots")
        left, before = up.where("state = 'open'").count(), left
        if left == before:
            break
    arrived = F.col("state") == "root"
    return up.select("code", F.when(arrived, F.col("at")).otherwise(F.col("code")).alias("root"), F.when(arrived, F.col("steps")).alias("depth"))


def first_supported(items: DataFrame, key: str, candidates: Column, codes: DataFrame) -> DataFrame:
    """For each item the first of its candidates, in order, that is among `codes` (code); null if none."""
    long = items.select(key, F.posexplode(candidates).alias("pos", "code"))
    found = long.join(codes.select("code").distinct(), "code").groupBy(key).agg(F.min_by("code", "pos").alias("code"))
    return items.select(key).distinct().join(found, key, "left")


def overlap(members: DataFrame, item: str, source: str) -> DataFrame:
    """How many items each combination of sources has."""
    sets = members.groupBy(item).agg(F.array_join(F.array_sort(F.collect_set(source)), " + ").alias("combination"))
    return sets.groupBy("combination").agg(F.count("*").alias("n"))


def novelty(members: DataFrame, item: str, step: str) -> DataFrame:
    """Items that each step adds to those of earlier steps, and how many there are so far."""
    first = members.groupBy(item).agg(F.min(step).alias(step)).groupBy(step).agg(F.count("*").alias("added"))
    return first.withColumn("cumulative", F.sum("added").over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))  # a row for each step


def cumulative_share(counts: DataFrame, label: str, n: str = "n") -> DataFrame:
    """Running totals and shares from the largest; for counts of few labels."""
    down = Window.orderBy(F.desc(n), label).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.withColumns({"running": F.sum(n).over(down), "share": F.round(F.sum(n).over(down) / F.sum(n).over(everything), 6)})


def quadrant(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Counts of the four combinations of two conditions."""
    return rows.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"), F.count_if(~a & ~b).alias("neither"))


def built(sources: dict[str, DataFrame], key: str, values: list[str]) -> DataFrame:
    """(key, values, sources, added_by): a registry from sources in order; each value is the first that is not blank, in one shuffle."""
    from functools import reduce

    frames = [d.select(key, *(F.nullif(F.trim(v), F.lit("")).alias(v) if v in d.columns else F.lit(None).cast("string").alias(v) for v in values), F.lit(i).alias("__at"), F.lit(n).alias("__name")) for i, (n, d) in enumerate(sources.items())]
    rows = reduce(DataFrame.unionByName, frames)
    order = F.struct("__at", "__name")
    return rows.groupBy(key).agg(
        *(F.min_by(v, F.when(F.col(v).isNotNull(), F.struct("__at", v))).alias(v) for v in values),
        F.array_join(F.array_sort(F.collect_set(order)).getField("__name"), " + ").alias("sources"),
        F.min(order).getField("__name").alias("added_by"),
    )


def valid_key(x: Column, excluded: Sequence[str] = (), blank: Column | None = None) -> Column:
    """What speaks against a code, the first that holds: blank, excluded, space, form; `valid` if nothing does.

    `blank`: what counts as no code, by default also the words for a missing value, one of which, `nan`, is the code of a language.
    """
    form = x.rlike("^[A-Za-z][A-Za-z0-9_-]{1,14}$")
    return F.when(~present(x) if blank is None else blank, "blank").when(x.isin(*excluded), "excluded").when(F.contains(x, F.lit(" ")), "space").when(~form, "form").otherwise("valid")


def split_alternative(x: Column, mark: str = "-alt-") -> Column:
    """Struct of base, alternative (null if there is none) and primary: whether it is the main entry, which all but `secondary` ones are."""
    parts = F.split(x, mark, 2)
    other = F.get(parts, 1)
    return F.struct(F.get(parts, 0).alias("base"), other.alias("alternative"), (F.coalesce(other, F.lit("")) != "secondary").alias("primary"))


def preferred_tag(code: Column, short: Column, long: Column, fallbacks: Mapping[str, str], given_as=present) -> Column:
    """Struct of tag and source: a fallback by the code, else the short code, the long one, or the code itself; each in its usual form.

    `given_as`: whether a column holds a code; by default a word for a missing value, such as `nan`, is none.
    """
    given = F.create_map(*(F.lit(x) for kv in fallbacks.items() for x in kv))[code] if fallbacks else F.lit(None).cast("string")
    of = lambda tag, source: F.struct(tag.alias("tag"), F.lit(source).alias("source"))
    return (
        F.when(given.isNotNull(), of(given, "fallback")).when(given_as(short), of(canonical_tag(short), "short"))
        .when(given_as(long), of(canonical_tag(long), "long")).otherwise(of(canonical_tag(code), "code"))
    )


def code_cell(x: Column) -> Column:
    """Struct of part (B or T) and code of a cell such as `ger (B)`, null if it is none."""
    pattern = "^\\s*([a-z]{3})\\s*\\(([BT])\\)\\s*$"
    return F.when(x.rlike(pattern), F.struct(F.regexp_extract(x, pattern, 2).alias("part"), F.regexp_extract(x, pattern, 1).alias("code")))


def named(rows: DataFrame, ref: str, code: str, name: str, eligible: Column) -> DataFrame:
    """`rows` with <ref>_name: the name of the row that `ref` points to, if that row is eligible; of several the least. A join of the table with itself on the code."""
    names = rows.where(eligible).groupBy(F.col(code).alias(ref)).agg(F.min(name).alias(f"{ref}_name"))
    return rows.join(names, ref, "left")


def summarised(rows: DataFrame, key: list[str], order: Sequence[str], firsts: Sequence[str], lists: Sequence[str], separator: str = "|") -> DataFrame:
    """One row a key: n, attributes of its first row by `order`, and lists of values in that order, repeats included. A key's rows are few."""
    sorted_ = F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, *firsts, *lists]))))
    out = rows.groupBy(*key).agg(sorted_.alias("__x"))
    return out.select(*key, F.size("__x").alias("n"), *(F.col("__x")[0][c].alias(c) for c in firsts), *(F.array_join(F.col("__x").getField(c).cast("array<string>"), separator).alias(f"all_{c}") for c in lists))
