"""Review of cells: signals by item, tiers and hints, exclusions, convergence, alignment with an anchor, profiles of services."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyagree.functions import fixed as V
from polyagree.functions import text as X


def term_signals(term: Column, rationale: Column, source: str, language_name: Column | None = None, english: Column | None = None, mix: Column | None = None) -> dict[str, Column]:
    """The signals of one cell by name. Rationales are read where they are English. `mix`: a column of the cells that holds X.mix() of the term, as two signals would each compute it."""
    of_mix = lambda name: F.coalesce(mix[name], F.lit(False))
    english = F.lit(True) if english is None else english
    has_term, has_why = X.present(term), ~X.is_empty_rationale(rationale)
    ascii_ = F.coalesce(term.rlike("^[\\x00-\\x7F]+$"), F.lit(False))
    return {
        "has_repetition_loop": X.is_repetition_loop(term), "has_mixed_script": X.is_mixed(term) if mix is None else of_mix("mixed"), "has_any_mixing": X.has_any_mixing(term) if mix is None else of_mix("any"), "has_placeholder_term": X.is_placeholder(term),
        "has_unicode_escape": X.has_escape(term), "has_extreme_term_length": X.is_extreme_length(term), "has_short_translation": X.is_short(term),
        "has_source_term": X.leaks_source(term, source), "has_unsafe_characters": X.is_search_unsafe(term), "has_romanization": ascii_ & X.says(rationale, "romani[sz]"),
        "has_language_name": X.is_language_name(term, language_name) if language_name is not None else F.lit(False), "has_missing_rationale": has_term != has_why,
        "has_refusal_rationale": english & X.is_refusal(rationale), "has_transliteration_rationale": english & X.is_transliteration(rationale),
        "has_placeholder_rationale": english & X.is_placeholder_rationale(rationale), "has_foreign_rationale": english & X.has_foreign_rationale(rationale),
    }


def signals(cells: DataFrame, key: list[str], service: str, conditions: Mapping[str, Column]) -> DataFrame:
    """(key, signal, services, n_services): the services of each item that show a signal, sorted and joined."""
    flags = F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())).alias("__flags")  # in a step of its own, which computes what conditions share once
    long = cells.select(*key, service, flags).select(*key, service, F.explode_outer(F.array_compact("__flags")).alias("signal")).where("signal is not null")  # explode() would compute them a second time, to look for empty arrays
    found = F.collect_set(F.col(service).cast("string"))
    return long.groupBy(*key, "signal").agg(F.array_join(F.array_sort(found), ", ").alias("services"), F.size(found).cast("long").alias("n_services"))  # count_distinct() would be a shuffle more


def tier(flags: Column) -> Column:
    return F.when(flags >= 2, "REVIEW_HIGH").when(flags == 1, "REVIEW_MED").otherwise("CLEAN")


def tier_rank(label: Column) -> Column:
    """For sorting: high, medium, clean, then any other."""
    return F.when(label == "REVIEW_HIGH", 0).when(label == "REVIEW_MED", 1).when(label == "CLEAN", 2).otherwise(9)


def hint(flags: Column) -> Column:
    """xall for a flag that excludes, xsrch for one that complicates searches, else empty. `flags`: an array of names."""
    has = lambda names: F.arrays_overlap(flags, F.array(*(F.lit(n) for n in names)))
    return F.when(has(V.EXCLUDING_FLAGS), "xall").when(has(V.COMPLICATING_FLAGS), "xsrch").otherwise("")


def summary(items: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """`items` (key) with flags, flag_count, tier, rank and hint; items without a signal are clean."""
    flags = found.groupBy(*key).agg(F.array_sort(F.collect_set("signal")).alias("f"))
    out = items.select(*key).distinct().join(flags, key, "left").withColumn("f", F.coalesce("f", F.array().cast("array<string>")))
    label = tier(F.size("f"))
    return out.select(*key, F.array_join("f", ", ").alias("flags"), F.size("f").alias("flag_count"), label.alias("tier"), tier_rank(label).alias("rank"), hint(F.col("f")).alias("hint"))


def exclusions(decisions: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """(key, likely_error, likely_search_complication): what was decided by hand or what a signal says. decisions: key, tier."""
    manual = decisions.select(*key, (F.col("tier") == "likely_error").alias("e"), (F.col("tier") == "likely_search_complication").alias("c"))
    auto = found.select(*key, F.col("signal").isin(*V.EXCLUDING_FLAGS).alias("e"), F.col("signal").isin(*V.COMPLICATING_FLAGS).alias("c"))
    both = manual.unionByName(auto).groupBy(*key).agg(F.bool_or("e").alias("likely_error"), F.bool_or("c").alias("likely_search_complication"))
    return both.where("likely_error or likely_search_complication")


def promoted(decisions: DataFrame, key: list[str], variant: str, variants: Sequence[str]) -> DataFrame:
    """(key, all_variants): keys excluded under every variant are excluded outright. decisions: key, variant."""
    seen = F.array_except(F.array(*(F.lit(v) for v in variants)), F.collect_set(F.col(variant).cast("string")))
    return decisions.groupBy(*key).agg((F.size(seen) == 0).alias("all_variants"))


def convergence(cells: DataFrame, key: list[str], source: str = "service", term: str = "term") -> DataFrame:
    """For each key: sources, n_present, n_distinct and label, by terms made comparable."""
    rows = cells.withColumn("norm", X.comparable(F.col(term)))
    out = rows.groupBy(*key).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("norm") != "", F.col(source).cast("string")))), "; ").alias("sources"),
        F.count_if(F.col("norm") != "").alias("n_present"),
        F.count_distinct(F.when(F.col("norm") != "", F.col("norm"))).alias("n_distinct"),
    )
    label = F.when(F.col("n_present") == 0, "no outputs").when(F.col("n_present") == 1, "one output only").when(F.col("n_distinct") == 1, "all available outputs agree").otherwise("outputs diverge")
    return out.withColumn("label", label)


def shares(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, share) of all rows."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__all")))).select(label, "n", F.round(F.col("n") / F.col("__all"), 6).alias("share"))  # one row


def presence(cells: DataFrame, item: list[str], source: str, term: str = "term") -> DataFrame:
    """(source, present, items, rate): for how many of all items each source has a term."""
    sources = cells.groupBy(source).agg(F.count_distinct(*(F.when(X.present(F.col(term)), F.col(c)) for c in item)).alias("present"))
    items = cells.agg(F.count_distinct(*item).alias("items"))
    return sources.crossJoin(F.broadcast(items)).withColumn("rate", F.round(F.col("present") / F.col("items"), 6))  # one row


def alignment(cells: DataFrame, item: list[str], service: str, anchor, term: str = "term") -> DataFrame:
    """(service, compared, aligned, rate): how often each service gives the anchor's term, both made comparable."""
    rows = cells.withColumn("norm", X.comparable(F.col(term), V.ALIGNMENT_MARKS)).where("norm <> ''").select(*item, service, "norm").distinct()
    held = rows.where(F.col(service) == anchor).groupBy(*item).agg(F.collect_set("norm").alias("held"))
    both = rows.where(F.col(service) != anchor).join(held, item)
    hit = F.array_contains("held", F.col("norm"))
    return both.groupBy(service).agg(F.count("*").alias("compared"), F.count_if(hit).alias("aligned"), F.round(F.count_if(hit) / F.count("*"), 6).alias("rate"))


def profile(cells: DataFrame, by: list[str], term: str, source: Column) -> DataFrame:
    """(by, n, covered, mean_words, echo_rate, overlap_rate): cells, those with a term, its words, and how often it is or shares a word with `source`."""
    t, s = F.lower(F.trim(term)), F.lower(F.trim(source))
    has = X.present(F.col(term))
    rate = lambda c: F.round(F.count_if(has & c) / F.nullif(F.count_if(has), F.lit(0)), 6)
    return cells.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(has).alias("covered"), F.round(F.avg(F.when(has, F.size(X.words(F.col(term))))), 6).alias("mean_words"),
        rate(t == s).alias("echo_rate"), rate(F.arrays_overlap(X.words(t), X.words(s))).alias("overlap_rate"),
    )


def _in_script(cells: DataFrame, term: str) -> DataFrame:
    """`cells` with a term in a known script, and `script`. As rows of an array scripts are computed once; a condition on a column would be a second time."""
    rows = cells.where(X.present(F.col(term)))
    return rows.select("*", F.explode_outer(F.array(X.dominant_script(F.col(term)))).alias("script")).where("script <> 'Unknown'")


def script_agreement(cells: DataFrame, item: list[str], service: str, term: str = "term") -> DataFrame:
    """(item, service, script, majority, outlier): each service's script beside the one of most, ties to the least name."""
    rows = _in_script(cells.dropna(subset=item), term).select(*item, service, "script").repartition(*item)  # for both windows
    most = F.min_by("script", F.struct((-F.col("n")).alias("n"), "script")).over(Window.partitionBy(*item))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(*item, "script"))).withColumn("majority", most).drop("n")
    return rows.withColumn("outlier", F.col("script") != F.col("majority"))


def side_scripts(cells: DataFrame, item: list[str], sides: Mapping[str, Column], term: str = "term") -> DataFrame:
    """(item, a script for each side, differ): the script of most terms of each side of services, ties to the least name, null where a side has none; differ only where all sides have one."""
    rows = _in_script(cells, term)
    side = F.explode(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in sides.items()))))
    counts = rows.withColumn("side", side).groupBy(*item, "side", "script").agg(F.count("*").alias("n"))
    best = lambda name: F.min_by(F.when(F.col("side") == name, F.col("script")), F.when(F.col("side") == name, F.struct((-F.col("n")).alias("n"), "script")))
    out = counts.groupBy(*item).agg(*(best(name).alias(name) for name in sides))
    return out.withColumn("differ", F.coalesce(F.greatest(*(F.col(n) for n in sides)) != F.least(*(F.col(n) for n in sides)), F.lit(False)) & ~F.greatest(*(F.col(n).isNull() for n in sides)))


def counted(items: DataFrame, found: DataFrame, key: list[str], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """(kind, name, n, share): items by number of signals (`flags`), with each signal (`signal`), and with any of a group of signals (`group`). Signals are few."""
    every = items.select(*key).distinct()
    per = every.join(found.groupBy(*key).agg(F.collect_set("signal").alias("f")), key, "left").select(F.coalesce("f", F.array().cast("array<string>")).alias("f"))
    row = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    of_groups = F.array_compact(F.array(*(F.when(F.arrays_overlap("f", F.array(*(F.lit(s) for s in names))), row("group", F.lit(g))) for g, names in groups.items())))
    rows = per.select(F.explode(F.concat(F.array(row("flags", F.size("f").cast("string"))), F.transform("f", lambda s: row("signal", s)), of_groups)).alias("x"))
    total = F.broadcast(per.agg(F.count("*").alias("total")))  # one row
    return rows.groupBy("x.kind", "x.name").agg(F.count("*").alias("n")).crossJoin(total).select("kind", "name", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def wide(items: DataFrame, found: DataFrame, key: list[str], names: Sequence[str]) -> DataFrame:
    """One row an item: for each signal has_* and *_services, and all signals joined with their number."""
    columns = [c for n in names for c in (F.coalesce(F.max(F.col("signal") == n), F.lit(False)).alias(n), F.coalesce(F.max(F.when(F.col("signal") == n, F.col("services"))), F.lit("")).alias(f"{n.removeprefix('has_')}_services"))]
    both = items.select(*key).distinct().join(found.where(F.col("signal").isin(*names)), key, "left").groupBy(*key)
    listed = F.array_sort(F.collect_set("signal"))
    return both.agg(*columns, F.array_join(listed, "; ").alias("automated_review_signals"), F.size(listed).alias("flag_count"))


def recovered(paired: DataFrame, raw: DataFrame, key: list[str]) -> DataFrame:
    """`paired` (key, term) with shown and unpaired: the raw term where pairing took it away."""
    both = paired.join(raw.select(*key, F.col("term").alias("__raw")), key, "left")
    lost = F.col("term").isNull() & X.present(F.col("__raw"))
    return both.select(*paired.columns, F.coalesce("term", F.when(lost, F.col("__raw"))).alias("shown"), F.coalesce(lost, F.lit(False)).alias("unpaired"))


def pattern_rates(rows: DataFrame, by: list[str], text: str, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """(by, n, a rate for each family): the share of texts that hold one of a family's patterns."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.count_if(X.says(F.col(text), p)) / F.count("*"), 6).alias(f) for f, p in families.items()))


def borrowing(cells: DataFrame, item: list[str], service: str, term: str, tokens: Sequence[str]) -> DataFrame:
    """(item, services, tokens, band) of items in which a service's term holds a source token as a word; bands 1, 2-3 and 4+."""
    found = F.array_intersect(X.words(X.folded(F.col(term))), F.array(*(F.lit(t) for t in tokens)))
    rows = cells.withColumn("__t", found).where(F.size("__t") > 0)
    out = rows.groupBy(*item).agg(F.count_distinct(service).alias("services"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("__t")))), ", ").alias("tokens"))
    return out.withColumn("band", F.when(F.col("services") <= 1, "1").when(F.col("services") <= 3, "2-3").otherwise("4+"))


def refused_elsewhere(cells: DataFrame, item: list[str], service: str, refused: Column) -> DataFrame:
    """(item, service) of terms that one service gives while another says honestly that there is none."""
    said = cells.where(refused).groupBy(*item).agg(F.min(service).alias("__a"), F.max(service).alias("__b"))
    rows = cells.where(X.present(F.col("term"))).select(*item, service).distinct().join(said, item)
    return rows.where((F.col("__a") != F.col(service)) | (F.col("__b") != F.col(service))).select(*item, service)


def tag_audit(rows: DataFrame, code: str, tag: str) -> DataFrame:
    """`rows` with outcome: how a stored tag relates to its code."""
    a, b = X.canonical_tag(F.col(code)), X.canonical_tag(F.col(tag))
    base = lambda x: F.split(x, "-")[0]
    out = F.when(~X.present(F.col(tag)), "missing").when(F.col(code) == F.col(tag), "same").when(a == b, "same but for its form").when(base(a) == base(b), "same language").otherwise("other")
    return rows.withColumn("outcome", out)
