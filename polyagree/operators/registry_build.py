"""A registry of codes built in steps: sources merged, supplemented, put in families, named, reconciled, carried on, identified, matched with services.

Each step takes and gives rows with a unique `code`, and is a join or two on codes. Text columns hold no null but an empty text. Of several
rows of one code in what a step joins, the least values count, so that no step adds rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyagree.functions.text import canonical_tag, short_family
from polyagree.operators.registry import preferred_tag, roots, valid_key


def _text(x: Column | str) -> Column:
    return F.coalesce(F.trim(x), F.lit(""))


def _known(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _holds(x: Column | str) -> Column:
    """Whether a text column, in which nothing is an empty text, holds a code; `nan` is that of Min Nan Chinese and no missing value."""
    return _text(x) != ""


def _one(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row a key: the least of each other column."""
    return rows.groupBy(*key).agg(*(F.min(c).alias(c) for c in rows.columns if c not in key))


def merged(main: DataFrame, community: DataFrame, official: DataFrame, right_to_left: Sequence[str], excluded: Sequence[str] = ()) -> DataFrame:
    """(code, name, local_name, short, official, bibliographic, script, n_scripts, direction, direction_community, modern, is_official, in_short, in_official, in_community, sources).

    main: code, name, script, n_scripts, modern, is_official. community: code, name, direction, local_name. official: code (of three letters),
    bibliographic, short, primary_name, is_group; groups take no part. Codes of the community that `main` lacks are added, then official
    ones of which it lacks both codes, under the short one if there is one. A code of two letters is looked up among short codes, one of
    three among official ones. Writing goes from right to left by the script; where no script is known, by the community.
    """
    single = _one(official.where(~_known(F.col("is_group"))).select(_text("code").alias("code"), _text("bibliographic").alias("bibliographic"), _text("short").alias("short"), _text("primary_name").alias("name")), ["code"])
    spoken = _one(community.select(_text("code").alias("code"), _text("name").alias("name"), _text("direction").alias("direction_community"), _text("local_name").alias("local_name")), ["code"])
    plain = lambda rows, base, at: rows.select("code", "name", F.lit("").alias("script"), F.lit(0).alias("n_scripts"), F.lit(True).alias("modern"), F.lit(False).alias("is_official"), F.lit(base).alias("base"), F.lit(at).alias("at"))
    first = main.select(_text("code").alias("code"), _text("name").alias("name"), _text("script").alias("script"), F.coalesce(F.col("n_scripts").cast("int"), F.lit(0)).alias("n_scripts"), _known(F.col("modern")).alias("modern"), _known(F.col("is_official")).alias("is_official"), F.lit("main").alias("base"), F.lit(0).alias("at"))
    both = first.unionByName(plain(spoken, "community_only", 1)).where("code <> ''")  # an empty code would stand for an empty short one
    codes = both.select("code").distinct()
    lacking = single.join(codes, "code", "left_anti").join(codes.select(F.col("code").alias("short")), "short", "left_anti")
    added = plain(lacking.select(F.when(F.col("short") != "", F.col("short")).otherwise(F.col("code")).alias("code"), "name"), "official_only", 2)
    rows = both.unionByName(added)
    rows = rows.groupBy("code").agg(F.min(F.struct("at", *(c for c in rows.columns if c not in ("code", "at")))).alias("x")).select("code", "x.*").drop("at")
    rows = rows.where(valid_key(F.col("code"), excluded, ~_holds("code")) == "valid")

    given = single.select(F.col("code").alias("official"), "bibliographic", "short")
    ids = given.withColumn("code", F.col("official")).unionByName(_one(given.where(F.char_length("short") == 2).withColumn("code", F.col("short")), ["code"]))
    ids = ids.where(F.char_length("code").isin(2, 3))
    out = rows.join(ids, "code", "left").join(spoken.drop("name").withColumn("in_community", F.lit(True)), "code", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("official", "bibliographic", "local_name", "direction_community")} | {"in_community": _known(F.col("in_community"))})
    out = out.withColumn("short", F.when(F.char_length("code") == 2, F.col("code")).otherwise(F.coalesce("short", F.lit(""))))
    out = out.withColumns({"in_short": F.char_length("short") == 2, "in_official": F.char_length("official") == 3})
    from_right = F.col("script").isin(*right_to_left) | ((F.col("script") == "") & (F.col("direction_community") == "rtl"))
    told = [("official_only", "in_short", "short"), ("official_only", "in_official", "official"), ("community_only", "in_community", "community")]
    sources = F.concat_ws("|", "base", *(F.when((F.col("base") != but) & F.col(flag), name) for but, flag, name in told))
    return out.select(
        "code", "name", "local_name", "short", "official", "bibliographic", "script", "n_scripts", F.when(from_right, "rtl").otherwise("ltr").alias("direction"), "direction_community",
        "modern", "is_official", "in_short", "in_official", "in_community", sources.alias("sources"),
    )


def supplemented(registry: DataFrame, extra: DataFrame, source: str) -> DataFrame:
    """`registry` and the rows of `extra` (some of its columns) whose codes it lacks, as of `source`; columns they lack are empty, 0 or false."""
    new = _one(extra, ["code"]).join(registry.select("code"), "code", "left_anti").withColumn("sources", F.lit(source))
    usual = {"string": "", "boolean": False, "int": 0}
    return registry.unionByName(new.select(*(F.coalesce(F.col(c).cast(t), F.lit(usual[t])).alias(c) if c in new.columns else F.lit(usual[t]).cast(t).alias(c) for c, t in registry.dtypes)))


def with_families(registry: DataFrame, hierarchy: DataFrame, by_hand: DataFrame, assessed: DataFrame) -> DataFrame:
    """`registry` with family_direct, family_code, family_name and subfamily_name.

    hierarchy: code, parent, name. by_hand: code, family_code. assessed: code, family_code, family_name. The group of a code is the one given
    by hand for it or for its official code, else the assessed one, else itself if it is a group; its family is the top of that. `isolate`
    stands for itself. An assessed name counts where there is no other. What is not known is empty.
    """
    names = _one(hierarchy.select(_text("code").alias("direct"), _text("name").alias("direct_name")), ["direct"])
    tops = roots(hierarchy.select(_text("code").alias("code"), F.nullif(_text("parent"), F.lit("")).alias("parent"))).select(F.col("code").alias("direct"), "root")
    tops = tops.join(names.select(F.col("direct").alias("root"), F.col("direct_name").alias("root_name")), "root", "left")
    groups = names.join(tops, "direct", "left")
    hand = _one(by_hand.select(_text("code").alias("code"), F.nullif(_text("family_code"), F.lit("")).alias("hand")), ["code"])
    read = _one(assessed.select(_text("code").alias("code"), F.nullif(_text("family_code"), F.lit("")).alias("read"), F.nullif(_text("family_name"), F.lit("")).alias("read_name")), ["code"])
    rows = registry.join(hand, "code", "left").join(hand.select(F.col("code").alias("official"), F.col("hand").alias("hand_official")), "official", "left").join(read, "code", "left")
    rows = rows.join(names.select(F.col("direct").alias("code"), F.lit(True).alias("is_group")), "code", "left")
    rows = rows.withColumn("direct", F.coalesce("hand", "hand_official", "read", F.when(F.col("is_group"), F.col("code"))))
    rows = rows.join(groups, "direct", "left")
    alone = F.col("direct") == "isolate"
    top = F.when(alone, F.lit("isolate")).otherwise(F.coalesce("root", "direct"))
    known = F.when(alone, F.lit("Language isolate")).otherwise(F.nullif("root_name", F.lit("")))
    return rows.select(
        *registry.columns, F.coalesce("direct", F.lit("")).alias("family_direct"), F.coalesce(top, F.lit("")).alias("family_code"), F.coalesce(known, "read_name", F.lit("")).alias("family_name"),
        F.when(known.isNull(), F.coalesce("read_name", F.nullif("direct_name", F.lit("")), F.lit(""))).otherwise(F.coalesce(F.nullif("direct_name", F.lit("")), known)).alias("subfamily_name"),
    )


def named_from(registry: DataFrame, names: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """`registry` with names from `names` (code, name), or `overrides` before them, where a name is only the code; others stay."""
    given = _one(names.select(_text("code").alias("code"), F.nullif(_text("name"), F.lit("")).alias("__given")), ["code"])
    told = F.create_map(*(F.lit(x) for pair in overrides.items() for x in pair))[F.col("code")] if overrides else F.lit(None).cast("string")
    out = registry.join(given, "code", "left")
    return out.select(*(F.when(F.col("name") == F.col("code"), F.coalesce(told, "__given", "name")).otherwise(F.col("name")).alias("name") if c == "name" else F.col(c) for c in registry.columns))


def reconciled(registry: DataFrame, other: DataFrame, decisions: DataFrame) -> DataFrame:
    """`registry` with family_other and family_name_reconciled.

    other: code of three letters, family. decisions: family_name, family_other, chosen. Names alike but for case and endings agree; where they
    do not, the decision about the two counts, and without one, or without another name, the name stays.
    """
    theirs = _one(other.select(_text("code").alias("__three"), F.nullif(_text("family"), F.lit("")).alias("family_other")), ["__three"])
    decided = _one(decisions.select(_text("family_name").alias("family_name"), _text("family_other").alias("family_other"), F.col("chosen").alias("__chosen")), ["family_name", "family_other"])
    three = F.when(F.char_length("code") == 3, F.col("code")).when(F.char_length("official") == 3, F.col("official"))
    rows = registry.withColumn("__three", three).join(theirs, "__three", "left").withColumn("family_other", F.coalesce("family_other", F.lit("")))
    rows = rows.join(decided, ["family_name", "family_other"], "left")
    plain = lambda c: F.lower(short_family(F.col(c)))
    agree = (F.col("family_other") == "") | (plain("family_name") == plain("family_other"))
    return rows.select(*registry.columns, "family_other", F.when(agree, F.col("family_name")).otherwise(F.coalesce("__chosen", "family_name")).alias("family_name_reconciled"))


def undecided(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """(family_name, family_other, n): pairs of names that disagree and that no decision is about, with how many codes have them."""
    plain = lambda c: F.lower(short_family(F.col(c)))
    rows = registry.where((F.col("family_name") != "") & (F.col("family_other") != "") & (plain("family_name") != plain("family_other")))
    known = decisions.select(_text("family_name").alias("family_name"), _text("family_other").alias("family_other")).distinct()
    return rows.groupBy("family_name", "family_other").agg(F.count("*").alias("n")).join(known, ["family_name", "family_other"], "left_anti")


def carried_on(previous: DataFrame, registry: DataFrame, today: str) -> DataFrame:
    """`registry` with first_seen and last_seen, and the rows of `previous` (with both) whose codes it lacks, as they were."""
    seen = previous.select("code", F.col("first_seen").alias("__first")).groupBy("code").agg(F.min("__first").alias("__first"))
    now = registry.join(seen, "code", "left").select(*registry.columns, F.coalesce("__first", F.lit(today)).alias("first_seen"), F.lit(today).alias("last_seen"))
    gone = previous.join(registry.select("code"), "code", "left_anti")
    return now.unionByName(gone.select(*(c for c in now.columns if c in gone.columns)), allowMissingColumns=True)


def identified(registry: DataFrame, fallbacks: Mapping[str, str], legacy: Mapping[str, str]) -> DataFrame:
    """`registry` with tag, tag_source, tag_is_code and candidates.

    A tag is its code if they differ in case and in `_` for `-` only. Candidates are the tag, the code, and the short, official and
    bibliographic ones, each as it is, with hyphens, in its usual form, and under the old codes that `legacy` (old to new) gives; none twice.
    """
    old: dict[str, list[str]] = {}
    for before, after in sorted(legacy.items()):
        old.setdefault(after, []).append(before)
    others = F.create_map(*(x for k, v in old.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if old else None
    rows = registry.withColumn("__tag", preferred_tag(F.col("code"), F.col("short"), F.col("official"), fallbacks, _holds))
    rows = rows.select(*registry.columns, F.col("__tag.tag").alias("tag"), F.col("__tag.source").alias("tag_source"))
    forms = []
    for c in ("tag", "code", "short", "official", "bibliographic"):
        usual = canonical_tag(F.col(c))
        form = F.array(F.col(c), F.replace(F.col(c), F.lit("_"), F.lit("-")), usual)
        form = F.concat(form, F.coalesce(others[usual], F.array().cast("array<string>"))) if others is not None else form
        forms.append(F.when(~F.lower(F.coalesce(c, F.lit(""))).isin("", "none", "null"), form).otherwise(F.array().cast("array<string>")))
    same = F.lower("tag") == F.lower(F.replace(F.col("code"), F.lit("_"), F.lit("-")))
    return rows.withColumns({"tag_is_code": same, "candidates": F.array_distinct(F.concat(*forms))})


def matched(registry: DataFrame, support: DataFrame, services: Sequence[str]) -> DataFrame:
    """`registry` with <service>_code and <service>_supported of each service: the code of `support` (service, code) that the first of a row's candidates meets.

    A service's code is met as it is, with hyphens, or in its usual form, in this order. All services are met in one join and one grouping.
    """
    given = support.select(_text("service").alias("service"), _text("code").alias("exact")).where((F.col("exact") != "") & F.col("service").isin(*services))
    keys = F.array(F.col("exact"), F.replace(F.col("exact"), F.lit("_"), F.lit("-")), canonical_tag(F.col("exact")))
    keys = given.select("service", "exact", F.posexplode(keys).alias("kind", "candidate")).groupBy("service", "candidate").agg(F.min(F.struct("kind", "exact"))["exact"].alias("exact"))
    long = registry.select("code", F.posexplode("candidates").alias("at", "candidate")).join(keys, "candidate")
    found = long.groupBy("code").agg(*(F.min_by("exact", F.when(F.col("service") == s, F.col("at"))).alias(f"{s}_code") for s in services))
    out = registry.join(found, "code", "left")
    return out.select(*registry.columns, *(x for s in services for x in (F.coalesce(f"{s}_code", F.lit("")).alias(f"{s}_code"), F.col(f"{s}_code").isNotNull().alias(f"{s}_supported"))))


def build_up(registry: DataFrame, code: str, steps: Mapping[str, Column], examples: int = 8) -> DataFrame:
    """(step, source, added, cumulative, confirmed, examples): rows that each source adds to those before it, and rows that it confirms.

    Examples are the first added codes in order. A last row, of source null, counts what no source has. Counts come from one pass.
    """
    names = list(steps)
    masks = [_known(c) for c in steps.values()]
    first = F.coalesce(*(F.when(m, i) for i, m in enumerate(masks)), F.lit(len(names)))
    rows = registry.select(F.col(code).alias("__code"), first.alias("__first"), *(m.alias(f"__m{i}") for i, m in enumerate(masks)))
    down = F.row_number().over(Window.partitionBy("__first").orderBy("__code"))  # only `examples` rows of a partition reach the window
    sample = rows.where(F.col("__first") < len(names)).select("__first", "__code", down.alias("r")).where(F.col("r") <= examples)
    sample = sample.select(F.col("__first").alias("step"), F.col("r").alias("o"), F.col("__code").cast("string").alias("c"))
    sample = sample.groupBy("step").agg(F.array_join(F.array_sort(F.collect_list(F.struct("o", "c")))["c"], ", ").alias("examples"))
    counts = rows.agg(*(F.count_if(F.col("__first") == i).alias(f"a{i}") for i in range(len(names) + 1)), *(F.count_if(F.col(f"__m{i}") & (F.col("__first") < i)).alias(f"c{i}") for i in range(len(names))))
    sums = [reduce(Column.__add__, (F.col(f"a{j}") for j in range(i + 1))) for i in range(len(names))]
    lines = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("source"), F.col(f"a{i}").alias("added"), sums[i].alias("cumulative"), F.col(f"c{i}").alias("confirmed")) for i, n in enumerate(names)]
    rest = F.struct(F.lit(len(names)).alias("step"), F.lit(None).cast("string").alias("source"), F.col(f"a{len(names)}").alias("added"), (sums[-1] + F.col(f"a{len(names)}")).alias("cumulative"), F.lit(0).cast("long").alias("confirmed"))
    return counts.select(F.inline(F.array(*lines, rest))).join(F.broadcast(sample), "step", "left").withColumn("examples", F.coalesce("examples", F.lit("")))


def enrichment(registry: DataFrame, layers: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(layer, enriched, changed, share): rows that a layer knows, rows whose value it changed, and the share known, in one pass."""
    marks = list(layers.values())
    counts = registry.agg(F.count("*").alias("n"), *(F.count_if(a).alias(f"e{i}") for i, (a, _) in enumerate(marks)), *(F.count_if(b).alias(f"c{i}") for i, (_, b) in enumerate(marks)))
    share = lambda i: F.round(F.col(f"e{i}") / F.nullif("n", F.lit(0)), 6)
    return counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("layer"), F.col(f"e{i}").alias("enriched"), F.col(f"c{i}").alias("changed"), share(i).alias("share")) for i, n in enumerate(layers)))))


#: Where a family's name comes from, in order of priority; the first that holds counts.
FAMILY_SOURCES = ("unassigned", "by_hand", "assessed", "direct", "other")


def family_evidence(registry: DataFrame, family: Column, by_hand: Column, assessed: Column, named: Column, grouped: Column, direct: Column) -> DataFrame:
    """`registry` with family_source (of FAMILY_SOURCES) and family_combo: which of by_hand, assessed, hierarchy and unassigned speak for a row, or `other`.

    assessed: there is an assessment; named: it gives a family; grouped: the family is one of the hierarchy; direct: the row has a group of its own.
    """
    none = _text(family) == ""
    source = F.when(none, "unassigned").when(_known(by_hand), "by_hand").when(_known(named), "assessed").when(_known(direct), "direct").otherwise("other")
    combo = F.concat_ws(" + ", F.when(_known(by_hand), "by_hand"), F.when(_known(assessed), "assessed"), F.when(_known(grouped), "hierarchy"), F.when(none, "unassigned"))
    return registry.withColumns({"family_source": source, "family_combo": F.coalesce(F.nullif(combo, F.lit("")), F.lit("other"))})


def evidence_shares(rows: DataFrame, column: str) -> DataFrame:
    """(column, n, share) of the values of family_source or family_combo, of which there are few."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("__all"))), how="cross").select(column, "n", F.round(F.col("n") / F.col("__all"), 6).alias("share"))


def evidence_by_family(rows: DataFrame, family: str) -> DataFrame:
    """A family's rows by source, and all of them."""
    return rows.groupBy(family).agg(*(F.count_if(F.col("family_source") == s).alias(s) for s in FAMILY_SOURCES), F.count("*").alias("total"))
