"""Families of a registry: proposed labels for analysis, reviewed decisions, and assignments that fill what is blank."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyagree.functions.text import short_family


def filled(x: Column) -> Column:
    """Null for a blank one."""
    return F.nullif(F.trim(x), F.lit(""))


def proposed_labels(families: DataFrame, family: str, renamed: Mapping[str, str], by_row: Sequence[str], dropped: Sequence[str], retained: Sequence[str]) -> DataFrame:
    """`families` with label, action and status; the first rule that holds decides, and any other family stays as it is."""
    f = filled(F.col(family))
    new = F.create_map(*(F.lit(x) for pair in renamed.items() for x in pair))[f] if renamed else F.lit(None).cast("string")
    rules = [
        (f.isNull(), F.lit("Unassigned"), "missing_family", "pending"),
        (new.isNotNull(), new, "normalize_variant", "pending"),
        (f.isin(*by_row), f, "row_level_reconciliation", "reference_only"),
        (f.isin(*dropped), F.lit("Exclude from family aggregation"), "exclude_special", "pending"),
        (f.isin(*retained), f, "retain_special_category", "accepted"),
        (F.lit(True), f, "preserve_reconciled", "accepted"),
    ]
    return families.withColumns({name: F.coalesce(*(F.when(r[0], F.lit(r[k]) if k > 1 else r[k]) for r in rules)) for k, name in ((1, "label"), (2, "action"), (3, "status"))})


def mapping(registry: DataFrame, samples: int = 8) -> DataFrame:
    """family, n_languages, sample_languages and raw_family_names of each reconciled family.

    registry: language_code, language_name, family_name, family_name_reconciled. A sample is the first few by name and code.
    """
    rows = registry.withColumn("family", F.coalesce("family_name_reconciled", F.lit("")))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("family").orderBy("language_name", "language_code"))).where(F.col("rank") <= samples)
    named = F.struct("rank", F.format_string("%s (%s)", "language_code", "language_name").alias("x"))
    sample = first.groupBy("family").agg(F.array_join(F.array_sort(F.collect_list(named))["x"], "; ").alias("sample_languages"))
    raw = rows.groupBy("family", F.coalesce(filled(F.col("family_name")), F.lit("(blank)")).alias("raw")).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "raw", F.format_string("%s: %d", "raw", "n").alias("x"))))["x"]
    raw = raw.groupBy("family").agg(F.sum("n").alias("n_languages"), F.array_join(listed, "; ").alias("raw_family_names"))
    return raw.join(sample, "family").select("family", "n_languages", "sample_languages", "raw_family_names")


def reviewed(registry: DataFrame, pairs: DataFrame, languages: DataFrame, labels: DataFrame) -> DataFrame:
    """`registry` with reviewed, review_source and analysis.

    registry: language_code, family_name, family_glottolog, family_name_reconciled. pairs: family_name, family_glottolog, chosen;
    languages: language_code, chosen (a decision about one language goes before one about a pair); labels: family, label.
    Blank decisions count as none, and of several for a key the least one counts.
    """
    key = lambda c: F.coalesce(F.trim(c), F.lit(""))
    by_pair = pairs.where(filled(F.col("chosen")).isNotNull()).groupBy(key(F.col("family_name")).alias("__iso"), key(F.col("family_glottolog")).alias("__glottolog")).agg(F.min(F.trim("chosen")).alias("__pair"))
    by_code = languages.where(filled(F.col("chosen")).isNotNull()).groupBy(key(F.col("language_code")).alias("__code")).agg(F.min(F.trim("chosen")).alias("__one"))
    named = labels.groupBy(F.col("family").alias("reviewed")).agg(F.min("label").alias("__label"))
    out = registry.withColumns({"__iso": key(F.col("family_name")), "__glottolog": key(F.col("family_glottolog")), "__code": key(F.col("language_code"))})
    out = out.join(by_pair, ["__iso", "__glottolog"], "left").join(by_code, "__code", "left")
    before = F.coalesce(filled(F.col("family_name_reconciled")), F.col("family_name"))
    source = F.when(F.col("__one").isNotNull(), "language").when(F.col("__pair").isNotNull(), "pair").otherwise("reconciled")
    out = out.withColumns({"reviewed": F.coalesce("__one", "__pair", before), "review_source": source}).join(named, "reviewed", "left")
    return out.select(*registry.columns, "reviewed", "review_source", F.coalesce("__label", "reviewed").alias("analysis"))


def assigned(registry: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """`registry` with blanks filled from `patches` (same columns, one row a key), and rows of new keys added."""
    columns = [c for c in registry.columns if c != key]
    new = patches.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__in"))
    both = registry.withColumn("__old", F.lit(True)).join(new, key, "full_outer")
    return both.select(key, *(F.when(F.col("__old").isNull(), F.col(f"__{c}")).otherwise(F.coalesce(filled(F.col(c)), F.col(f"__{c}"), F.col(c))).alias(c) for c in columns))


def queue(registry: DataFrame, policy: Mapping[str, str], many: int = 10, some: int = 3) -> DataFrame:
    """(kind, family_name, family_glottolog, n_languages, suggestion, tier, rank) of what a reviewer should look at.

    `pair`: two sources give names that differ in more than case and endings. `fallback`: there is no reconciled name. A family of
    `policy` has its suggestion and tier from it; else the reconciled or first name is suggested, and the tier is by languages.
    """
    iso, other, named = (F.coalesce(F.trim(c), F.lit("")) for c in ("family_name", "family_glottolog", "family_name_reconciled"))
    plain = lambda c: F.lower(short_family(c))
    kind = F.when((iso != "") & (other != "") & (plain(iso) != plain(other)), "pair").when(named == "", "fallback")
    rows = registry.select(kind.alias("kind"), iso.alias("family_name"), other.alias("family_glottolog"), F.nullif(named, F.lit("")).alias("named")).where("kind is not null")
    out = rows.groupBy("kind", "family_name", "family_glottolog").agg(F.count("*").alias("n_languages"), F.min("named").alias("named"))
    held = F.create_map(*(F.lit(x) for pair in policy.items() for x in pair))[F.col("family_name")] if policy else F.lit(None).cast("string")
    tier = F.when(held.isNotNull(), "policy").when(F.col("n_languages") >= many, "high").when(F.col("n_languages") >= some, "medium").otherwise("low")
    rank = F.when(tier == "high", 0).when(tier == "medium", 1).when(tier == "low", 2).otherwise(3)
    return out.select("kind", "family_name", "family_glottolog", "n_languages", F.coalesce(held, "named", filled(F.col("family_name")), "family_glottolog").alias("suggestion"), tier.alias("tier"), rank.alias("rank"))
