"""Assembling the cells of variants from files of services, decisions by hand, and the whole run from cells to categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyagree.functions import text as X
from polyagree.operators import cells as C
from polyagree.operators import disagreement, shaping, similarity

#: What stands in place of a service's name in decisions that concern no service.
ANALYSIS, SEARCH, CORRECTION = "analysis_exclusion", "search_exclusion", "term_correction"


def assembled(cells: DataFrame, key: list[str], variants: Sequence[str], order: Sequence[str], paired: Column) -> DataFrame:
    """(key, service, variant, term, rationale): one cell for each variant asked for, from all files at once.

    cells: key, service, variant, term, rationale and the columns of `order`. A row without a variant comes from a service that
    takes no prompt and belongs to each variant. Of several rows the last by `order` that has a term counts (ties: the greatest
    term, then rationale). Where `paired` holds, a term without a rationale and a rationale without a term become null.
    """
    wanted = F.array(*(F.lit(v) for v in variants))
    rows = cells.withColumn("variant", F.explode(F.when(F.col("variant").isNull(), wanted).otherwise(F.array_intersect(F.array("variant"), wanted))))
    last = F.max(F.when(F.col("term").isNotNull(), F.struct(*order, "term", "rationale")))
    out = rows.groupBy(*key, "service", "variant").agg(last.alias("x"), F.bool_or(paired).alias("__paired")).select(*key, "service", "variant", "x.term", "x.rationale", "__paired")
    whole = ~F.col("__paired") | X.present(F.col("term")) & ~X.is_empty_rationale(F.col("rationale"))
    return out.select(*key, "service", "variant", F.when(whole, F.col("term")).alias("term"), F.when(whole, F.col("rationale")).alias("rationale"))


def wanted(languages: DataFrame, terms: Sequence[str], done: DataFrame, key: str) -> DataFrame:
    """(key, term_source) still to be asked for: each source term in each language, but what `done` has. Terms are a few literals, so no join makes the pairs."""
    every = languages.select(key, F.explode(F.array(*(F.lit(t) for t in terms))).alias("term_source")).distinct()
    return every.join(done.select(key, "term_source"), [key, "term_source"], "left_anti")


def by_hand(decisions: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions as three tables: keys left out of all analysis (key), terms not to be searched (key, original_term), and corrections
    (key, original_term, corrected_term; of several the greatest). decisions: key, service, original_term, corrected_term."""
    of = lambda kind, *columns: decisions.where((F.trim("service") == kind) & X.present(F.col(key).cast("string"))).select(key, *columns)
    better = of(CORRECTION, "original_term", "corrected_term").where(X.present(F.col("original_term")) & X.present(F.col("corrected_term")))
    return of(ANALYSIS).distinct(), of(SEARCH, "original_term").distinct(), better.groupBy(key, "original_term").agg(F.max("corrected_term").alias("corrected_term"))


def drops(found: DataFrame, flags: Sequence[str], decisions: DataFrame, key: list[str]) -> DataFrame:
    """(key, service) to be left out, services in lower case: those that show one of the `flags` in review.signals(), and those
    that a decision (key, service, excluded) names; decisions that concern no service are none."""
    signalled = shaping.delimited(found.where(F.col("signal").isin(*flags)).select(*key, F.col("services").alias("service")), "service")
    manual = decisions.where(F.col("excluded") & F.col("service").isNotNull()).select(*key, F.trim("service").alias("service")).where(~F.col("service").isin(ANALYSIS, SEARCH, CORRECTION))
    return signalled.unionByName(manual).select(*key, F.lower("service").alias("service")).distinct()


def without(cells: DataFrame, dropped: DataFrame, key: list[str], service: str = "service") -> DataFrame:
    """`cells` but those of dropped services; names are compared in lower case."""
    gone = dropped.select(*key, F.col("service").alias("__s"))
    return cells.withColumn("__s", F.lower(F.col(service).cast("string"))).join(gone, [*key, "__s"], "left_anti").select(*cells.columns)


def dropped_by_all(dropped: DataFrame, key: list[str], services: Sequence[str]) -> DataFrame:
    """(key, n_dropped, whole): of how many services a key has lost its cells, and whether none of `services` is left."""
    lost = F.collect_set(F.col("service").cast("string"))
    left = F.array_except(F.array(*(F.lit(s) for s in services)), lost)
    return dropped.groupBy(*key).agg(F.size(lost).alias("n_dropped"), (F.size(left) == 0).alias("whole"))


def run(cells: DataFrame, key: str, decisions: DataFrame, dropped: DataFrame, paired: Column, source_tokens: Sequence[str], anchor: str, english: Column | None = None) -> DataFrame:
    """The whole run, from cells (key, service, term, rationale) to categories: keys out of analysis and dropped cells go, terms are
    corrected, paired cells that lack a half are emptied, then features, rules, and how alike a key's rationales are.

    Every join is on the key; tables of decisions get no hint, as they may grow with the cells.
    """
    out_of_all, _, better = by_hand(decisions, key)
    rows = without(cells.join(out_of_all, key, "left_anti"), dropped, [key])
    rows = C.corrected(rows.withColumn("original_term", F.col("term")), better, [key, "original_term"]).drop("original_term")
    whole = ~paired | X.present(F.col("term")) & ~X.is_empty_rationale(F.col("rationale"))
    rows = rows.withColumns({c: F.when(whole, F.col(c)) for c in ("term", "rationale")})
    judged = disagreement.standard_chain().apply(disagreement.features(rows, [key], source_tokens, anchor, english=english))
    alike = similarity.mean_similarity(rows, key, ["service", "rationale"], "rationale").select(key, F.col("n").alias("n_rationales"), "similarity")
    return judged.join(alike, key, "left").withColumn("n_rationales", F.coalesce("n_rationales", F.lit(0)))
