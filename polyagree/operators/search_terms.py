"""Search terms: chosen by category, grouped over languages, with their directions and the conflicts among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from polyagree.functions import text as X
from polyagree.functions.curation import curated


def select_terms(classified: DataFrame, counts: DataFrame, key: list[str]) -> DataFrame:
    """Consensus: the best term; artefact: those above two cells, or else the best; others: all terms.

    classified: key, category, best_candidate. counts: key, term, n, and what else the result is to hold.
    """
    joined = counts.join(classified, key)
    above = F.max("n").over(Window.partitionBy(*key)) > 2
    kept = (
        F.when(F.col("category") == "COMPLETE_CONSENSUS", F.col("term") == F.col("best_candidate"))
        .when(F.col("category") == "MEASUREMENT_ARTEFACT", F.when(above, F.col("n") > 2).otherwise(F.col("term") == F.col("best_candidate")))
        .otherwise(F.lit(True))
    )
    return joined.withColumn("__kept", kept).where("__kept").select(*key, "category", *(c for c in counts.columns if c not in key))


def corroborated(cells: DataFrame, least: int = 2) -> DataFrame:
    """Terms, in lower case, of `least` cells anywhere or with one valid rationale."""
    found = cells.groupBy(F.lower("term").alias("term")).agg(F.count("*").alias("n"), F.bool_or("valid").alias("valid"))
    return found.where((F.col("n") >= least) | F.col("valid"))


def grouped(terms: DataFrame) -> DataFrame:
    """One row for each term: languages, counts, majority direction, and whether directions conflict. terms: term, language, direction."""
    one = terms.select(F.lower("term").alias("search_term"), "language", "direction").distinct()
    return one.groupBy("search_term").agg(
        F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("natural_language"),
        F.size(F.collect_set("language")).cast("long").alias("counts"),
        F.expr("mode() within group (order by direction)").alias("directionality"),
        F.coalesce(F.min("direction") != F.max("direction"), F.lit(False)).alias("directionality_conflict"),
        F.array_join(F.array_sort(F.expr("collect_set(language) filter (where direction = 'ltr')")), ", ").alias("ltr_languages"),
        F.array_join(F.array_sort(F.expr("collect_set(language) filter (where direction = 'rtl')")), ", ").alias("rtl_languages"),
    )


def split_conflicts(rows: DataFrame) -> DataFrame:
    """A term with conflicting directions becomes a row for each direction."""
    parts = F.array(F.struct(F.lit("ltr").alias("d"), F.col("ltr_languages").alias("l")), F.struct(F.lit("rtl").alias("d"), F.col("rtl_languages").alias("l")))
    single = F.array(F.struct(F.col("directionality").alias("d"), F.col("natural_language").alias("l")))
    exploded = rows.withColumn("x", F.explode(F.when(F.col("directionality_conflict"), parts).otherwise(single)))
    return exploded.select("search_term", F.col("x.d").alias("directionality"), F.col("x.l").alias("natural_language"))


#: The stages of build() that take terms out, in order.
STAGES = ["blank", "placeholder", "leak", "unsafe", "excluded", "uncorroborated"]


def staged(terms: DataFrame, source: str, excluded: DataFrame, least: int = 2, times: str | None = None) -> DataFrame:
    """`terms` (term, language, direction, valid) with `stage`: the first stage that takes the term out, or kept. One pass but for corroboration.

    A term of another language than English may not hold the source term; `excluded` (term) are taken out by hand; a term in lower
    case stands if `least` cells have it or one with a valid rationale. `times`: how many cells a row stands for, if not one.
    """
    n = F.count("*") if times is None else F.sum(times)
    low = terms.withColumn("__low", F.lower(X.stripped(F.col("term"))))
    early = (
        F.when(~X.present(F.col("term")), "blank").when(X.is_placeholder(F.col("term")), "placeholder")
        .when((F.col("language") != "en") & X.leaks_source(F.col("term"), source), "leak").when(X.is_search_unsafe(F.col("term")), "unsafe")
    )
    low = low.withColumn("__stage", early).join(excluded.select(F.lower("term").alias("__low"), F.lit(True).alias("__out")).distinct(), "__low", "left")
    low = low.withColumn("__stage", F.coalesce("__stage", F.when(F.col("__out"), "excluded")))
    if times is None:
        backed = low.where("__stage is null").groupBy("__low").agg(((n >= least) | F.bool_or("valid")).alias("__backed"))
        low = low.join(backed, "__low", "left")
    else:  # alike terms are one row, so a window holds few rows, and nothing before it is computed or shuffled twice
        within, open_ = Window.partitionBy("__low"), F.col("__stage").isNull()
        low = low.withColumn("__backed", (F.sum(F.when(open_, F.col(times))).over(within) >= least) | F.bool_or(F.when(open_, F.col("valid"))).over(within))
    return low.select(*terms.columns, F.coalesce("__stage", F.when(~F.col("__backed"), "uncorroborated"), F.lit("kept")).alias("stage"))


def build(terms: DataFrame, source: str, excluded: DataFrame, least: int = 2) -> DataFrame:
    """grouped() of the terms that all stages keep. Alike terms are one row with their number from the start, so the stages read each once."""
    one = terms.groupBy("term", "language", "direction").agg(F.count("*").alias("__n"), F.bool_or("valid").alias("valid"))
    return grouped(staged(one, source, excluded, least, "__n").where("stage = 'kept'").withColumn("term", X.stripped(F.col("term"))))


def built_and_counted(cells: DataFrame, classified: DataFrame, key: list[str], source: str, excluded: DataFrame, least: int = 2) -> tuple[DataFrame, Observation]:
    """build() of the terms that each item's category selects, repaired where they mix scripts, and the number of terms at each stage.

    cells: key with `language`, term, direction, valid. classified: key, category, best_candidate. The stages are those of STAGES, and `uncurated`
    for a term that has no repair. The counts come with the first action on the result (`get` of the observation), so no second job counts them.
    A term of several directions in an item counts as right to left, and one valid rationale makes it valid. Alike terms of all items are one row with
    their number before they are repaired. Cells are shuffled by key alone, which serves all steps up to there; a table `classified` that is dealt by key too is not shuffled again.
    """
    terms = cells.repartition(*key).groupBy(*key, "term").agg(F.count("*").alias("n"), F.max("direction").alias("direction"), F.bool_or("valid").alias("valid"))
    chosen = select_terms(classified, terms.where("term is not null"), key)
    chosen = chosen.groupBy("term", "language", "direction", "valid").agg(F.count("*").alias("__n"))
    repaired = curated(chosen, "term").select("__n", "language", "direction", "valid", F.col("term_curated").alias("term"), (F.col("term").isNotNull() & F.col("term_curated").isNull()).alias("__lost"))
    marked = staged(repaired, source, excluded, least, "__n").withColumn("stage", F.when(F.col("__lost"), "uncurated").otherwise(F.col("stage"))).drop("__lost")
    counts = Observation()
    marked = marked.observe(counts, *(F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("__n"))), F.lit(0)).alias(s) for s in ["uncurated", *STAGES, "kept"]))
    return grouped(marked.where("stage = 'kept'").withColumn("term", X.stripped(F.col("term")))), counts


def resolve_conflicts(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of grouped() with conflicts decided: set-ltr or set-rtl gives a term one direction, split a row for each; others stay. decisions: search_term, decision."""
    both = rows.join(decisions.select("search_term", F.col("decision").alias("__d")), "search_term", "left")
    fixed = F.when(F.col("__d") == "set-ltr", "ltr").when(F.col("__d") == "set-rtl", "rtl")
    one = both.where(F.coalesce(F.col("__d"), F.lit("")) != "split").select("search_term", F.coalesce(fixed, "directionality").alias("directionality"), "natural_language")
    return one.unionByName(split_conflicts(both.where("__d = 'split'").drop("__d")))
