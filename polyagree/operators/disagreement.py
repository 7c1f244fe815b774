"""Why services disagree: features of each item, and an ordered chain of rules of which the first that holds decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyagree.functions import fixed as V
from polyagree.functions import text as X


class RuleChain:
    """(name, category, condition, evidence) in order; the last condition should hold always."""

    def __init__(self, rules: Sequence[tuple[str, str, Column, Column]]):
        self.rules = list(rules)

    def without(self, *names: str) -> "RuleChain":
        return RuleChain([r for r in self.rules if r[0] not in names])

    def _case(self, part) -> Column:
        out = None
        for rule in self.rules:
            value = part(rule)
            out = F.when(rule[2], value) if out is None else out.when(rule[2], value)
        return out

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"category": self._case(lambda r: F.lit(r[1])), "rule": self._case(lambda r: F.lit(r[0])), "evidence": self._case(lambda r: r[3])})


def greatest_distance(terms: Column) -> Column:
    """The most edits between any two of the terms, 0 for fewer than two. Arrow, as Spark's levenshtein() takes a step for each pair of characters."""

    @F.arrow_udf("int")
    def of(lists):
        import pyarrow as pa

        from polyagree.functions import edits

        return pa.array(edits.greatest(lists.to_pylist()), pa.int32())

    return F.coalesce(of(F.when(F.size(terms) > 1, terms)), F.lit(0))


def features(cells: DataFrame, key: list[str], source_tokens: Sequence[str], anchor: str, normalised=X.folded, english: Column | None = None) -> DataFrame:
    """What the rules ask of each key: n, n_raw, n_norm, max_distance, threshold, borrowed, anchored, scripts, script_disagreement, absence, construction, debate, english.

    cells: key, service, term, rationale; a key has as many rows as there are services, and distances are among its distinct
    normalised terms that are not empty. threshold: 0.15 of their mean length, 2 at least. `anchor`: the service whose presence
    shows a living usage. `english`: whether a row's rationale is to be read; keywords are counted by service and keyword.
    """
    english = F.lit(True) if english is None else english
    why = F.when(english & X.present(F.col("rationale")), F.col("rationale"))
    counted = {k: F.size(X.keywords(why, k)) for k in V.SIGNALS}
    rows = cells.where(X.present(F.col("term"))).withColumns({"raw": F.lower(X.stripped(F.col("term"))), "norm": F.nullif(normalised(F.col("term")), F.lit("")), "script": X.dominant_script(F.col("term")), "__english": english, **counted})
    out = rows.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.size(F.collect_set("raw")).cast("long").alias("n_raw"),  # count_distinct() would be a shuffle more
        F.array_sort(F.collect_set("norm")).alias("norms"),
        F.array_sort(F.array_remove(F.collect_set("script"), "Unknown")).alias("scripts"),
        F.coalesce(F.bool_or(F.col("service") == anchor), F.lit(False)).alias("anchored"),
        F.bool_and("__english").alias("english"),
        *(F.sum(k).alias(k) for k in V.SIGNALS),
    )
    mean = F.aggregate("norms", F.lit(0), lambda a, x: a + F.char_length(x)) / F.greatest(F.size("norms"), F.lit(1))
    tokens = F.flatten(F.transform("norms", lambda x: F.split(x, " ")))
    borrowed = F.array_sort(F.array_intersect(tokens, F.array(*(F.lit(t) for t in source_tokens))))
    return out.withColumns({
        "n_norm": F.size("norms"), "max_distance": greatest_distance(F.col("norms")), "threshold": F.floor(F.greatest(F.lit(2.0), 0.15 * mean)).cast("int"),
        "borrowed": F.array_join(borrowed, ","), "script_disagreement": F.size("scripts") > 1,
    }).drop("norms")


def standard_chain(least_outputs: int = 2, sparse: int = 2, signals: int = 2) -> RuleChain:
    """The nine rules over features(), with the columns script_disagreement, absence and english where they are known."""
    n, raw, norm = F.col("n"), F.col("n_raw"), F.col("n_norm")
    words = F.col("english") & (F.col("absence") >= signals)
    text = lambda s, *c: F.format_string(s, *c)
    return RuleChain([
        ("no_translations", "STRUCTURAL_ABSENCE", n == 0, F.lit("no service gave a term")),
        ("all_agree", "COMPLETE_CONSENSUS", raw == 1, F.lit("all services gave one term")),
        ("script_only", "MEASUREMENT_ARTEFACT", F.col("script_disagreement") & (norm <= 1), text("one term in %d spellings of several scripts", raw)),
        ("normalization", "MEASUREMENT_ARTEFACT", (norm <= 1) | (F.col("max_distance") <= F.col("threshold")), text("%d normalised terms, at most %d edits apart", norm, F.col("max_distance"))),
        ("anchored", "PRODUCTIVE_DISAGREEMENT", F.col("anchored") & (raw >= least_outputs), text("anchored, %d terms", raw)),
        ("loanword", "STRUCTURAL_ABSENCE", F.col("borrowed") != "", text("borrowed: %s", F.col("borrowed"))),
        ("sparse", "STRUCTURAL_ABSENCE", words & (n <= sparse), text("%d services, and they say so", n)),
        ("convergent", "STRUCTURAL_ABSENCE", words & (raw <= 2), text("%d terms, and they say so", raw)),
        ("default", "TRANSMOGRIFICATION", F.lit(True), text("%d terms without an anchor", raw)),
    ])


def flow(features: DataFrame, before: RuleChain, after: RuleChain) -> DataFrame:
    """(before, after, n): how items move between the categories that two chains give them, in one pass over their features."""
    both = features.select(before._case(lambda r: F.lit(r[1])).alias("before"), after._case(lambda r: F.lit(r[1])).alias("after"))
    return both.groupBy("before", "after").agg(F.count("*").alias("n"))


def changed_categories(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """How items move between the categories of two runs."""
    both = a.select(*key, F.col("category").alias("before")).join(b.select(*key, F.col("category").alias("after")), key)
    return both.groupBy("before", "after").agg(F.count("*").alias("n"))
