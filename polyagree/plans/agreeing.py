"""Queries on agreement, disagreement and search terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyagree.functions import fixed as V
from polyagree.functions import text as X
from polyagree.operators import agreement, cells, disagreement, search_terms

from . import views
from .views import CELLS, PAIRS, SP, TEXTS

PLURALITY = """SELECT {key}, first(term ORDER BY n DESC, first_voter, term) AS best_candidate, max(n) AS agreeing_services, CAST(sum(n) AS BIGINT) AS total_services, count(*) AS unique_candidates,
 round(max(n) / sum(n), 4) AS confidence FROM (SELECT {key}, term, count(*) AS n, min({voter}) AS first_voter FROM cells GROUP BY {key}, term) GROUP BY {key}"""
SPREAD = "count({v}) AS n, round(avg({v}), 6) AS mean, round(median({v}), 6) AS median, round(stddev_samp({v}), 6) AS std, round(stddev_samp({v}) / avg({v}), 6) AS cv"


def agreement_within_variant(spark, d):
    return agreement.plurality(views.cells(spark, d), ["item", "variant"])


def agreement_summary(spark, d):
    return agreement.spread(agreement_within_variant(spark, d), ["variant"], "confidence")


def stability_across_variants(spark, d):
    numbered = views.cells(spark, d).withColumn("place", F.when(F.col("variant") == "F", 0).otherwise(1))
    return agreement.plurality(numbered, ["item", "service"], voter="place")


def service_stability_summary(spark, d):
    return agreement.spread(stability_across_variants(spark, d), ["service"], "confidence")


def consensus_all_cells(spark, d):
    who = {"services": F.size(F.collect_set("service")).cast("long"), "variants": F.size(F.collect_set("variant")).cast("long")}
    return agreement.plurality(views.cells(spark, d), ["item"], **who)


def term_distribution(spark, d):
    return agreement.distribution(views.cells(spark, d), ["item"])


def service_matrix(spark, d):
    """Rates of agreement of all services with all, each with itself too."""
    rows = views.cells(spark, d)
    pairs = agreement.pairwise(rows, ["item", "variant"])
    return agreement.similarity_matrix(pairs, rows.select(F.col("service").alias("a")).distinct())


def pairwise_service_agreement(spark, d):
    return agreement.pairwise(views.cells(spark, d), ["item", "variant"])


def variant_similarity(spark, d):
    return agreement.pairwise(views.cells(spark, d), ["item", "service"], voter="variant")


def normalised_confidence(spark, d):
    """Agreement by text as it is and by lower-cased text, and the gain."""
    rows = views.texts(spark, d).withColumn("voter", F.col("doc_id"))
    exact = agreement.plurality(rows, ["language"], "voter").select("language", F.col("confidence").alias("exact"))
    loose = agreement.plurality(rows.withColumn("term", F.trim(F.lower("term"))), ["language"], "voter").select("language", F.col("confidence").alias("loose"))
    return exact.join(loose, "language").withColumn("gain", F.round(F.col("loose") - F.col("exact"), 4))


def majority_outliers(spark, d):
    """Cells whose term is not the one of most cells of their item and variant."""
    best = agreement_within_variant(spark, d).where("agreeing_services * 2 > total_services").select("item", "variant", "best_candidate")
    return views.cells(spark, d).join(best, ["item", "variant"]).where("term <> best_candidate").select("item", "variant", "service", "term", "best_candidate")


def fully_divergent(spark, d):
    """Places of twelve documents at which four or more have a sentence, and a quarter or less the same one."""
    rows = views.texts(spark, d).withColumn("item", F.expr("doc_id div 12"))
    return agreement.plurality(rows, ["item", "pos"], "doc_id").where("total_services >= 4 and confidence <= 0.25").select("item", "pos", "total_services", "agreeing_services")


def pairing_enforced(spark, d):
    return cells.enforce_pairs(views.pairs(spark, d)).select("conv_id", "turn", F.col("term").isNotNull().alias("has_term"), F.char_length("rationale").cast("long").alias("rationale_chars"))


def difference_categories(spark, d):
    """Pairs of distinct sentences of a language and source that differ in case only, or by content: counts, from those of groups and without a row for any pair."""
    pairs = lambda n: (n * (n - 1) / 2).cast("long")
    one = views.texts(spark, d).select("language", "service", "term").distinct()
    folds = one.groupBy("language", "service", F.lower("term").alias("fold")).agg(F.count("*").alias("n"))
    sums = folds.groupBy("language", "service").agg(F.sum(pairs(F.col("n"))).alias("case"), F.sum("n").alias("n"))
    kinds = F.array(F.struct(F.lit("capitalization").alias("kind"), F.col("case").alias("n")), F.struct(F.lit("content").alias("kind"), (pairs(F.col("n")) - F.col("case")).alias("n")))
    return sums.select("language", "service", F.explode(kinds).alias("k")).select("language", "service", "k.kind", "k.n").where("n > 0")


def difference_tiers(spark, d):
    one = views.texts(spark, d).select("language", F.col("term").alias("t"), F.lower(F.regexp_replace("term", "[.,]", "")).alias("k"))
    kinds = one.groupBy("language", "k").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    first = F.transform("ts", lambda x: X.difference(x, F.col("ts")[0]))
    return kinds.groupBy("language", X.tier_of_differences(F.array_distinct(first)).alias("tier")).agg(F.count("*").alias("n"))


def _features(spark, d):
    """Twelve documents in a row stand for services, and their sentences at one place for the terms of an item."""
    rows = views.texts(spark, d).withColumn("group", F.expr("doc_id div 12"))
    return disagreement.features(rows, ["group", "pos", "language"], ["the", "of", "and"], "src1", english=F.col("language") == "en")


def disagreement_rules(spark, d):
    out = disagreement.standard_chain().apply(_features(spark, d))
    return out.select("group", "pos", "language", "n", "n_raw", "n_norm", "max_distance", "threshold", "borrowed", "anchored", "script_disagreement", "absence", "category", "rule", "evidence")


def keyword_ablation_flow(spark, d):
    chain = disagreement.standard_chain()
    return disagreement.flow(_features(spark, d), chain, chain.without("sparse", "convergent"))


def category_shares(spark, d):
    from pyspark.sql import Window

    counts = disagreement_rules(spark, d).groupBy("language", "category").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("language")), 6))


KEYWORDS = ", ".join("'" + k.replace("'", "''") + "'" for k in V.SIGNALS["absence"])
STEPS = rf"""f1 AS (SELECT doc_id // 12 AS "group", pos, language, service, trim(lower(term), {SP}) AS raw,
 trim(regexp_replace(regexp_replace(strip_accents(lower(term)), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS norm, CASE WHEN regexp_matches(term, '\p{{L}}') THEN 'Latin' ELSE 'Unknown' END AS script,
 CASE WHEN language = 'en' AND rationale IS NOT NULL AND lower(trim(rationale, {SP})) NOT IN ('', 'nan', 'none', 'null') THEN len(list_filter([{KEYWORDS}], lambda k: regexp_matches(rationale, '(?i)' || k))) ELSE 0 END AS absence
 FROM texts WHERE lower(trim(term, {SP})) NOT IN ('', 'nan', 'none', 'null')),
f2 AS (SELECT "group", pos, language, count(*) AS n, count(DISTINCT raw) AS n_raw, list_filter(list(DISTINCT norm), lambda x: x <> '') AS norms, coalesce(bool_or(service = 'src1'), false) AS anchored, CAST(sum(absence) AS BIGINT) AS absence,
 count(DISTINCT CASE WHEN script <> 'Unknown' THEN script END) > 1 AS script_disagreement FROM f1 GROUP BY 1, 2, 3),
f3 AS (SELECT *, CAST(len(norms) AS INTEGER) AS n_norm, list_transform(norms, lambda x: replace(x, 'ß', '~')) AS plain,
 list_sort(list_distinct(list_filter(flatten(list_transform(norms, lambda x: string_split(x, ' '))), lambda w: w IN ('the', 'of', 'and')))) AS loans FROM f2),
f4 AS (SELECT *, CAST(coalesce(list_max(list_transform(plain, lambda a: list_max(list_transform(plain, lambda b: levenshtein(a, b))))), 0) AS INTEGER) AS max_distance,
 CAST(greatest(2, floor(0.15 * coalesce(list_sum(list_transform(norms, lambda x: length(x))) / len(norms), 0))) AS INTEGER) AS threshold, array_to_string(loans, ',') AS borrowed FROM f3),
rules AS (SELECT *, CASE WHEN n_raw = 1 THEN 'all_agree' WHEN script_disagreement AND n_norm <= 1 THEN 'script_only' WHEN n_norm <= 1 OR max_distance <= threshold THEN 'normalization' WHEN anchored AND n_raw >= 2 THEN 'anchored' WHEN borrowed <> '' THEN 'loanword'
 WHEN language = 'en' AND absence >= 2 AND n <= 2 THEN 'sparse' WHEN language = 'en' AND absence >= 2 AND n_raw <= 2 THEN 'convergent' ELSE 'default' END AS rule FROM f4),
kinds AS (SELECT "group", pos, language, n, n_raw, n_norm, max_distance, threshold, borrowed, anchored, script_disagreement, absence, rule, CASE rule WHEN 'all_agree' THEN 'COMPLETE_CONSENSUS' WHEN 'script_only' THEN 'MEASUREMENT_ARTEFACT' WHEN 'normalization' THEN 'MEASUREMENT_ARTEFACT'
 WHEN 'anchored' THEN 'PRODUCTIVE_DISAGREEMENT' WHEN 'default' THEN 'TRANSMOGRIFICATION' ELSE 'STRUCTURAL_ABSENCE' END AS category, CASE rule WHEN 'all_agree' THEN 'all services gave one term'
 WHEN 'script_only' THEN 'one term in ' || n_raw || ' spellings of several scripts' WHEN 'normalization' THEN n_norm || ' normalised terms, at most ' || max_distance || ' edits apart' WHEN 'anchored' THEN 'anchored, ' || n_raw || ' terms'
 WHEN 'loanword' THEN 'borrowed: ' || borrowed WHEN 'sparse' THEN n || ' services, and they say so' WHEN 'convergent' THEN n_raw || ' terms, and they say so' ELSE n_raw || ' terms without an anchor' END AS evidence FROM rules)"""
FEATURES = f"{TEXTS}, {STEPS}"


def term_selection(spark, d):
    rows = views.cells(spark, d)
    best = agreement.plurality(rows, ["item"])
    named = best.select("item", "best_candidate", F.when(F.col("unique_candidates") == 1, "COMPLETE_CONSENSUS").when(F.col("unique_candidates") == 2, "MEASUREMENT_ARTEFACT").otherwise("TRANSMOGRIFICATION").alias("category"))
    return search_terms.select_terms(named, rows.groupBy("item", "term").agg(F.count("*").alias("n")), ["item"])


def _directed(spark, d):
    rows = views.texts(spark, d).where("length(term) >= 2")
    return rows.select("term", "language", F.when(F.col("doc_id") % 11 == 0, "rtl").otherwise("ltr").alias("direction"))


def search_terms_grouped(spark, d):
    return search_terms.grouped(_directed(spark, d))


def direction_conflicts(spark, d):
    return search_terms.grouped(_directed(spark, d)).where("directionality_conflict").select("search_term", "ltr_languages", "rtl_languages")


def conflict_split(spark, d):
    return search_terms.split_conflicts(search_terms.grouped(_directed(spark, d)))


def corroborated_terms(spark, d):
    return search_terms.corroborated(views.texts(spark, d).withColumn("valid", F.col("doc_id") % 50 == 0))


GROUPED = f"""{TEXTS}, x AS (SELECT DISTINCT lower(term) AS search_term, language, CASE WHEN doc_id % 11 = 0 THEN 'rtl' ELSE 'ltr' END AS direction FROM texts WHERE length(term) >= 2),
y AS (SELECT search_term, count(DISTINCT language) AS counts, array_to_string(list_sort(list(DISTINCT language)), ', ') AS natural_language, count(*) FILTER (direction = 'ltr') AS l, count(*) FILTER (direction = 'rtl') AS r,
 array_to_string(list_sort(coalesce(list(DISTINCT language) FILTER (direction = 'ltr'), [])), ', ') AS ltr_languages, array_to_string(list_sort(coalesce(list(DISTINCT language) FILTER (direction = 'rtl'), [])), ', ') AS rtl_languages FROM x GROUP BY 1),
g AS (SELECT search_term, natural_language, counts, CASE WHEN l >= r THEN 'ltr' ELSE 'rtl' END AS directionality, l > 0 AND r > 0 AS directionality_conflict, ltr_languages, rtl_languages FROM y)"""


def manual_exclusions(spark, d):
    """Cells under the three analysis modes: how many terms stay."""
    rows = views.cells(spark, d)
    tiers = rows.select("item", F.when(F.col("item") % 10 == 0, "likely_error").when(F.col("item") % 10 == 1, "likely_search_complication").otherwise("keep").alias("tier")).distinct()
    out = None
    for mode in ("full", "quality", "search_ready"):
        one = cells.apply_exclusions(rows, tiers, ["item"], mode).agg(F.lit(mode).alias("mode"), F.count("*").alias("n_rows"), F.count("term").alias("n_terms"))
        out = one if out is None else out.unionByName(one)
    return out


def judge_context(spark, d):
    """Per item, the distinct terms with the services that gave each, most frequent first."""
    by = views.cells(spark, d).groupBy("item", "term").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("service")).alias("s"))
    line = F.concat(F.lit("("), F.array_join(F.transform("s", lambda x: x.cast("string")), ", "), F.lit('): "'), F.col("term"), F.lit('"'))
    lists = by.groupBy("item").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "term", line.alias("line")))).alias("x"))
    return lists.select("item", F.array_join(F.transform("x", lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["line"])), "; ").alias("context"))


QUERIES = {f.__name__: f for f in (agreement_within_variant, agreement_summary, stability_across_variants, service_stability_summary, consensus_all_cells, term_distribution, service_matrix, pairwise_service_agreement, variant_similarity, normalised_confidence, majority_outliers, fully_divergent, pairing_enforced, difference_categories, difference_tiers, disagreement_rules, keyword_ablation_flow, category_shares, term_selection, search_terms_grouped, direction_conflicts, conflict_split, corroborated_terms, manual_exclusions, judge_context)}

PV = PLURALITY.format(key="item, variant", voter="service")
PS = PLURALITY.format(key="item, service", voter="CASE WHEN variant = 'F' THEN 0 ELSE 1 END")
PI = PLURALITY.format(key="item", voter="service")
DIFF = "CASE WHEN {a} = {b} THEN 'identical' WHEN lower({a}) = lower({b}) THEN 'capitalization' ELSE 'content' END"

ORACLE_SQL = {
    "agreement_within_variant": f"WITH {CELLS} {PV}",
    "agreement_summary": f"WITH {CELLS}, p AS ({PV}) SELECT variant, {SPREAD.format(v='confidence')} FROM p GROUP BY variant",
    "stability_across_variants": f"WITH {CELLS} {PS}",
    "service_stability_summary": f"WITH {CELLS}, p AS ({PS}) SELECT service, {SPREAD.format(v='confidence')} FROM p GROUP BY service",
    "consensus_all_cells": f"WITH {CELLS}, p AS ({PI}) SELECT p.*, (SELECT count(DISTINCT service) FROM cells c WHERE c.item = p.item AND c.term = p.best_candidate) AS services, (SELECT count(DISTINCT variant) FROM cells c WHERE c.item = p.item AND c.term = p.best_candidate) AS variants FROM p",
    "term_distribution": f"WITH {CELLS}, c AS (SELECT item, term, count(*) AS n FROM cells GROUP BY 1, 2) SELECT item, string_agg(term || ' (' || n || ')', '; ' ORDER BY n DESC, term) AS distribution FROM c GROUP BY 1",
    "service_matrix": f"WITH {CELLS} SELECT x.service AS a, y.service AS b, CASE WHEN x.service = y.service THEN 1.0 ELSE round(count(*) FILTER (x.term = y.term) / count(*), 6) END AS rate FROM cells x JOIN cells y ON x.item = y.item AND x.variant = y.variant GROUP BY x.service, y.service",
    "pairwise_service_agreement": f"WITH {CELLS} SELECT x.service AS a, y.service AS b, count(*) AS shared, count(*) FILTER (x.term = y.term) AS alike, round(count(*) FILTER (x.term = y.term) / count(*), 6) AS rate FROM cells x JOIN cells y ON x.item = y.item AND x.variant = y.variant AND x.service < y.service GROUP BY 1, 2",
    "variant_similarity": f"WITH {CELLS} SELECT x.variant AS a, y.variant AS b, count(*) AS shared, count(*) FILTER (x.term = y.term) AS alike, round(count(*) FILTER (x.term = y.term) / count(*), 6) AS rate FROM cells x JOIN cells y ON x.item = y.item AND x.service = y.service AND x.variant < y.variant GROUP BY 1, 2",
    "normalised_confidence": rf"WITH {TEXTS}, a AS (SELECT language, max(n) / sum(n) AS e FROM (SELECT language, term, count(*) AS n FROM texts WHERE term <> '' GROUP BY 1, 2) GROUP BY 1), b AS (SELECT language, max(n) / sum(n) AS l FROM (SELECT language, trim(lower(term)) AS t, count(*) AS n FROM texts GROUP BY 1, 2) WHERE t <> '' GROUP BY 1) SELECT language, round(e, 4) AS exact, round(l, 4) AS loose, round(round(l, 4) - round(e, 4), 4) AS gain FROM a JOIN b USING (language)",
    "majority_outliers": f"WITH {CELLS}, p AS ({PV}) SELECT c.item, c.variant, c.service, c.term, p.best_candidate FROM cells c JOIN p ON c.item = p.item AND c.variant = p.variant WHERE agreeing_services * 2 > total_services AND c.term <> p.best_candidate",
    "fully_divergent": f"WITH {TEXTS}, c AS (SELECT doc_id // 12 AS item, pos, term, count(*) AS n FROM texts WHERE term <> '' GROUP BY 1, 2, 3) SELECT item, pos, CAST(sum(n) AS BIGINT) AS total_services, max(n) AS agreeing_services FROM c GROUP BY 1, 2 HAVING sum(n) >= 4 AND max(n) <= 0.25 * sum(n)",
    "pairing_enforced": f"WITH {PAIRS} SELECT conv_id, turn, coalesce(ok, false) AS has_term, CASE WHEN ok THEN length(rationale) END AS rationale_chars FROM (SELECT *, lower(trim(term, {SP})) NOT IN ('', 'nan', 'none', 'null') AND lower(trim(rationale, {SP})) NOT IN ('', 'nan', 'none', 'null') AND lower(rtrim(trim(rationale, {SP}), '.')) NOT IN ('no rationale provided', 'no rationale', 'n/a', 'none', 'not applicable', 'no explanation provided', 'no reason provided') AS ok FROM pairs)",
    "difference_categories": f"WITH {TEXTS}, o AS (SELECT DISTINCT language, service, term FROM texts) SELECT x.language, x.service, {DIFF.format(a='x.term', b='y.term')} AS kind, count(*) AS n FROM o x JOIN o y ON x.language IS NOT DISTINCT FROM y.language AND x.service IS NOT DISTINCT FROM y.service AND x.term < y.term GROUP BY 1, 2, 3",
    "difference_tiers": rf"WITH {TEXTS}, k AS (SELECT language, lower(regexp_replace(term, '[.,]', '', 'g')) AS k, list_sort(list(DISTINCT term)) AS ts FROM texts GROUP BY 1, 2) SELECT language, CASE WHEN len(ts) = 1 THEN 'all_identical' WHEN len(list_filter(ts, lambda t: lower(t) <> lower(ts[1]))) > 0 THEN 'has_content' ELSE 'trivial_only' END AS tier, count(*) AS n FROM k GROUP BY 1, 2",
    "disagreement_rules": f"WITH {FEATURES} SELECT * FROM kinds",
    "keyword_ablation_flow": f"""WITH {FEATURES} SELECT category AS before, CASE WHEN rule IN ('sparse', 'convergent') THEN 'TRANSMOGRIFICATION' ELSE category END AS after, count(*) AS n FROM kinds GROUP BY 1, 2""",
    "category_shares": f"WITH {FEATURES}, c AS (SELECT language, category, count(*) AS n FROM kinds GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY language), 6) AS share FROM c",
    "term_selection": f"WITH {CELLS}, p AS ({PI}), n AS (SELECT item, term, count(*) AS n FROM cells GROUP BY 1, 2), j AS (SELECT n.*, best_candidate, CASE unique_candidates WHEN 1 THEN 'COMPLETE_CONSENSUS' WHEN 2 THEN 'MEASUREMENT_ARTEFACT' ELSE 'TRANSMOGRIFICATION' END AS category, max(n) OVER (PARTITION BY n.item) > 2 AS above FROM n JOIN p ON n.item = p.item) SELECT item, category, term, n FROM j WHERE CASE category WHEN 'COMPLETE_CONSENSUS' THEN term = best_candidate WHEN 'MEASUREMENT_ARTEFACT' THEN CASE WHEN above THEN n > 2 ELSE term = best_candidate END ELSE true END",
    "search_terms_grouped": f"WITH {GROUPED} SELECT * FROM g",
    "direction_conflicts": f"WITH {GROUPED} SELECT search_term, ltr_languages, rtl_languages FROM g WHERE directionality_conflict",
    "conflict_split": f"WITH {GROUPED} SELECT search_term, 'ltr' AS directionality, ltr_languages AS natural_language FROM g WHERE directionality_conflict UNION ALL SELECT search_term, 'rtl', rtl_languages FROM g WHERE directionality_conflict UNION ALL SELECT search_term, directionality, natural_language FROM g WHERE NOT directionality_conflict",
    "corroborated_terms": f"WITH {TEXTS} SELECT lower(term) AS term, count(*) AS n, bool_or(doc_id % 50 = 0) AS valid FROM texts GROUP BY 1 HAVING count(*) >= 2 OR bool_or(doc_id % 50 = 0)",
    "manual_exclusions": f"WITH {CELLS} SELECT m.mode, count(*) AS n_rows, count(*) FILTER (m.mode = 'full' OR item % 10 > 1 OR (m.mode = 'quality' AND item % 10 = 1)) AS n_terms FROM cells, (VALUES ('full'), ('quality'), ('search_ready')) m(mode) GROUP BY 1",
    "judge_context": f"""WITH {CELLS}, t AS (SELECT item, term, count(*) AS n, '(' || array_to_string(list_sort(list(DISTINCT service)), ', ') || '): "' || term || '"' AS line FROM cells GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, term) AS i FROM t) SELECT item, string_agg(i || '. ' || line, '; ' ORDER BY i) AS context FROM r GROUP BY item""",
}
