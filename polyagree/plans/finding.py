"""Queries on what searches find, on registers of definitions, on wide exports and on maps of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyagree.operators import agreement, explorer, projection, registers, results, shaping
from polyagree.sources.files import table

from . import views
from .agreeing import PLURALITY
from .reviewing import PRESENT
from .views import CELLS, TEXTS

KINDS, FIRST, MAJOR = ["A", "N", "R"], "Brand#1", ["Brand#2", "Brand#3"]
FORMS = {"opens_on": [r"\bon\b.*\bthe\b", r"\bthe\b.*\bon\b"], "bound": [r"\b(?:of|by)\s+the\b", r"\band\s+\w+s\b"], "articles": [r"\b(?:der|die|das)\b", r"\b(?:el|los|les?)\b"]}
ORDER, SERVICES = ["TRANSMOGRIFICATION", "MEASUREMENT_ARTEFACT", "COMPLETE_CONSENSUS"], [1, 2, 3, 4, 5, 6, 7]


def _terms(spark, d):
    """Types and names of parts are terms; brands of a quarter of a term's parts are its languages, some have none."""
    term = F.lower(F.concat_ws(" ", "p_type", "p_name"))
    out = table(spark, d, "part").groupBy(term.alias("search_term")).agg(
        F.array_join(F.array_sort(F.expr("collect_set(p_brand) filter (where p_partkey % 4 = 1)")), ", ").alias("natural_language"),
        F.when(F.min("p_partkey") % 3 == 0, "rtl").otherwise("ltr").alias("direction"),
        F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("c"), (F.col("p_size") % 4).cast("string")))), ", ").alias("category"), F.min("p_partkey").alias("least"),
    )
    return out.where("least % 5 <> 0").drop("least")


def _found(spark, d):
    """Orders are found by the terms of their lines' parts, written in capitals with space around."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit(" "), F.upper(F.concat_ws(" ", "p_type", "p_name")), F.lit("\t")).alias("search_term"))
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("id"), "l_partkey").join(parts, "l_partkey").drop("l_partkey")


def result_repeats(spark, d):
    return results.repeats(_found(spark, d), _terms(spark, d))


def term_hits(spark, d):
    return results.hits(_found(spark, d), _terms(spark, d), KINDS).drop("search_term", "natural_language")


def hits_by_direction(spark, d):
    return results.productivity(term_hits(spark, d), "direction")


def hits_by_category(spark, d):
    return results.productivity(term_hits(spark, d).withColumn("category", results.primary(F.col("category"))), "category")


def added_value(spark, d):
    return results.added_value(_found(spark, d), _terms(spark, d), FIRST, MAJOR)


def _brands(spark, d):
    """Families of brands: the remainder of their number; each seventh has none."""
    number = F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int")
    return table(spark, d, "part").select(F.col("p_brand").alias("language"), F.when(number % 7 != 0, F.concat(F.lit("F"), (number % 6).cast("string"))).alias("family")).distinct()


def family_reach(spark, d):
    return results.reached(_found(spark, d), _terms(spark, d), _brands(spark, d), KINDS, FIRST, MAJOR)


def language_reach(spark, d):
    every = _brands(spark, d).select("language", F.col("language").alias("code"))
    return results.reached(_found(spark, d), _terms(spark, d), every, KINDS, FIRST, MAJOR, "code")


def _marked(spark, d):
    """Whole texts with forms of phrase; labels are their flags of review."""
    flags = table(spark, d, "labels").select("doc_id", (F.col("toxic") + 1 - F.col("quality")).alias("flags"))
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "text").join(flags, "doc_id", "left")
    return registers.marked(rows, "text", FORMS, any_bound=["opens_on", "bound"])


def register_rates(spark, d):
    return registers.prevalence(_marked(spark, d), ["source"], list(FORMS))


def register_gaps(spark, d):
    return registers.asymmetry(_marked(spark, d), ["source"], "articles", "any_bound")


def register_by_language(spark, d):
    """Languages are the variants of a source, English the one that others are held against."""
    return registers.by_variant(_marked(spark, d), "source", "lang", list(FORMS), "en")


def flags_by_register(spark, d):
    return registers.flags_by(_marked(spark, d), "flags", list(FORMS))


def disagreement_export(spark, d):
    """Orders with what their lines disagree about: confidence over variants, each line's flag under each variant, the greatest disagreement first."""
    cells = views.cells(spark, d)
    best = agreement.plurality(cells, ["item"])
    category = F.when(F.col("unique_candidates") == 1, ORDER[2]).when(F.col("unique_candidates") == 2, ORDER[1]).otherwise(ORDER[0])
    base = best.select("item", "best_candidate", "unique_candidates", category.alias("category"))
    low = cells.where("service <= 3").select("item", "variant", "service", "term")
    scores = agreement.plurality(cells, ["item", "variant"]).select("item", "variant", F.col("confidence").alias("all"), "agreeing_services", "total_services")
    scores = shaping.keeping_left(scores, agreement.plurality(low, ["item", "variant"]).select("item", "variant", F.col("confidence").alias("first_three")), ["item", "variant"])
    frames = [explorer.confidences(scores, ["item"], "variant", ["O", "F"], ["all", "first_three"]), shaping.wide(cells, ["item"], {"service": SERVICES, "variant": ["F", "O"]}, ["term"])]
    return explorer.export(base, frames, ["item"], "category", ORDER, "unique_candidates")


def rationale_lengths(spark, d):
    return explorer.lengths(views.texts(spark, d), ["doc_id"], "rationale")


def missing_sources(spark, d):
    """Lines of flag N give no term."""
    return explorer.missing(views.cells(spark, d).withColumn("term", F.when(F.col("term") != "N", F.col("term"))), ["item"], "service", SERVICES)


def embedding_map(spark, d):
    """Where vectors lie along the two main directions."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return projection.projected(rows, "embedding").select("vec_id", "label", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


def embedding_clusters(spark, d):
    """How labels lie in ten clusters of vectors."""
    rows = projection.clustered(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), "embedding", 10, seed=3)
    return rows.groupBy("cluster", "label").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        result_repeats, term_hits, hits_by_direction, hits_by_category, added_value, family_reach, language_reach, register_rates, register_gaps, register_by_language, flags_by_register,
        disagreement_export, rationale_lengths, missing_sources, embedding_map, embedding_clusters,
    )
}

_MAJOR = ", ".join(f"'{x}'" for x in [FIRST, *MAJOR])
FOUND = f"""terms AS (SELECT lower(p_type || ' ' || p_name) AS term, coalesce(string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) FILTER (p_partkey % 4 = 1), '') AS natural_language,
 CASE WHEN min(p_partkey) % 3 = 0 THEN 'rtl' ELSE 'ltr' END AS direction, string_agg(DISTINCT 'c' || (p_size % 4), ', ' ORDER BY 'c' || (p_size % 4)) AS category FROM part GROUP BY 1 HAVING min(p_partkey) % 5 <> 0),
 found AS (SELECT l_returnflag AS kind, l_orderkey AS id, lower(p_type || ' ' || p_name) AS term FROM lineitem JOIN part ON l_partkey = p_partkey WHERE lower(p_type || ' ' || p_name) IN (SELECT term FROM terms)),
 langs AS (SELECT term, unnest(string_split(natural_language, ', ')) AS language FROM terms WHERE natural_language <> ''),
 flags AS (SELECT term, bool_or(language = '{FIRST}') AS f, bool_or(language IN ({_MAJOR})) AS m FROM langs GROUP BY 1),
 ids AS (SELECT kind, id, coalesce(bool_or(f), false) AS f, coalesce(bool_or(m), false) AS m FROM found LEFT JOIN flags USING (term) GROUP BY 1, 2)"""
_N = ", ".join(f"count(DISTINCT id) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)
HITS = f"{FOUND}, c AS (SELECT term, {_N} FROM found GROUP BY 1), h AS (SELECT term, direction, category, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in KINDS)} FROM terms LEFT JOIN c USING (term)), hits AS (SELECT *, {' + '.join(f'n_{k}' for k in KINDS)} AS total, {' + '.join(f'n_{k}' for k in KINDS)} > 0 AS any_hit FROM h)"
_BY = "count(*) AS total_terms, count(*) FILTER (any_hit) AS terms_with_hits, CAST(sum(total) AS BIGINT) AS total_results, round(100 * count(*) FILTER (any_hit) / count(*), 1) AS hit_rate_pct, round(sum(total) / nullif(count(*) FILTER (any_hit), 0), 1) AS avg_per_hit"
REACH = """WITH {found}, brands AS (SELECT DISTINCT p_brand AS language, {group} AS g FROM part), each AS (SELECT DISTINCT kind, id, g FROM found JOIN langs USING (term) JOIN brands USING (language) WHERE g IS NOT NULL)
 SELECT g AS {name}, {n}, count(*) AS total, count(*) FILTER (NOT f) AS "unique", CASE WHEN bool_or(f) THEN 'first' WHEN bool_or(m) THEN 'major' ELSE 'multilingual only' END AS reach FROM each JOIN ids USING (kind, id) GROUP BY 1"""
_REACHED = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)


def _form(patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(low, '{p}')" for p in patterns) + ")"


# letters beyond ASCII are letters at the edges of words too, which \b of this dialect does not know
MARKED = rf"""low AS (SELECT *, regexp_replace(lower(text), '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', 'z', 'g') AS low FROM documents WHERE {PRESENT.replace('term', 'text')}),
 forms AS (SELECT doc_id, lang, source, {', '.join(f'{_form(ps)} AS {name}' for name, ps in FORMS.items())} FROM low), marked AS (SELECT *, opens_on OR bound AS any_bound FROM forms)"""
_PERCENT = "round(100 * count(*) FILTER ({0}) / count(*), 1)"
_RATES = ", ".join(f"{_PERCENT.format(n)} AS {n}" for n in FORMS)

ORACLE_SQL = {
    "result_repeats": f"WITH {FOUND} SELECT kind, count(*) AS raw_rows, count(DISTINCT id) AS unique_items, count(DISTINCT term) AS terms_that_hit, round(count(*) / count(DISTINCT id), 1) AS avg_term_hits FROM found GROUP BY 1",
    "term_hits": f"WITH {HITS} SELECT * FROM hits",
    "hits_by_direction": f"WITH {HITS} SELECT direction, {_BY} FROM hits GROUP BY 1",
    "hits_by_category": f"WITH {HITS} SELECT split_part(category, ',', 1) AS category, {_BY} FROM hits GROUP BY 1",
    "added_value": f"""WITH {FOUND}, k AS (SELECT kind, count(*) FILTER (f) AS first_only, count(*) FILTER (m) AS major_only, count(*) AS "full" FROM ids GROUP BY 1)
 SELECT *, "full" - first_only AS added_over_first, "full" - major_only AS added_over_major, round(100 * first_only / "full", 1) AS first_pct, round(100 * major_only / "full", 1) AS major_pct FROM k""",
    "family_reach": REACH.format(found=FOUND, n=_REACHED, name="family", group="CASE WHEN CAST(split_part(p_brand, '#', 2) AS INTEGER) % 7 <> 0 THEN 'F' || (CAST(split_part(p_brand, '#', 2) AS INTEGER) % 6) END"),
    "language_reach": REACH.format(found=FOUND, n=_REACHED, name="code", group="p_brand"),
    "register_rates": f"WITH {MARKED} SELECT source, count(*) AS n, {_RATES} FROM marked GROUP BY 1",
    "register_gaps": f"WITH {MARKED}, r AS (SELECT source, count(*) AS n, {_PERCENT.format('articles')} AS articles, {_PERCENT.format('any_bound')} AS any_bound FROM marked GROUP BY 1) SELECT *, round(articles - any_bound, 1) AS gap FROM r",
    "register_by_language": f"""WITH {MARKED}, r AS (SELECT source, lang, count(*) AS n, {_RATES} FROM marked GROUP BY 1, 2), l AS (UNPIVOT r ON {', '.join(FORMS)} INTO NAME register VALUE percent), b AS (SELECT source, register, percent AS base FROM l WHERE lang = 'en')
 SELECT l.source, lang, l.register, n, percent, round(percent - base, 1) AS effect FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.register = b.register""",
    "flags_by_register": f"""WITH {MARKED}, f AS (SELECT doc_id, toxic + 1 - quality AS k FROM labels), j AS (SELECT marked.*, coalesce(k, 0) AS k FROM marked LEFT JOIN f USING (doc_id))
 {' UNION ALL '.join(f"SELECT '{n}' AS register, count(*) FILTER (x) AS with_n, count(*) FILTER (NOT x) AS without_n, round(avg(k) FILTER (x), 6) AS with_mean, round(avg(k) FILTER (NOT x), 6) AS without_mean, round(avg(k) FILTER (x) - avg(k) FILTER (NOT x), 6) AS difference FROM (SELECT {n} AS x, k FROM j)" for n in FORMS)}""",
    "disagreement_export": f"""WITH {CELLS}, b AS ({PLURALITY.format(key="item", voter="service")}), p AS ({PLURALITY.format(key="item, variant", voter="service")}), low AS (SELECT * FROM cells WHERE service <= 3), q AS ({PLURALITY.format(key="item, variant", voter="service").replace("FROM cells", "FROM low")}),
 c AS (SELECT p.item, round(avg(p.confidence), 6) AS mean_all, round(stddev_samp(p.confidence), 6) AS std_all, round(avg(q.confidence), 6) AS mean_first_three, round(stddev_samp(q.confidence), 6) AS std_first_three, round(avg(p.agreeing_services), 6) AS mean_agreeing, first(p.total_services ORDER BY p.variant DESC) AS n_total FROM p LEFT JOIN q USING (item, variant) GROUP BY 1),
 w AS (SELECT item, {', '.join(f"min(term) FILTER (service = {s} AND variant = '{v}') AS term_{s}_{v.lower()}" for s in SERVICES for v in 'FO')} FROM cells GROUP BY 1),
 g AS (SELECT item, best_candidate, unique_candidates, CASE unique_candidates WHEN 1 THEN '{ORDER[2]}' WHEN 2 THEN '{ORDER[1]}' ELSE '{ORDER[0]}' END AS category FROM b)
 SELECT g.*, c.* EXCLUDE (item), w.* EXCLUDE (item), row_number() OVER (ORDER BY CASE category WHEN '{ORDER[0]}' THEN 0 WHEN '{ORDER[1]}' THEN 1 ELSE 2 END, unique_candidates DESC, g.item) AS place FROM g LEFT JOIN c ON g.item = c.item LEFT JOIN w ON g.item = w.item""",
    "rationale_lengths": f"WITH {TEXTS} SELECT doc_id, round(avg(CASE WHEN {PRESENT.replace('term', 'rationale')} THEN length(rationale) WHEN rationale IS NOT NULL THEN 0 END), 1) AS mean_length FROM texts GROUP BY 1",
    "missing_sources": f"""WITH {CELLS}, h AS (SELECT item, list(DISTINCT service) FILTER (term <> 'N') AS has FROM cells GROUP BY 1), k AS (SELECT item, CAST(coalesce(len(has), 0) AS INTEGER) AS n_services, array_to_string(list_filter({SERVICES}, lambda s: NOT list_contains(coalesce(has, []), s)), '; ') AS missing FROM h)
 SELECT *, CASE WHEN n_services = 0 THEN 'none' WHEN n_services <= 2 THEN 'sparse' WHEN n_services <= 5 THEN 'partial' ELSE 'rich' END AS tier FROM k""",
}
