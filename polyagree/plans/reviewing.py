"""Queries on review signals, search-term building, convergence, alignment, reshaping and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyagree.functions import fixed as V
from polyagree.functions import text as X
from polyagree.operators import agreement, families, registry, review, search_terms, shaping
from polyagree.sources.files import table

from . import views
from .agreeing import PLURALITY
from .curating import _registry
from .views import CELLS, SP, TEXTS

SIGNALS = ("has_repetition_loop", "has_placeholder_term", "has_unicode_escape", "has_extreme_term_length", "has_short_translation", "has_unsafe_characters", "has_refusal_rationale", "has_transliteration_rationale", "has_placeholder_rationale")
PATTERNS = {"questions": [r"\bwhat\b", r"\bhow\b", r"\?\s*$"], "requests": [r"\bplease\b", r"\bcan\s+you\b"], "articles": [r"\bthe\b"]}
TOKENS = ["the", "of", "and"]


def _documents(spark, d):
    """Twelve documents in a row are the cells of an item, whole texts its terms and rationales."""
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select(F.expr("doc_id div 12").alias("item"), F.col("source").alias("service"), F.col("text").alias("term"), F.col("text").alias("rationale"), F.col("doc_id"))


def _sentences(spark, d):
    return views.texts(spark, d).withColumn("item", F.expr("doc_id div 12"))


def _signals(spark, d):
    conditions = review.term_signals(F.col("term"), F.col("rationale"), "the thing")
    conditions["has_extreme_term_length"] = X.is_extreme_length(F.col("term"), 4000)
    return review.signals(_documents(spark, d), ["item"], "service", {k: conditions[k] for k in SIGNALS})


def review_signals(spark, d):
    return _signals(spark, d)


def review_tiers(spark, d):
    return review.summary(_documents(spark, d), _signals(spark, d), ["item"])


def exclusion_tiers(spark, d):
    rows = _documents(spark, d).where("doc_id % 50 = 0")
    decided = rows.select("item", F.when(F.col("doc_id") % 100 == 0, "likely_error").otherwise("likely_search_complication").alias("tier"))
    return review.exclusions(decided, _signals(spark, d), ["item"])


def _terms(spark, d):
    rows = _sentences(spark, d)
    direction = F.when(F.col("doc_id") % 11 == 0, "rtl").otherwise("ltr").alias("direction")
    return rows.select("term", "language", direction, (F.col("doc_id") % 5 == 0).alias("valid")), rows.where("doc_id % 97 = 0").select("term")


def search_terms_built(spark, d):
    terms, excluded = _terms(spark, d)
    return search_terms.build(terms, "the thing", excluded)


def _selected(spark, d):
    """Selection, repair and all stages over sentences: consensus where an item's place has one term, an artefact of two, else a disagreement."""
    cells = _sentences(spark, d).select("item", "pos", "language", "term", "doc_id", F.when(F.col("doc_id") % 11 == 0, "rtl").otherwise("ltr").alias("direction"), (F.col("doc_id") % 5 == 0).alias("valid"))
    best = agreement.plurality(cells.repartition("item", "pos", "language"), ["item", "pos", "language"], "doc_id")
    category = F.when(F.col("unique_candidates") == 1, "COMPLETE_CONSENSUS").when(F.col("unique_candidates") == 2, "MEASUREMENT_ARTEFACT").otherwise("TRANSMOGRIFICATION")
    classified = best.select("item", "pos", "language", "best_candidate", category.alias("category"))
    return search_terms.built_and_counted(cells, classified, ["item", "pos", "language"], "the thing", cells.where("doc_id % 97 = 0").select("term"))


def search_terms_selected(spark, d):
    return _selected(spark, d)[0]


def search_term_stages(spark, d):
    """How many sentences each stage of the build takes out."""
    terms, excluded = _terms(spark, d)
    return search_terms.staged(terms, "the thing", excluded).groupBy("stage").agg(F.count("*").alias("n"))


def convergence_detail(spark, d):
    return review.convergence(_sentences(spark, d), ["item", "pos"])


def convergence_shares(spark, d):
    return review.shares(convergence_detail(spark, d), "label")


def convergence_by_sources(spark, d):
    rows = convergence_detail(spark, d)
    agree = (F.col("n_present") > 1) & (F.col("n_distinct") == 1)
    return rows.groupBy("n_present").agg(F.count("*").alias("items"), F.count_if(agree).alias("agree"), F.round(F.count_if(agree) / F.count("*"), 6).alias("rate"))


def source_presence(spark, d):
    return review.presence(_sentences(spark, d), ["item", "pos"], "service")


def anchor_alignment(spark, d):
    return review.alignment(_sentences(spark, d), ["item", "pos"], "service", "src1")


def service_profiles(spark, d):
    return review.profile(_sentences(spark, d), ["service"], "term", F.col("rationale"))


def _scripted(spark, d):
    """Sentences, each in the script of its document's kind."""
    return _sentences(spark, d).withColumn("term", views.scripted(F.col("term")))


def script_outliers(spark, d):
    return review.script_agreement(_scripted(spark, d), ["item", "pos"], "doc_id")


def script_sides(spark, d):
    """Scripts of local services, each third document, beside those of the others."""
    local = F.col("doc_id") % 3 == 0
    return review.side_scripts(_scripted(spark, d), ["item", "pos"], {"local": local, "api": ~local})


#: All signals of a cell, and the groups that a review reads them in.
ALL_SIGNALS = ("has_repetition_loop", "has_mixed_script", "has_any_mixing", "has_placeholder_term", "has_unicode_escape", "has_extreme_term_length", "has_short_translation", "has_source_term", "has_unsafe_characters", "has_romanization", "has_language_name", "has_missing_rationale", "has_refusal_rationale", "has_transliteration_rationale", "has_placeholder_rationale", "has_foreign_rationale")
GROUPS = {"term": ["has_repetition_loop", "has_placeholder_term", "has_unicode_escape", "has_extreme_term_length", "has_short_translation", "has_unsafe_characters"], "script": ["has_mixed_script", "has_any_mixing", "has_romanization"], "source": ["has_source_term", "has_language_name"], "rationale": ["has_missing_rationale", "has_refusal_rationale", "has_transliteration_rationale", "has_placeholder_rationale", "has_foreign_rationale"]}
LANGUAGE, SOURCE = "the", "of the"


def _all_signals(spark, d):
    """All sixteen signals of sentences in the scripts of their documents; the next sentence is the rationale, of documents of the fifth kind in their script too."""
    rows = _scripted(spark, d).withColumn("rationale", F.when(F.col("doc_id") % 5 == 4, views.scripted(F.col("rationale"))).otherwise(F.col("rationale")))
    conditions = review.term_signals(F.col("term"), F.col("rationale"), SOURCE, F.lit(LANGUAGE), mix=F.col("mix"))
    return rows, review.signals(rows.withColumn("mix", X.mix(F.col("term"))), ["item", "pos"], "doc_id", {k: conditions[k] for k in ALL_SIGNALS})


def all_signals(spark, d):
    return _all_signals(spark, d)[1]


def signal_counts(spark, d):
    rows, found = _all_signals(spark, d)
    return review.counted(rows, found, ["item", "pos"], GROUPS)


def signals_wide(spark, d):
    rows, found = _all_signals(spark, d)
    return review.wide(rows, found, ["item", "pos"], ALL_SIGNALS)


def pattern_rates(spark, d):
    return review.pattern_rates(table(spark, d, "conversations"), ["role"], "text", PATTERNS)


def borrow_bands(spark, d):
    return review.borrowing(_sentences(spark, d), ["item", "pos"], "doc_id", "term", TOKENS)


def refused_elsewhere(spark, d):
    return review.refused_elsewhere(_sentences(spark, d), ["item", "pos"], "doc_id", F.startswith(F.lower("term"), F.lit("the")))


def unpaired_recovery(spark, d):
    raw = views.pairs(spark, d)
    paired = raw.withColumn("term", F.when(F.col("rationale").isNotNull(), F.col("term"))).select("conv_id", "turn", "term")
    return review.recovered(paired, raw, ["conv_id", "turn"]).select("conv_id", "turn", F.char_length("shown").cast("long").alias("chars"), "unpaired")


def variant_matrix(spark, d):
    rows = views.cells(spark, d).withColumn("service", F.col("service").cast("string"))
    return shaping.wide(rows, ["item"], {"service": [str(i) for i in range(1, 8)], "variant": ["F", "O"]}, ["term"])


def part_measures(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"))
    return shaping.melted(rows, ["p_partkey"], ["p_size", "p_retailprice"], "measure", "x")


def order_totals(spark, d):
    return shaping.totals(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", F.count("*"))


def nation_totals(spark, d):
    one = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    two = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return shaping.outer_chain([one, two], ["nation"])


def part_use(spark, d):
    """Parts with their lines, quantities and returns, zero where there is none."""
    lines = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    all_, back = lines.groupBy("p_partkey").agg(F.count("*").alias("n")), lines.where("l_returnflag = 'R'").groupBy("p_partkey").agg(F.count("*").alias("returned"))
    return shaping.left_chain(table(spark, d, "part").select("p_partkey"), [all_, back], ["p_partkey"])


def event_props(spark, d):
    return shaping.from_dict(table(spark, d, "events").select("event_id", "props"), "props", ["k"]).select("event_id", "k")


def tag_outcomes(spark, d):
    key = F.col("c_custkey")
    code = F.concat(F.lit("a"), (key % 26).cast("string"), F.lit("_latn"))
    tag = F.when(key % 5 == 0, F.lit(None)).when(key % 5 == 1, code).when(key % 5 == 2, F.replace(code, F.lit("_latn"), F.lit("-Latn"))).when(key % 5 == 3, F.concat(F.lit("a"), (key % 26).cast("string"))).otherwise(F.lit("zz"))
    rows = table(spark, d, "customer").select("c_custkey", code.alias("code"), tag.alias("tag"))
    return review.tag_audit(rows, "code", "tag").groupBy("outcome").agg(F.count("*").alias("n"))


def registry_built(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("code"), F.lit("").alias("name"), F.lit("s").alias("kind")).distinct()
    b = table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("code"), F.lit("c").alias("kind"), F.lit("other").alias("name")).distinct()
    return registry.built({"supplier": a, "nation": b, "customer": c}, "code", ["name", "kind"])


def family_queue(spark, d):
    return families.queue(_registry(spark, d), {"FRANCE": "ROMANCE"}, many=8)


def mean_of_means(spark, d):
    """The mean over nations of their customers' mean balance, by region."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    each = rows.groupBy("n_regionkey", "n_nationkey").agg(F.avg("c_acctbal").alias("m"), F.count("*").alias("n"))
    return each.groupBy("n_regionkey").agg(F.round(F.avg("m"), 4).alias("mean"), F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (review_signals, review_tiers, exclusion_tiers, search_terms_built, search_terms_selected, search_term_stages, convergence_detail, convergence_shares, convergence_by_sources, source_presence, anchor_alignment, service_profiles, script_outliers, script_sides, all_signals, signal_counts, signals_wide, pattern_rates, borrow_bands, refused_elsewhere, unpaired_recovery, variant_matrix, part_measures, order_totals, nation_totals, part_use, event_props, tag_outcomes, registry_built, family_queue, mean_of_means)}


def _sql(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


SENTENCES = f"{TEXTS}, t AS (SELECT *, doc_id // 12 AS item FROM texts)"
FOUND = rf"""d AS (SELECT doc_id, doc_id // 12 AS item, source AS service, text, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, coalesce(list_max(map_values(list_histogram(w))), 0) AS top FROM d),
g AS (SELECT item, service, [CASE WHEN len(w) >= 4 AND top >= 4 AND top >= 0.3 * len(w) THEN 'has_repetition_loop' END, CASE WHEN regexp_matches(text, {_sql(V.PLACEHOLDER_TERMS)}) THEN 'has_placeholder_term' END, CASE WHEN regexp_matches(text, '\\u[0-9a-fA-F]{{4}}') THEN 'has_unicode_escape' END,
 CASE WHEN length(trim(text, {SP})) > 4000 THEN 'has_extreme_term_length' END, CASE WHEN length(trim(text, {SP})) BETWEEN 1 AND 3 THEN 'has_short_translation' END, CASE WHEN regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') THEN 'has_unsafe_characters' END,
 CASE WHEN regexp_matches(text, {_sql(V.REFUSAL)}) THEN 'has_refusal_rationale' END, CASE WHEN regexp_matches(text, {_sql(V.TRANSLITERATION)}) THEN 'has_transliteration_rationale' END, CASE WHEN regexp_matches(text, {_sql(V.PLACEHOLDER_RATIONALE)}) THEN 'has_placeholder_rationale' END] AS f FROM m),
found AS (SELECT item, signal, coalesce(string_agg(DISTINCT service, ', ' ORDER BY service), '') AS services, count(DISTINCT service) AS n_services FROM (SELECT item, service, unnest(f) AS signal FROM g) WHERE signal IS NOT NULL GROUP BY 1, 2)"""
IN_EXCLUDING, IN_COMPLICATING = (", ".join(f"'{x}'" for x in names) for names in (V.EXCLUDING_FLAGS, V.COMPLICATING_FLAGS))
NORM = "trim(regexp_replace(replace(lower(term), 'ß', 'ss'), '\\s+', ' ', 'g'), '" + V.EDGE_MARKS.replace("'", "''") + "')"
ALIGNED = NORM.replace("{}'", "{}/`'")
PRESENT = f"term IS NOT NULL AND lower(trim(term, {SP})) NOT IN ('', 'nan', 'none', 'null')"
DETAIL = f"""n AS (SELECT item, pos, service, CASE WHEN {PRESENT} THEN {NORM} ELSE '' END AS norm FROM t),
detail AS (SELECT item, pos, coalesce(string_agg(DISTINCT service, '; ' ORDER BY service) FILTER (norm <> ''), '') AS sources, count(*) FILTER (norm <> '') AS n_present, count(DISTINCT norm) FILTER (norm <> '') AS n_distinct FROM n GROUP BY 1, 2),
labels AS (SELECT *, CASE WHEN n_present = 0 THEN 'no outputs' WHEN n_present = 1 THEN 'one output only' WHEN n_distinct = 1 THEN 'all available outputs agree' ELSE 'outputs diverge' END AS label FROM detail)"""
STAGED = f"""t AS (SELECT *, trim(lower(term), {SP}) AS low, CASE WHEN doc_id % 11 = 0 THEN 'rtl' ELSE 'ltr' END AS direction, doc_id % 5 = 0 AS valid FROM texts), x AS (SELECT DISTINCT lower(term) AS low FROM texts WHERE doc_id % 97 = 0),
e AS (SELECT *, CASE WHEN NOT ({PRESENT}) THEN 'blank' WHEN regexp_matches(term, {_sql(V.PLACEHOLDER_TERMS)}) THEN 'placeholder' WHEN language <> 'en' AND (contains(lower(term), 'the thing') OR regexp_matches(term, '\\bTT\\b')) THEN 'leak'
 WHEN regexp_matches(term, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') THEN 'unsafe' WHEN low IN (SELECT low FROM x) THEN 'excluded' END AS early FROM t),
b AS (SELECT low, count(*) >= 2 OR bool_or(valid) AS backed FROM e WHERE early IS NULL GROUP BY 1), s AS (SELECT e.*, coalesce(early, CASE WHEN NOT backed THEN 'uncorroborated' END, 'kept') AS stage FROM e LEFT JOIN b USING (low))"""
FOLDED = r"trim(regexp_replace(regexp_replace(strip_accents(lower(term)), '[^\p{L}\p{N}\p{M}_\s]', '', 'g'), '\s+', ' ', 'g'))"
#: Sentences as cells, chosen by category, repaired as texts of one script are, and through the stages.
SELECTED = f"""{TEXTS}, cells AS (SELECT *, doc_id // 12 AS item, CASE WHEN doc_id % 11 = 0 THEN 'rtl' ELSE 'ltr' END AS direction, doc_id % 5 = 0 AS valid FROM texts), x AS (SELECT DISTINCT lower(term) AS low FROM texts WHERE doc_id % 97 = 0),
p AS ({PLURALITY.format(key='item, pos, language', voter='doc_id')}), n AS (SELECT item, pos, language, term, count(*) AS n, max(direction) AS direction, bool_or(valid) AS valid FROM cells GROUP BY 1, 2, 3, 4),
j AS (SELECT n.*, best_candidate, unique_candidates AS u, max(n) OVER (PARTITION BY n.item, n.pos, n.language) > 2 AS above FROM n JOIN p USING (item, pos, language)),
r AS (SELECT language, direction, valid, term AS raw, CASE WHEN regexp_matches(term, {_sql(V.PLACEHOLDER_TERMS)}) THEN NULL WHEN regexp_matches(term, '^[^=]*\\p{{Latin}}[^=]*=.*[^=\\s]') AND regexp_matches(term, '^[^=]{{1,100}}\\s*=') THEN trim(regexp_extract(term, '^[^=]+=+\\s*(.+?)\\s*$', 1)) WHEN regexp_matches(term, '^/+.*[^/\\s].*/+$') THEN trim(regexp_extract(term, '^/+(.+?)/+$', 1)) ELSE term END AS term
 FROM j WHERE CASE u WHEN 1 THEN term = best_candidate WHEN 2 THEN CASE WHEN above THEN n > 2 ELSE term = best_candidate END ELSE true END),
t AS (SELECT *, lower(trim(term, {SP})) AS low FROM r),
e AS (SELECT *, CASE WHEN term IS NULL THEN 'uncurated' WHEN NOT ({PRESENT}) THEN 'blank' WHEN language <> 'en' AND (contains(lower(term), 'the thing') OR regexp_matches(term, '\\bTT\\b')) THEN 'leak'
 WHEN regexp_matches(term, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') THEN 'unsafe' WHEN low IN (SELECT low FROM x) THEN 'excluded' END AS early FROM t),
b AS (SELECT low, count(*) >= 2 OR bool_or(valid) AS backed FROM e WHERE early IS NULL GROUP BY 1), s AS (SELECT e.*, coalesce(early, CASE WHEN NOT backed THEN 'uncorroborated' END, 'kept') AS stage FROM e LEFT JOIN b USING (low))"""
_WHY = "rationale IS NOT NULL AND lower(trim(rationale, WHITE)) NOT IN ('', 'nan', 'none', 'null') AND lower(rtrim(trim(rationale, WHITE), '.')) NOT IN (EMPTY)".replace("WHITE", SP).replace("EMPTY", ", ".join("'" + x + "'" for x in V.EMPTY_RATIONALES))
_CONDITIONS = {
    "has_repetition_loop": "len(w) >= 4 AND top >= 4 AND top >= 0.3 * len(w)", "has_mixed_script": "mixed", "has_any_mixing": "wide", "has_placeholder_term": f"regexp_matches(term, {_sql(V.PLACEHOLDER_TERMS)})",
    "has_unicode_escape": r"regexp_matches(term, '\\u[0-9a-fA-F]{4}')", "has_extreme_term_length": f"length(trim(term, {SP})) > 100", "has_short_translation": f"length(trim(term, {SP})) BETWEEN 1 AND 3",
    "has_source_term": r"contains(lower(term), 'of the') OR regexp_matches(term, '\bOT\b')", "has_unsafe_characters": r"regexp_matches(term, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')", "has_romanization": r"regexp_matches(term, '^[\x00-\x7F]+$') AND regexp_matches(rationale, '(?i)romani[sz]')",
    "has_language_name": r"contains(' ' || trim(regexp_replace(lower(term), '[^\p{L}\p{N}\p{M}_]+', ' ', 'g')) || ' ', ' the ')", "has_missing_rationale": f"({PRESENT}) <> ({_WHY})",
    "has_refusal_rationale": f"regexp_matches(rationale, {_sql(V.REFUSAL)})", "has_transliteration_rationale": f"regexp_matches(rationale, {_sql(V.TRANSLITERATION)})", "has_placeholder_rationale": f"regexp_matches(rationale, {_sql(V.PLACEHOLDER_RATIONALE)})",
    "has_foreign_rationale": r"len(regexp_extract_all(rationale, '\p{L}')) >= 20 AND 2 * len(regexp_extract_all(rationale, '\p{Latin}')) < len(regexp_extract_all(rationale, '\p{L}'))",
}
_OTHER_WHY = f"(SELECT * EXCLUDE (rationale), CASE WHEN doc_id % 5 = 4 THEN {views._scripted_sql('rationale')} ELSE rationale END AS rationale FROM t)"
ALL = f"""{views.scripts_sql(_OTHER_WHY, 'term')}, v AS (SELECT * EXCLUDE (term, t, w), t AS term, regexp_extract_all(lower(t), '[^\\x20\\x09-\\x0D]+') AS w FROM (SELECT *, NULL AS w FROM e)),
u AS (SELECT *, coalesce(list_max(map_values(list_histogram(w))), 0) AS top FROM v), g AS (SELECT item, pos, doc_id, unnest([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _CONDITIONS.items())}]) AS signal FROM u),
fs AS (SELECT item, pos, signal, string_agg(DISTINCT CAST(doc_id AS VARCHAR), ', ' ORDER BY CAST(doc_id AS VARCHAR)) AS services, count(DISTINCT doc_id) AS n_services FROM g WHERE signal IS NOT NULL GROUP BY 1, 2, 3)"""

ORACLE_SQL = {
    "review_signals": f"WITH {FOUND} SELECT * FROM found",
    "review_tiers": f"""WITH {FOUND}, s AS (SELECT item, list_sort(list(DISTINCT signal)) AS f FROM found GROUP BY 1), i AS (SELECT DISTINCT item FROM d), j AS (SELECT item, coalesce(f, []) AS f FROM i LEFT JOIN s USING (item))
 SELECT item, array_to_string(f, ', ') AS flags, CAST(len(f) AS INTEGER) AS flag_count, CASE WHEN len(f) >= 2 THEN 'REVIEW_HIGH' WHEN len(f) = 1 THEN 'REVIEW_MED' ELSE 'CLEAN' END AS tier, CASE WHEN len(f) >= 2 THEN 0 WHEN len(f) = 1 THEN 1 ELSE 2 END AS rank,
 CASE WHEN list_has_any(f, [{IN_EXCLUDING}]) THEN 'xall' WHEN list_has_any(f, [{IN_COMPLICATING}]) THEN 'xsrch' ELSE '' END AS hint FROM j""",
    "exclusion_tiers": f"""WITH {FOUND}, a AS (SELECT item, doc_id % 100 = 0 AS e, doc_id % 100 <> 0 AS c FROM d WHERE doc_id % 50 = 0 UNION ALL SELECT item, signal IN ({IN_EXCLUDING}), signal IN ({IN_COMPLICATING}) FROM found)
 SELECT item, bool_or(e) AS likely_error, bool_or(c) AS likely_search_complication FROM a GROUP BY 1 HAVING bool_or(e) OR bool_or(c)""",
    "search_terms_built": f"""WITH {TEXTS}, {STAGED}, k AS (SELECT DISTINCT low AS search_term, language, direction FROM s WHERE stage = 'kept')
 SELECT search_term, array_to_string(list_sort(list(DISTINCT language)), ', ') AS natural_language, count(DISTINCT language) AS counts, CASE WHEN count(*) FILTER (direction = 'ltr') >= count(*) FILTER (direction = 'rtl') THEN 'ltr' ELSE 'rtl' END AS directionality, count(DISTINCT direction) > 1 AS directionality_conflict,
 coalesce(string_agg(DISTINCT language, ', ' ORDER BY language) FILTER (direction = 'ltr'), '') AS ltr_languages, coalesce(string_agg(DISTINCT language, ', ' ORDER BY language) FILTER (direction = 'rtl'), '') AS rtl_languages FROM k GROUP BY 1""",
    "search_terms_selected": f"""WITH {SELECTED}, k AS (SELECT DISTINCT lower(trim(term, {SP})) AS search_term, language, direction FROM s WHERE stage = 'kept')
 SELECT search_term, array_to_string(list_sort(list(DISTINCT language)), ', ') AS natural_language, count(DISTINCT language) AS counts, CASE WHEN count(*) FILTER (direction = 'ltr') >= count(*) FILTER (direction = 'rtl') THEN 'ltr' ELSE 'rtl' END AS directionality, count(DISTINCT direction) > 1 AS directionality_conflict,
 coalesce(string_agg(DISTINCT language, ', ' ORDER BY language) FILTER (direction = 'ltr'), '') AS ltr_languages, coalesce(string_agg(DISTINCT language, ', ' ORDER BY language) FILTER (direction = 'rtl'), '') AS rtl_languages FROM k GROUP BY 1""",
    "search_term_stages": f"WITH {TEXTS}, {STAGED} SELECT stage, count(*) AS n FROM s GROUP BY 1",
    "convergence_detail": f"WITH {SENTENCES}, {DETAIL} SELECT * FROM labels",
    "convergence_shares": f"WITH {SENTENCES}, {DETAIL} SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY 1",
    "convergence_by_sources": f"WITH {SENTENCES}, {DETAIL} SELECT n_present, count(*) AS items, count(*) FILTER (n_present > 1 AND n_distinct = 1) AS agree, round(count(*) FILTER (n_present > 1 AND n_distinct = 1) / count(*), 6) AS rate FROM labels GROUP BY 1",
    "source_presence": f"WITH {SENTENCES}, p AS (SELECT service, count(DISTINCT (item, pos)) FILTER ({PRESENT}) AS present FROM t GROUP BY 1), i AS (SELECT count(DISTINCT (item, pos)) AS items FROM t) SELECT service, present, items, round(present / items, 6) AS rate FROM p, i",
    "anchor_alignment": f"WITH {SENTENCES}, n AS (SELECT DISTINCT item, pos, service, {ALIGNED} AS norm FROM t WHERE {PRESENT}), a AS (SELECT * FROM n WHERE service = 'src1' AND norm <> ''), b AS (SELECT n.*, EXISTS (SELECT 1 FROM a WHERE a.item = n.item AND a.pos = n.pos AND a.norm = n.norm) AS hit FROM n WHERE service <> 'src1' AND norm <> '' AND EXISTS (SELECT 1 FROM a WHERE a.item = n.item AND a.pos = n.pos)) SELECT service, count(*) AS compared, count(*) FILTER (hit) AS aligned, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM b GROUP BY 1",
    "service_profiles": rf"WITH {SENTENCES}, w AS (SELECT service, {PRESENT} AS has, regexp_extract_all(term, '[^\x20\x09-\x0D]+') AS ws, trim(lower(term)) AS a, trim(lower(rationale)) AS b FROM t) SELECT service, count(*) AS n, count(*) FILTER (has) AS covered, round(avg(len(ws)) FILTER (has), 6) AS mean_words, round(count(*) FILTER (has AND a = b) / nullif(count(*) FILTER (has), 0), 6) AS echo_rate, round(count(*) FILTER (has AND list_has_any(regexp_extract_all(a, '[^\x20\x09-\x0D]+'), regexp_extract_all(coalesce(b, ''), '[^\x20\x09-\x0D]+'))) / nullif(count(*) FILTER (has), 0), 6) AS overlap_rate FROM w GROUP BY 1",
    "script_outliers": f"WITH {SENTENCES}, {views.scripts_sql(f'(SELECT * FROM t WHERE {PRESENT})', 'term')}, k AS (SELECT item, pos, script, count(*) AS n FROM e WHERE script <> 'Unknown' GROUP BY 1, 2, 3), b AS (SELECT item, pos, first(script ORDER BY n DESC, script) AS majority FROM k GROUP BY 1, 2) SELECT item, pos, doc_id, script, majority, script <> majority AS outlier FROM e JOIN b USING (item, pos) WHERE script <> 'Unknown'",
    "script_sides": f"WITH {SENTENCES}, {views.scripts_sql(f'(SELECT * FROM t WHERE {PRESENT})', 'term')}, k AS (SELECT item, pos, doc_id % 3 = 0 AS near, script, count(*) AS n FROM e WHERE script <> 'Unknown' GROUP BY 1, 2, 3, 4), b AS (SELECT item, pos, first(script ORDER BY n DESC, script) FILTER (near) AS local, first(script ORDER BY n DESC, script) FILTER (NOT near) AS api FROM k GROUP BY 1, 2) SELECT item, pos, local, api, coalesce(local <> api, false) AS differ FROM b",
    "all_signals": f"WITH {SENTENCES}, {ALL} SELECT * FROM fs",
    "signal_counts": f"""WITH {SENTENCES}, {ALL}, i AS (SELECT DISTINCT item, pos FROM t), p AS (SELECT i.item, i.pos, list(signal) FILTER (signal IS NOT NULL) AS f FROM i LEFT JOIN fs ON i.item = fs.item AND i.pos = fs.pos GROUP BY 1, 2),
 r AS (SELECT 'flags' AS kind, CAST(len(coalesce(f, [])) AS VARCHAR) AS name FROM p UNION ALL SELECT 'signal', unnest(f) FROM p UNION ALL {' UNION ALL '.join(f"SELECT 'group', '{g}' FROM p WHERE list_has_any(f, {list(names)})" for g, names in GROUPS.items())}) SELECT kind, name, count(*) AS n, round(count(*) / (SELECT count(*) FROM i), 6) AS share FROM r GROUP BY 1, 2""",
    "signals_wide": f"WITH {SENTENCES}, {ALL}, i AS (SELECT DISTINCT item, pos FROM t) SELECT i.item, i.pos, " + ", ".join(f"coalesce(bool_or(signal = '{n}'), false) AS {n}, coalesce(max(services) FILTER (signal = '{n}'), '') AS {n.removeprefix('has_')}_services" for n in ALL_SIGNALS) + ", coalesce(string_agg(signal, '; ' ORDER BY signal), '') AS automated_review_signals, CAST(count(signal) AS INTEGER) AS flag_count FROM i LEFT JOIN fs ON i.item = fs.item AND i.pos = fs.pos GROUP BY 1, 2",
    "pattern_rates": "SELECT role, count(*) AS n, " + ", ".join(f"round(count(*) FILTER ({' OR '.join(f'regexp_matches(text, {_sql(p)})' for p in ps)}) / count(*), 6) AS {f}" for f, ps in PATTERNS.items()) + " FROM conversations GROUP BY 1",
    "borrow_bands": f"WITH {SENTENCES}, w AS (SELECT item, pos, doc_id, list_filter(string_split({FOLDED}, ' '), lambda x: x IN ('the', 'of', 'and')) AS f FROM t), x AS (SELECT item, pos, doc_id, unnest(f) AS tok FROM w), g AS (SELECT item, pos, count(DISTINCT doc_id) AS services, string_agg(DISTINCT tok, ', ' ORDER BY tok) AS tokens FROM x GROUP BY 1, 2) SELECT *, CASE WHEN services <= 1 THEN '1' WHEN services <= 3 THEN '2-3' ELSE '4+' END AS band FROM g",
    "refused_elsewhere": f"WITH {SENTENCES}, r AS (SELECT DISTINCT item, pos, doc_id FROM t WHERE starts_with(lower(term), 'the')) SELECT DISTINCT item, pos, doc_id FROM t WHERE {PRESENT} AND EXISTS (SELECT 1 FROM r WHERE r.item = t.item AND r.pos = t.pos AND r.doc_id <> t.doc_id)",
    "unpaired_recovery": f"WITH {views.PAIRS} SELECT conv_id, turn, CASE WHEN rationale IS NOT NULL OR ({PRESENT}) THEN length(term) END AS chars, rationale IS NULL AND ({PRESENT}) AS unpaired FROM pairs",
    "variant_matrix": f"WITH {CELLS} SELECT item, " + ", ".join(f"min(term) FILTER (service = {i} AND variant = '{v}') AS term_{i}_{v.lower()}" for i in range(1, 8) for v in "FO") + " FROM cells GROUP BY 1",
    "part_measures": "SELECT p_partkey, 'p_size' AS measure, CAST(p_size AS DOUBLE) AS x FROM part UNION ALL SELECT p_partkey, 'p_retailprice', CAST(p_retailprice AS DOUBLE) FROM part",
    "order_totals": "SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'Total' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN grouping(o_orderstatus) = 1 THEN 'Total' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)",
    "nation_totals": "SELECT coalesce(a.k, b.k) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.k = b.k",
    "part_use": "SELECT p_partkey, count(l_partkey) AS n, count(*) FILTER (l_returnflag = 'R') AS returned FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1",
    "event_props": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "tag_outcomes": "SELECT CASE c_custkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'same' WHEN 2 THEN 'same but for its form' WHEN 3 THEN 'same language' ELSE 'other' END AS outcome, count(*) AS n FROM customer GROUP BY 1",
    "registry_built": "WITH u AS (SELECT DISTINCT s_nationkey AS code, 0 AS k, 'supplier' AS s FROM supplier UNION ALL SELECT n_nationkey, 1, 'nation' FROM nation UNION ALL SELECT DISTINCT c_nationkey, 2, 'customer' FROM customer), g AS (SELECT code, string_agg(s, ' + ' ORDER BY k) AS sources, arg_min(s, k) AS added_by, bool_or(k = 0) AS s0, bool_or(k = 1) AS s1, bool_or(k = 2) AS s2 FROM u GROUP BY 1) SELECT code, CASE WHEN s1 THEN n_name WHEN s2 THEN 'other' END AS name, CASE WHEN s0 THEN 's' WHEN s2 THEN 'c' END AS kind, sources, added_by FROM g LEFT JOIN nation ON code = n_nationkey",
    "family_queue": "WITH r AS (SELECT n_name AS family_name, c_mktsegment AS family_glottolog, CASE WHEN n_nationkey = 0 THEN NULL ELSE r_name END AS named FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), q AS (SELECT 'pair' AS kind, family_name, family_glottolog, count(*) AS n_languages, min(named) AS named FROM r GROUP BY 2, 3), t AS (SELECT *, CASE WHEN family_name = 'FRANCE' THEN 'policy' WHEN n_languages >= 8 THEN 'high' WHEN n_languages >= 3 THEN 'medium' ELSE 'low' END AS tier FROM q) SELECT kind, family_name, family_glottolog, n_languages, CASE WHEN family_name = 'FRANCE' THEN 'ROMANCE' ELSE coalesce(named, family_name) END AS suggestion, tier, CASE tier WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS rank FROM t",
    "mean_of_means": "SELECT n_regionkey, round(avg(m), 4) AS mean, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n_regionkey, n_nationkey, avg(c_acctbal) AS m, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1",
}
