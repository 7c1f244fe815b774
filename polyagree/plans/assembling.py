"""Queries on assembling cells, decisions by hand, whole runs, comparisons of runs and services, orders, codes and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyagree.functions import fixed as V
from polyagree.functions import text as X
from polyagree.operators import agreement, assembly, comparison, ordering, registry, review, shaping
from polyagree.sources.files import table

from . import agreeing, reviewing, views
from .curating import SIMILAR
from .reviewing import FOUND, PRESENT, SENTENCES
from .views import CELLS, PAIRS, SP

SOURCES, LANGUAGES, TYPES = [f"src{i}" for i in range(20)], ["en", "de", "es", "fr"], ["view", "click", "cart", "purchase"]


def variant_assembly(spark, d):
    """Lines stand for rows of files of services: the first service takes no prompt, flags A are no terms, small quantities have no rationale."""
    number = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("item"), number.alias("service"), F.when(number != 1, F.col("l_linestatus")).alias("variant"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("term"),
        F.when(F.col("l_quantity") > 10, F.concat("l_linestatus", F.lit(" because "), number.cast("string"))).alias("rationale"), "l_shipdate", "l_extendedprice",
    )
    return assembly.assembled(rows, ["item"], ["F", "O"], ["l_shipdate", "l_extendedprice"], F.col("service") != 1)


def cells_wanted(spark, d):
    rows = table(spark, d, "customer").select("c_custkey")
    done = rows.where("c_custkey % 3 = 0").withColumn("term_source", F.lit("alpha"))
    return assembly.wanted(rows, ["alpha", "beta", "gamma"], done, "c_custkey")


def manual_decisions(spark, d):
    kind = F.when(F.col("event_type") == "signup", assembly.ANALYSIS).when(F.col("event_type") == "error", assembly.SEARCH).when(F.col("event_type") == "purchase", assembly.CORRECTION).otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select("user_id", kind.alias("service"), F.col("props").alias("original_term"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("t"), (F.col("event_id") % 100).cast("string"))).alias("corrected_term"))
    whole, search, better = assembly.by_hand(rows, "user_id")
    none = F.lit(None).cast("string")
    parts = [whole.withColumns({"original_term": none, "corrected_term": none, "kind": F.lit("analysis")}), search.withColumns({"corrected_term": none, "kind": F.lit("search")}), better.withColumn("kind", F.lit("correction"))]
    return reduce(DataFrame.unionByName, parts)


def _drops(spark, d):
    decided = reviewing._documents(spark, d).where("doc_id % 50 = 0").select("item", F.upper("service").alias("service"), (F.col("doc_id") % 100 == 0).alias("excluded"))
    return assembly.drops(reviewing.review_signals(spark, d), V.EXCLUDING_FLAGS, decided, ["item"])


def service_drops(spark, d):
    return _drops(spark, d)


def cells_after_drops(spark, d):
    return assembly.without(reviewing._documents(spark, d), _drops(spark, d), ["item"]).select("doc_id", "item", "service")


def fully_dropped(spark, d):
    rows = views.cells(spark, d).where("term = 'R'").select("item", F.col("service").cast("string").alias("service"))
    return assembly.dropped_by_all(rows, ["item"], ["1", "2"])


def disagreement_run(spark, d):
    """Turns of users stand for services, answers for rationales, conversations for items."""
    talk = table(spark, d, "conversations").where("role = 'user'")
    out = talk.where("conv_id % 7 = 0").select(F.col("conv_id").alias("item"), F.lit(assembly.ANALYSIS).alias("service"), F.lit(None).cast("string").alias("original_term"), F.lit(None).cast("string").alias("corrected_term"))
    better = talk.where("conv_id % 11 = 3").select(F.col("conv_id").alias("item"), F.lit(assembly.CORRECTION).alias("service"), F.col("text").alias("original_term"), F.concat("text", F.lit(" indeed")).alias("corrected_term"))
    rows = views.pairs(spark, d).select(F.col("conv_id").alias("item"), F.concat(F.lit("src"), F.expr("turn div 2").cast("string")).alias("service"), "term", "rationale")
    gone = talk.where("conv_id % 5 = 1").select(F.col("conv_id").alias("item"), F.lit("src2").alias("service")).distinct()
    found = assembly.run(rows, "item", out.unionByName(better), gone, F.lit(True), reviewing.TOKENS, "src1")
    return found.select("item", "n", "n_raw", "n_norm", "max_distance", "threshold", "borrowed", "anchored", "script_disagreement", "absence", "category", "rule", "evidence", "n_rationales", "similarity")


def anchored_stability(spark, d):
    rows = agreeing.stability_across_variants(spark, d)
    means = rows.where("service <> 1").groupBy("item").agg(F.avg("confidence").alias("mean_confidence"))
    return comparison.anchored_spread(means, rows.where("service = 1"), ["item"], "mean_confidence")


def source_retention(spark, d):
    return comparison.retention(reviewing._sentences(spark, d), ["service"], "term", "of the")


def pairing_impact(spark, d):
    term, why = X.present(F.col("term")), ~X.is_empty_rationale(F.col("rationale"))
    return comparison.impact(views.pairs(spark, d), "turn", ["conv_id"], term, term & why)


def variant_synthesis(spark, d):
    return comparison.synthesis(views.cells(spark, d), ["item"], "variant")


def correlations_by_brand(spark, d):
    return comparison.correlations(table(spark, d, "part"), "p_size", "p_retailprice", ["p_brand"])


def agreement_deltas(spark, d):
    rows = views.cells(spark, d)
    of = lambda v: agreement.pairwise(rows.where(F.col("variant") == v), ["item"])
    return comparison.deltas(of("F"), of("O"))


def service_influence(spark, d):
    return comparison.influence(agreeing.pairwise_service_agreement(spark, d))


def agreement_by_priority(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("priority"))
    return comparison.agreement_by(views.cells(spark, d).join(orders, "item"), ["priority", "item", "variant"], ["priority"])


def priorities_by_rate(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return ordering.by_group_rate(counts, "priority", "status", "F")


def events_in_order(spark, d):
    return ordering.reindexed(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", TYPES)


def seeded_sample(spark, d):
    return ordering.sampled(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", 25, 17)


def dealt_folds(spark, d):
    return ordering.folds(table(spark, d, "labels"), "doc_id", "quality", 5).groupBy("quality", "fold").agg(F.count("*").alias("n"))


def valid_codes(spark, d):
    of = lambda name, column: table(spark, d, name).select(F.lit(column).alias("source"), F.col(column).alias("code"))
    rows = reduce(DataFrame.unionByName, [of("customer", "c_mktsegment"), of("nation", "n_name"), of("part", "p_type"), of("part", "p_name"), of("supplier", "s_name"), of("documents", "lang")])
    return rows.groupBy("source", registry.valid_key(F.col("code"), ["PROMO", "fr"]).alias("outcome")).agg(F.count("*").alias("n"))


def alternative_keys(spark, d):
    key = F.col("c_custkey")
    code = F.concat(F.lower("c_mktsegment"), F.when(key % 3 == 1, "-alt-secondary").when(key % 3 == 2, "-alt-variant").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", registry.split_alternative(code).alias("x")).select("c_custkey", "x.*")


def preferred_tags(spark, d):
    key = F.col("c_custkey")
    code = F.concat(F.lit("c"), (key % 13).cast("string"))
    short, long = F.when(key % 4 == 0, "EN").when(key % 4 == 1, "nan"), F.when(key % 6 < 3, "DEU_latn")
    return table(spark, d, "customer").select("c_custkey", registry.preferred_tag(code, short, long, {"c5": "zh-min-nan"}).alias("x")).select("c_custkey", "x.*")


def code_cells(spark, d):
    cell = F.concat(F.lower(F.substring("n_name", 1, 3)), F.lit(" ("), F.when(F.col("n_nationkey") % 3 == 0, "B").when(F.col("n_nationkey") % 3 == 1, "T").otherwise("X"), F.lit(")"))
    return table(spark, d, "nation").select("n_nationkey", registry.code_cell(cell).alias("x")).select("n_nationkey", "x.*")


def parent_names(spark, d):
    """Suppliers and nations with the name of what they belong to, if that is a nation."""
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.lit("nation").alias("level"))
    supplier = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("code"), F.col("s_name").alias("name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"), F.lit("supplier").alias("level"))
    region = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("code"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit("region").alias("level"))
    return registry.named(nation.unionByName(supplier).unionByName(region), "parent", "code", "name", F.col("level") == "nation")


def order_summaries(spark, d):
    return registry.summarised(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], ["l_returnflag"], ["l_linestatus"])


def search_term_flags(spark, d):
    rows = reviewing.search_terms_built(spark, d)
    return rows.groupBy(X.is_suspicious(F.col("search_term"), F.col("counts")).alias("suspicious"), X.is_short_search(F.col("search_term")).alias("short")).agg(F.count("*").alias("n"))


def order_days(spark, d):
    """Orders by day of a time written as text, which is none for a fifth of them."""
    written = F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "orders").groupBy(F.date_format(X.lenient_time(written), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def review_export(spark, d):
    """Sentences of all sources and languages at each place of twelve documents, wide, with the review of the twelve."""
    wide = shaping.wide(reviewing._sentences(spark, d), ["item", "pos"], {"service": SOURCES, "language": LANGUAGES}, ["term"])
    found = review.summary(reviewing._documents(spark, d), reviewing.review_signals(spark, d), ["item"])
    return wide.join(found.select("item", "flags", "tier", "hint"), "item", "left")


QUERIES = {
    f.__name__: f
    for f in (
        variant_assembly, cells_wanted, manual_decisions, service_drops, cells_after_drops, fully_dropped, disagreement_run, anchored_stability, source_retention, pairing_impact, variant_synthesis,
        correlations_by_brand, agreement_deltas, service_influence, agreement_by_priority, priorities_by_rate, events_in_order, seeded_sample, dealt_folds, valid_codes, alternative_keys, preferred_tags,
        code_cells, parent_names, order_summaries, search_term_flags, order_days, review_export,
    )
}

_IN = lambda names: ", ".join(f"'{x}'" for x in names)
_EMPTY = f"(rationale IS NULL OR lower(trim(rationale, {SP})) IN ('', 'nan', 'null', {_IN(V.EMPTY_RATIONALES)}))"
_PAIR = "SELECT x.service AS a, y.service AS b, {more} round(count(*) FILTER (x.term = y.term) / count(*), 6) AS rate FROM {t} x JOIN {t} y ON x.item = y.item AND x.variant = y.variant AND x.service < y.service"
_DROPS = f"""drops AS (SELECT DISTINCT item, lower(service) AS service FROM (SELECT item, service, unnest(f) AS signal FROM g) WHERE signal IN ({_IN(V.EXCLUDING_FLAGS)}) AND service IS NOT NULL
 UNION SELECT item, lower(service) FROM d WHERE doc_id % 100 = 0 AND service IS NOT NULL)"""
_RUN = f"""{PAIRS}, talk AS (SELECT conv_id, 'src' || (turn // 2) AS service, CASE WHEN conv_id % 11 = 3 THEN term || ' indeed' ELSE term END AS term, rationale FROM pairs WHERE conv_id % 7 <> 0 AND NOT (conv_id % 5 = 1 AND turn // 2 = 2)),
 texts AS (SELECT conv_id * 12 AS doc_id, 0 AS pos, 'en' AS language, service, CASE WHEN {PRESENT} AND NOT {_EMPTY} THEN term END AS term, CASE WHEN {PRESENT} AND NOT {_EMPTY} THEN rationale END AS rationale FROM talk)"""

ORACLE_SQL = {
    "variant_assembly": """WITH l AS (SELECT l_orderkey AS item, l_linenumber AS service, CASE WHEN l_linenumber <> 1 THEN l_linestatus END AS v, CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS term,
 CASE WHEN l_quantity > 10 THEN l_linestatus || ' because ' || l_linenumber END AS rationale, l_shipdate, l_extendedprice FROM lineitem), e AS (SELECT l.*, x.variant FROM l JOIN (VALUES ('F'), ('O')) x(variant) ON v IS NULL OR v = x.variant),
 r AS (SELECT *, row_number() OVER (PARTITION BY item, service, variant ORDER BY CASE WHEN term IS NULL THEN 1 ELSE 0 END, l_shipdate DESC, l_extendedprice DESC, term DESC, rationale DESC NULLS LAST) AS k FROM e)
 SELECT item, service, variant, CASE WHEN service = 1 OR rationale IS NOT NULL THEN term END AS term, CASE WHEN term IS NOT NULL THEN rationale END AS rationale FROM r WHERE k = 1""",
    "cells_wanted": "SELECT c_custkey, term_source FROM customer, (VALUES ('alpha'), ('beta'), ('gamma')) t(term_source) WHERE NOT (term_source = 'alpha' AND c_custkey % 3 = 0)",
    "manual_decisions": """WITH e AS (SELECT user_id, event_type AS t, props, CASE WHEN event_id % 3 > 0 THEN 't' || (event_id % 100) END AS better FROM events WHERE user_id IS NOT NULL)
 SELECT DISTINCT user_id, CAST(NULL AS VARCHAR) AS original_term, CAST(NULL AS VARCHAR) AS corrected_term, 'analysis' AS kind FROM e WHERE t = 'signup' UNION ALL SELECT DISTINCT user_id, props, NULL, 'search' FROM e WHERE t = 'error'
 UNION ALL SELECT user_id, props, max(better), 'correction' FROM e WHERE t = 'purchase' AND better IS NOT NULL AND props IS NOT NULL GROUP BY 1, 2""",
    "service_drops": f"WITH {FOUND}, {_DROPS} SELECT * FROM drops",
    "cells_after_drops": f"WITH {FOUND}, {_DROPS} SELECT doc_id, item, service FROM d WHERE NOT EXISTS (SELECT 1 FROM drops WHERE drops.item = d.item AND drops.service = lower(d.service))",
    "fully_dropped": f"WITH {CELLS} SELECT item, CAST(count(DISTINCT service) AS INTEGER) AS n_dropped, count(DISTINCT service) FILTER (service IN (1, 2)) = 2 AS whole FROM cells WHERE term = 'R' GROUP BY 1",
    "disagreement_run": f"""WITH {_RUN}, {agreeing.STEPS}, said AS (SELECT doc_id // 12 AS conv_id, service AS turn, 0 AS role, rationale AS text FROM texts), {SIMILAR.replace("ROWS", "said")}
 SELECT "group" AS item, kinds.n, n_raw, n_norm, max_distance, threshold, borrowed, anchored, script_disagreement, absence, category, rule, evidence, coalesce(alike.n, 0) AS n_rationales, similarity FROM kinds LEFT JOIN alike ON "group" = conv_id""",
    "anchored_stability": f"""WITH {CELLS}, s AS ({agreeing.PLURALITY.format(key="item, service", voter="CASE variant WHEN 'F' THEN 0 ELSE 1 END")}), m AS (SELECT item, avg(confidence) AS v FROM s WHERE service <> 1 GROUP BY 1), a AS (SELECT DISTINCT item, true AS anchored FROM s WHERE service = 1)
 SELECT coalesce(anchored, false) AS anchored, {agreeing.SPREAD.format(v="v")} FROM m LEFT JOIN a USING (item) GROUP BY 1""",
    "source_retention": rf"""WITH {SENTENCES}, s AS (SELECT service, trim(lower(term), {SP}) AS low FROM t WHERE {PRESENT}) SELECT service, count(*) AS n, round(count(*) FILTER (low = 'of the') / count(*), 6) AS exact,
 round(count(*) FILTER (low <> 'of the' AND (contains(low, 'of') OR contains(low, 'the'))) / count(*), 6) AS inside, round(count(*) FILTER (low <> 'of the' AND list_has_any(regexp_extract_all(low, '[^\x20\x09-\x0D]+'), ['of', 'the'])) / count(*), 6) AS by_word FROM s GROUP BY 1""",
    "pairing_impact": f"WITH {PAIRS}, e AS (SELECT turn, conv_id, bool_or({PRESENT}) AS b, bool_or({PRESENT} AND NOT {_EMPTY}) AS a FROM pairs GROUP BY 1, 2) SELECT turn, count(*) FILTER (b) AS covered, count(*) FILTER (a) AS still, count(*) FILTER (b AND NOT a) AS lost FROM e GROUP BY 1",
    "variant_synthesis": f"""WITH {CELLS}, v AS (SELECT variant, service, count(DISTINCT item) AS items, count(*) AS cells FROM cells GROUP BY 1, 2), w AS (SELECT variant, CAST(sum(cells) AS BIGINT) AS cells, round(avg(items), 6) AS mean_coverage, min(items) AS least_coverage, max(items) AS most_coverage FROM v GROUP BY 1),
 p AS ({agreeing.PLURALITY.format(key="item, variant", voter="service")}), q AS (SELECT variant, round(avg(confidence), 6) AS confidence, round(avg(unique_candidates), 6) AS candidates FROM p GROUP BY 1) SELECT * FROM w JOIN q USING (variant)""",
    "correlations_by_brand": """WITH r AS (SELECT p_brand, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS ry FROM part) SELECT p_brand, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""",
    "agreement_deltas": f"""WITH {CELLS}, f AS (SELECT * FROM cells WHERE variant = 'F'), o AS (SELECT * FROM cells WHERE variant = 'O'), pf AS ({_PAIR.format(more="", t="f")} GROUP BY 1, 2), po AS ({_PAIR.format(more="", t="o")} GROUP BY 1, 2)
 SELECT a, b, pf.rate, po.rate AS other, round(pf.rate - po.rate, 6) AS delta FROM pf JOIN po USING (a, b)""",
    "service_influence": f"""WITH {CELLS}, p AS ({_PAIR.format(more="", t="cells")} GROUP BY 1, 2), e AS (SELECT service, round(avg(rate), 6) AS agreement FROM (SELECT a AS service, rate FROM p UNION ALL SELECT b, rate FROM p) GROUP BY 1)
 SELECT service, agreement, CAST(rank() OVER (ORDER BY agreement DESC) AS INTEGER) AS rank FROM e""",
    "agreement_by_priority": f"""WITH {CELLS}, c AS (SELECT cells.*, o_orderpriority AS priority FROM cells JOIN orders ON o_orderkey = item), p AS ({_PAIR.format(more="x.priority,", t="c")} GROUP BY 1, 2, 3), i AS (SELECT priority, count(DISTINCT (item, variant)) AS items FROM c GROUP BY 1)
 SELECT priority, items, count(*) AS pairs, round(avg(rate), 6) AS agreement FROM i JOIN p USING (priority) GROUP BY 1, 2""",
    "priorities_by_rate": """WITH c AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') / count(*) AS rate FROM orders GROUP BY 1),
 k AS (SELECT priority, round(rate, 6) AS rate, CAST(row_number() OVER (ORDER BY rate DESC, priority) AS INTEGER) AS place FROM r) SELECT c.*, rate, place FROM c JOIN k USING (priority)""",
    "events_in_order": "SELECT CAST(place AS INTEGER) AS place, v.event_type, count(events.event_type) AS n FROM (VALUES (0, 'view'), (1, 'click'), (2, 'cart'), (3, 'purchase')) v(place, event_type) LEFT JOIN events ON events.event_type = v.event_type GROUP BY 1, 2",
    "seeded_sample": "SELECT c_custkey, c_nationkey FROM customer ORDER BY md5('17:' || c_custkey), c_custkey LIMIT 25",
    "dealt_folds": "WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT quality, CAST(fold AS INTEGER) AS fold, n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS n FROM c, range(5) f(fold) WHERE n > fold",
    "valid_codes": """WITH u AS (SELECT 'c_mktsegment' AS source, c_mktsegment AS code FROM customer UNION ALL SELECT 'n_name', n_name FROM nation UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_name', p_name FROM part UNION ALL SELECT 's_name', s_name FROM supplier UNION ALL SELECT 'lang', lang FROM documents)
 SELECT source, CASE WHEN code IS NULL OR lower(trim(code)) IN ('', 'nan', 'none', 'null') THEN 'blank' WHEN code IN ('PROMO', 'fr') THEN 'excluded' WHEN contains(code, ' ') THEN 'space' WHEN NOT regexp_full_match(code, '[A-Za-z][A-Za-z0-9_-]{1,14}') THEN 'form' ELSE 'valid' END AS outcome, count(*) AS n FROM u GROUP BY 1, 2""",
    "alternative_keys": 'SELECT c_custkey, lower(c_mktsegment) AS base, CASE c_custkey % 3 WHEN 1 THEN \'secondary\' WHEN 2 THEN \'variant\' END AS alternative, c_custkey % 3 <> 1 AS "primary" FROM customer',
    "preferred_tags": """SELECT c_custkey, CASE WHEN c_custkey % 13 = 5 THEN 'zh-min-nan' WHEN c_custkey % 4 = 0 THEN 'en' WHEN c_custkey % 6 < 3 THEN 'deu-Latn' ELSE 'c' || (c_custkey % 13) END AS tag,
 CASE WHEN c_custkey % 13 = 5 THEN 'fallback' WHEN c_custkey % 4 = 0 THEN 'short' WHEN c_custkey % 6 < 3 THEN 'long' ELSE 'code' END AS source FROM customer""",
    "code_cells": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'T' END AS part, CASE WHEN n_nationkey % 3 < 2 THEN lower(substr(n_name, 1, 3)) END AS code FROM nation",
    "parent_names": """SELECT 'n' || n_nationkey AS code, n_name AS name, 'r' || n_regionkey AS parent, 'nation' AS level, CAST(NULL AS VARCHAR) AS parent_name FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 'n' || s_nationkey, 'supplier', n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
 UNION ALL SELECT 'r' || r_regionkey, r_name, NULL, 'region', NULL FROM region""",
    "order_summaries": """SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, first(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS l_returnflag, string_agg(l_linestatus, '|' ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS all_l_linestatus FROM lineitem GROUP BY 1""",
    "search_term_flags": f"SELECT regexp_full_match(search_term, '[\\x00-\\x7F]+') AND counts = 1 AS suspicious, length(search_term) BETWEEN 1 AND 3 AS short, count(*) AS n FROM ({reviewing.ORACLE_SQL['search_terms_built']}) GROUP BY 1, 2",
    "order_days": "SELECT CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, count(*) AS n FROM orders GROUP BY 1",
    "review_export": f"WITH {SENTENCES}, r AS ({reviewing.ORACLE_SQL['review_tiers']}) SELECT item, pos, " + ", ".join(f"min(term) FILTER (service = '{s}' AND language = '{v}') AS term_{s}_{v}" for s in SOURCES for v in LANGUAGES)
    + ", min(flags) AS flags, min(tier) AS tier, min(hint) AS hint FROM t LEFT JOIN r USING (item) GROUP BY 1, 2",
}
