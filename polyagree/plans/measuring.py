"""Queries on exact quantiles, coverage by bitmaps, differences of spellings by pools, global orders, and masks by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyagree.functions import masking
from polyagree.functions import text as X
from polyagree.operators import bitmaps, differences, ordering, quantiles
from polyagree.sources.files import table

from . import views
from .agreeing import PLURALITY
from .views import CELLS, SP, TEXTS

SHARES = {"p01": 0.01, "p10": 0.1, "q1": 0.25, "q2": 0.5, "q3": 0.75, "p90": 0.9, "p99": 0.99}
TIERS = ["1-URGENT", "3-MEDIUM", "2-HIGH"]


def price_quantiles(spark, d):
    """All prices in one group, which is more than one buffer is given."""
    rows = quantiles.quantiles(table(spark, d, "lineitem"), [], "l_extendedprice", SHARES, most=1 << 14)
    return rows.select(*(F.round(c, 6).alias(c) for c in SHARES))


def quantity_quantiles(spark, d):
    """Groups of a few values with many rows each."""
    rows = quantiles.quantiles(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", SHARES, most=1 << 12)
    return rows.select("l_returnflag", "l_linestatus", *(F.round(c, 6).alias(c) for c in SHARES))


def _coverage(spark, d):
    """Orders are items and line numbers sources; a source has an item where its term is not N."""
    members = views.cells(spark, d).where("term <> 'N'")
    return bitmaps.Coverage(members, "item", "service", table(spark, d, "orders").select(F.col("o_orderkey").alias("item")))


def coverage_by_number(spark, d):
    return _coverage(spark, d).depth()


def coverage_pairs(spark, d):
    return _coverage(spark, d).pairs()


def coverage_verified(spark, d):
    return _coverage(spark, d).against(1)


def coverage_sole(spark, d):
    return _coverage(spark, d).sole()


def _spellings(spark, d):
    """First words of sentences as items; documents write them in lower or upper case, with a space before or after, and each eleventh from right to left."""
    word = F.replace(F.regexp_extract("term", "^[^ ]+", 0), F.lit("ß"), F.lit("ss"))  # whose capital differs between engines
    said = F.when(F.col("doc_id") % 4 == 0, word).when(F.col("doc_id") % 4 == 1, F.upper(word)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit(" "), word)).otherwise(F.concat(F.upper(word), F.lit(" ")))
    rows = views.texts(spark, d).select("language", F.lower(word).alias("item"), F.col("doc_id").alias("service"), said.alias("term"), (F.ascii(F.lower(word)) % 11 == 0).alias("rtl"))
    return rows.where(F.col("item") != "")


def agreement_by_pool(spark, d):
    """Agreement and differences of three pools of sources in one pass."""
    pools = {"llm": F.col("service") % 3 != 0, "baseline": F.col("service") % 3 == 0, "all": F.lit(True)}
    return differences.agreement_by_pool(_spellings(spark, d), ["language", "item"], pools, rtl=F.col("rtl"))


def difference_summaries(spark, d):
    return differences.summarised(_spellings(spark, d), ["language", "item"], rtl=F.col("rtl"))


def stability_differences(spark, d):
    """How the terms of an item and service differ over variants."""
    return differences.summarised(views.cells(spark, d), ["item", "service"])


def order_ranks(spark, d):
    """The place of every order by its price."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return ordering.ranked(rows, F.desc("o_totalprice"), F.asc("o_orderkey"))


def tier_ranks(spark, d):
    """The place of every order by a tier order of one's own, then by price from the least."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    rows = rows.withColumn("tier", ordering.custom(F.col("o_orderpriority"), TIERS))
    return ordering.ranked(rows, F.asc("tier"), F.asc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "tier", "rank")


def masked_rationales(spark, d):
    """Sentences under the four presets: how many change, and what is left of them. A language's name stands for its code; the first word is the term."""
    names = F.create_map(*(F.lit(x) for kv in {"en": "English", "de": "German language", "es": "Spanish", "fr": "French"}.items() for x in kv))
    alike = views.texts(spark, d).groupBy("language", F.col("term").alias("text")).agg(F.count("*").alias("rows"))  # each different sentence is masked once
    rows = alike.select("language", "rows", names[F.col("language")].alias("name"), "text", F.regexp_extract("text", "^[^ ]+", 0).alias("term"))
    rows = masking.masked_by(rows, F.col("text"), masking.PRESETS, F.col("name"), F.col("language"), F.col("term"))
    left = {k: F.col(f"masked_{k}") for k in masking.PRESETS}
    n, sums = F.sum("rows"), {k: (F.sum(F.when(x != F.col("text"), F.col("rows")).otherwise(0)), F.sum(F.char_length(x) * F.col("rows"))) for k, x in left.items()}
    kinds = [F.struct(F.lit(k).alias("preset"), n.alias("n"), changed.alias("changed"), chars.alias("chars")) for k, (changed, chars) in sums.items()]
    return rows.groupBy("language").agg(F.array(*kinds).alias("kinds")).select("language", F.explode("kinds").alias("x")).select("language", "x.*")


QUERIES = {f.__name__: f for f in (price_quantiles, quantity_quantiles, coverage_by_number, coverage_pairs, coverage_verified, coverage_sole, agreement_by_pool, difference_summaries, stability_differences, order_ranks, tier_ranks, masked_rationales)}

QUANTILES = ", ".join(f"round(quantile_cont({{v}}, {q}), 6) AS {name}" for name, q in SHARES.items())
COVERAGE = f"{CELLS}, h AS (SELECT DISTINCT item, service FROM cells WHERE term <> 'N'), m AS (SELECT o_orderkey AS item, count(service) AS k FROM orders LEFT JOIN h ON item = o_orderkey GROUP BY 1)"
SPELLINGS = rf"""{TEXTS}, w AS (SELECT *, replace(regexp_extract(term, '^[^ ]+'), 'ß', 'ss') AS w FROM texts), cells AS (SELECT language, lower(w) AS item, doc_id AS service, CASE doc_id % 4 WHEN 0 THEN w WHEN 1 THEN upper(w) WHEN 2 THEN ' ' || w ELSE upper(w) || chr(160) END AS term, unicode(lower(w)) % 11 = 0 AS rtl FROM w WHERE w <> '')"""
KIND = """CASE WHEN NOT rtl AND lower(x.term) = lower(y.term) THEN 'capitalization' WHEN lower(trim(x.term, WHITE)) = lower(trim(y.term, WHITE)) THEN CASE WHEN rtl OR trim(x.term, WHITE) = trim(y.term, WHITE) THEN 'whitespace' ELSE 'both' END ELSE 'content' END""".replace("WHITE", SP)
SUMMARY = """o AS (SELECT DISTINCT {key}, term FROM {t}), g AS (SELECT {key}, count(term) AS n_terms, count(DISTINCT term) AS n_spellings, coalesce(bool_or({rtl}), false) AS rtl FROM {t} GROUP BY {key}),
p AS (SELECT {gkey}, {kind} AS kind FROM g JOIN o x USING ({key}) JOIN o y USING ({key}) WHERE x.term < y.term), k AS (SELECT {key}, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM p GROUP BY {key}),
s AS (SELECT {gkey}, n_terms, CAST(n_spellings AS INTEGER) AS n_spellings, CASE WHEN n_terms <= 1 THEN 'no_differences' WHEN n_spellings = 1 THEN 'all_identical' ELSE kinds END AS differences FROM g LEFT JOIN k USING ({key}))"""


def _summary(key: str, t: str, rtl: str) -> str:
    return SUMMARY.format(key=key, gkey=key, t=t, rtl=rtl, kind=KIND)


ORACLE_SQL = {
    "price_quantiles": f"SELECT {QUANTILES.format(v='l_extendedprice')} FROM lineitem",
    "quantity_quantiles": f"SELECT l_returnflag, l_linestatus, {QUANTILES.format(v='l_quantity')} FROM lineitem GROUP BY 1, 2",
    "coverage_by_number": f"WITH {COVERAGE} SELECT CAST(k AS INTEGER) AS n_sources, count(*) AS items, round(count(*) / (SELECT count(*) FROM m), 6) AS share FROM m GROUP BY 1",
    "coverage_pairs": f"WITH {COVERAGE}, s AS (SELECT DISTINCT service FROM h), c AS (SELECT x.service AS a, y.service AS b FROM s x, s y), i AS (SELECT x.service AS a, y.service AS b, count(*) AS n FROM h x JOIN h y USING (item) GROUP BY 1, 2), t AS (SELECT service, count(*) AS n FROM h GROUP BY 1) SELECT c.a, c.b, coalesce(i.n, 0) AS \"both\", ta.n + tb.n - coalesce(i.n, 0) AS either, round(coalesce(i.n, 0) / ta.n, 6) AS share FROM c LEFT JOIN i ON c.a = i.a AND c.b = i.b JOIN t ta ON c.a = ta.service JOIN t tb ON c.b = tb.service",
    "coverage_verified": f"WITH {COVERAGE}, r AS (SELECT item FROM h WHERE service = 1) SELECT service AS source, count(*) AS covered, count(*) FILTER (item IN (SELECT item FROM r)) AS verified, count(*) FILTER (item NOT IN (SELECT item FROM r)) AS expanded, round(count(*) FILTER (item IN (SELECT item FROM r)) / count(*), 6) AS verification, round(count(*) FILTER (item NOT IN (SELECT item FROM r)) / count(*), 6) AS expansion FROM h WHERE service <> 1 GROUP BY 1",
    "coverage_sole": f"WITH {COVERAGE} SELECT service AS source, count(*) AS covered, count(*) FILTER (k = 1) AS sole, round(count(*) FILTER (k = 1) / count(*), 6) AS share FROM h JOIN m USING (item) GROUP BY 1",
    "agreement_by_pool": f"WITH {SPELLINGS.replace('cells AS', 'single AS')}, cells AS (SELECT *, CASE WHEN service % 3 = 0 THEN 'baseline' ELSE 'llm' END AS pool FROM single UNION ALL SELECT *, 'all' FROM single), {_summary('language, item, pool', 'cells', 'rtl')}, b AS ({PLURALITY.format(key='language, item, pool', voter='service')}) SELECT b.*, n_spellings, differences FROM b JOIN s USING (language, item, pool)",
    "difference_summaries": f"WITH {SPELLINGS}, {_summary('language, item', 'cells', 'rtl')} SELECT * FROM s",
    "stability_differences": f"WITH {CELLS}, {_summary('item, service', 'cells', 'false')} SELECT * FROM s",
    "order_ranks": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders",
    "tier_ranks": "WITH t AS (SELECT o_orderkey, o_totalprice, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 9 END AS tier FROM orders) SELECT o_orderkey, tier, row_number() OVER (ORDER BY tier, o_totalprice, o_orderkey) AS rank FROM t",
}
