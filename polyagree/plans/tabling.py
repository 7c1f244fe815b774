"""Queries on shapes and joins of tables, on lists and dicts written as text, and on what becomes of terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyagree.functions import fixed as V
from polyagree.functions import text as X
from polyagree.operators import search_terms, shaping
from polyagree.sources.files import table

from . import agreeing, views
from .agreeing import GROUPED
from .reviewing import PRESENT
from .views import ERRORS, SP, TEXTS

REGIONS, EDGES, BINS, SOURCE = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], [0, 4, 6, 20, 100], ["up to 4", "5 and 6", "7 to 20", "above"], "the thing"


def lines_natural(spark, d):
    """Lines of large quantity beside those of flag R, joined on all columns that both have."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return shaping.natural(lines.where("l_quantity > 25").drop("l_returnflag"), lines.where("l_returnflag = 'R'").drop("l_quantity").distinct())


def orders_keeping_left(spark, d):
    """Orders with facts of their lines, which have a status of their own that does not count."""
    facts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("o_orderstatus"), F.count("*").alias("lines"))
    return shaping.keeping_left(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), facts, ["o_orderkey"])


def _codes(spark, d):
    """Codes of two and three letters of nations, and of customers' nations one of both or a longer one."""
    number = F.format_string("%02d", F.col("n_nationkey"))
    nation = table(spark, d, "nation").select("n_nationkey", number.alias("c2"), F.concat(F.lit("n"), number).alias("c3"), F.col("n_name").alias("name"))
    k = F.col("c_custkey") % 4
    code = F.when(k == 0, F.col("c2")).when(k == 1, F.col("c3")).when(k == 2, F.concat("c3", F.lit("x")))
    rows = table(spark, d, "customer").join(nation.drop("name"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", code.alias("code"))
    return nation, rows


def codes_by_length(spark, d):
    nation, rows = _codes(spark, d)
    tables = {2: nation.select(F.col("c2").alias("code"), "name"), 3: nation.where("n_nationkey % 3 <> 0").select(F.col("c3").alias("code"), "name")}
    return shaping.by_length(rows, "code", tables, "name")


def codes_first_match(spark, d):
    nation, rows = _codes(spark, d)
    return shaping.first_match(rows, "code", nation, ["c3", "c2"], "name")


def lists_beside(spark, d):
    """Line numbers of an order beside the parts of its returned lines, a shorter list with nulls."""
    listed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("number"), F.array_sort(F.expr("collect_list(l_partkey) filter (where l_returnflag = 'R')")).alias("returned"))
    return shaping.parallel(listed, ["l_orderkey"], ["number", "returned"])


def regions_across(spark, d):
    """Facts of regions as rows, regions as columns."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    facts = nations.join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("r_name").agg(F.count_distinct("n_nationkey").alias("nations"), F.count("c_custkey").alias("customers"))
    return shaping.transposed(facts, "r_name", ["nations", "customers"])


def quantity_bins(spark, d):
    return table(spark, d, "lineitem").groupBy(X.bins(F.col("l_quantity"), EDGES, BINS).alias("bin")).agg(F.count("*").alias("n"))


def region_children(spark, d):
    """Nodes and their parents from lists of children."""
    lists = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list("n_name").alias("nations"))
    return shaping.parents(lists, "r_name", "nations")


def name_differences(spark, d):
    """How the name of a part differs from another writing of it, by kind."""
    k = F.col("p_partkey") % 5
    other = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat(F.lit(" "), F.col("p_name"))).when(k == 2, F.split_part("p_name", F.lit(" "), F.lit(2))).when(k == 3, F.col("p_type")).otherwise(F.col("p_name"))
    return table(spark, d, "part").groupBy(X.name_difference(F.col("p_name"), other).alias("kind")).agg(F.count("*").alias("n"))


def first_names(spark, d):
    """The first name that is there of an order's clerks by status and priority."""
    a, b = F.when(F.col("o_orderstatus") != "O", F.lower("o_orderstatus")).otherwise("nan"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("\t")))
    return table(spark, d, "orders").groupBy(X.first_present(a, b).alias("name")).agg(F.count("*").alias("n"))


def conflicts_resolved(spark, d):
    """Terms of both directions decided by their length; a third of them stay."""
    rows = search_terms.grouped(agreeing._directed(spark, d))
    n = F.length("search_term") % 4
    decided = rows.where("directionality_conflict").select("search_term", F.when(n == 0, "set-ltr").when(n == 1, "set-rtl").when(n == 2, "split").otherwise("keep").alias("decision"))
    return search_terms.resolve_conflicts(rows, decided)


def real_translations(spark, d):
    """Sentences that translate the source term at all, and next ones that know a word is kept, by language."""
    rows = views.texts(spark, d)
    return rows.groupBy("language").agg(F.count("*").alias("n"), F.count_if(X.is_real_translation(F.col("term"), SOURCE)).alias("real"), F.count_if(X.is_aware(F.col("rationale"))).alias("aware"))


def error_layers(spark, d):
    """Errors by the layer that they come from, and the status they get."""
    k = F.col("k") % 5
    message = F.when(k == 0, "status timed out").when(k == 1, "status token limit").when(k == 2, V.PARSE_PREFIX + '{"term": "x"}').when(k == 3, "rate limit, 429").otherwise("not supported")
    return views.errors(spark, d).groupBy(X.error_layer(X.error_kind(message)).alias("layer"), X.error_status(message).alias("status")).agg(F.count("*").alias("n"))


def last_props(spark, d):
    """The last dict of a text that has the key, with what stands around it."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('was {"k": -1}, then '), "props", F.lit(' and {"j": 2}'))).when(F.col("event_id") % 3 == 1, F.concat("props", F.lit(" or {'k': 0} at last"))).otherwise(F.lit('{"j": 1} only'))
    return table(spark, d, "events").select("event_id", shaping.last_dict(text, "k").alias("last"))


def lists_read(spark, d):
    """How often each word comes in names written as a list with quotes, as one without, or as a single value."""
    first, second, k = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("['"), first, F.lit("', '"), second, F.lit("']"))).when(k == 1, F.concat(F.lit(" ["), first, F.lit(" ,"), second, F.lit("] "))).otherwise(F.concat(F.lit(" "), first))
    return table(spark, d, "part").select(F.explode(shaping.list_or_one(text)).alias("word")).groupBy(X.slug(F.concat(F.lit("Word "), "word")).alias("word")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        lines_natural, orders_keeping_left, codes_by_length, codes_first_match, lists_beside, regions_across, quantity_bins, region_children, name_differences, first_names, conflicts_resolved,
        real_translations, error_layers, last_props, lists_read,
    )
}

CODES = "codes AS (SELECT c_custkey, c_nationkey AS k, CASE c_custkey % 4 WHEN 0 THEN printf('%02d', c_nationkey) WHEN 1 THEN printf('n%02d', c_nationkey) WHEN 2 THEN printf('n%02dx', c_nationkey) END AS code FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_any = lambda names, of: " OR ".join(of(n.replace("'", "''")) for n in names)

ORACLE_SQL = {
    "lines_natural": "WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R') SELECT l.l_orderkey, l.l_linenumber, l_quantity, r.l_returnflag FROM lineitem l JOIN r USING (l_orderkey, l_linenumber) WHERE l_quantity > 25",
    "orders_keeping_left": "SELECT o_orderkey, o_orderstatus, lines FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) USING (o_orderkey)",
    "codes_by_length": f"WITH {CODES} SELECT code, c_custkey, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 4 = 1 AND k % 3 <> 0 THEN n_name END AS name FROM codes JOIN nation ON k = n_nationkey",
    "codes_first_match": f"WITH {CODES} SELECT code, c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN n_name END AS name FROM codes JOIN nation ON k = n_nationkey",
    "lists_beside": """WITH n AS (SELECT l_orderkey, l_linenumber AS number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem), r AS (SELECT l_orderkey, l_partkey AS returned, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS i FROM lineitem WHERE l_returnflag = 'R')
 SELECT n.l_orderkey, number, returned FROM n LEFT JOIN r ON n.l_orderkey = r.l_orderkey AND n.i = r.i""",
    "regions_across": "WITH f AS (SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), l AS (UNPIVOT f ON nations, customers INTO NAME field VALUE x) SELECT field, " + ", ".join(f"CAST(min(x) FILTER (r_name = '{r}') AS VARCHAR) AS \"{r}\"" for r in REGIONS) + " FROM l GROUP BY 1",
    "quantity_bins": "SELECT CASE " + " ".join(f"WHEN l_quantity > {a} AND l_quantity <= {b} THEN '{name}'" for a, b, name in zip(EDGES, EDGES[1:], BINS)) + " END AS bin, count(*) AS n FROM lineitem GROUP BY 1",
    "region_children": "SELECT n_name AS code, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, NULL FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)",
    "name_differences": "SELECT CASE p_partkey % 5 WHEN 0 THEN 'case' WHEN 1 THEN 'case' WHEN 2 THEN 'qualifier' WHEN 3 THEN CASE WHEN contains(p_name, lower(p_type)) OR contains(lower(p_type), p_name) THEN 'qualifier' ELSE 'substantive' END ELSE 'same' END AS kind, count(*) AS n FROM part GROUP BY 1",
    "first_names": "SELECT CASE WHEN o_orderstatus <> 'O' THEN lower(o_orderstatus) WHEN o_orderkey % 3 = 0 THEN 'Other' ELSE o_orderpriority END AS name, count(*) AS n FROM orders GROUP BY 1",
    "conflicts_resolved": f"""WITH {GROUPED}, d AS (SELECT *, length(search_term) % 4 AS k FROM g) SELECT search_term, CASE WHEN directionality_conflict AND k = 0 THEN 'ltr' WHEN directionality_conflict AND k = 1 THEN 'rtl' ELSE directionality END AS directionality, natural_language FROM d WHERE NOT directionality_conflict OR k <> 2
 UNION ALL SELECT search_term, 'ltr', ltr_languages FROM d WHERE directionality_conflict AND k = 2 UNION ALL SELECT search_term, 'rtl', rtl_languages FROM d WHERE directionality_conflict AND k = 2""",
    "real_translations": f"""WITH {TEXTS} SELECT language, count(*) AS n, count(*) FILTER ({PRESENT} AND lower(trim(term, {SP})) <> '{SOURCE}' AND NOT (contains(lower(term), '{SOURCE}') OR regexp_matches(term, '\\bTT\\b')) AND NOT regexp_matches(term, '(?i){V.PLACEHOLDER_TERMS.replace("'", "''")}')) AS "real",
 count(*) FILTER ({_any(V.AWARE, lambda p: f"regexp_matches(rationale, '(?i){p}')")}) AS aware FROM texts GROUP BY 1""",
    "error_layers": f"WITH {ERRORS} SELECT CASE k % 5 WHEN 2 THEN 'parse_failure' WHEN 3 THEN 'unclassified' WHEN 4 THEN 'unclassified' ELSE 'request_failure' END AS layer, CASE k % 5 WHEN 2 THEN 400 WHEN 3 THEN 429 WHEN 4 THEN 400 ELSE 500 END AS status, count(*) AS n FROM errors GROUP BY 1, 2",
    "last_props": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{''k'': 0}' END AS last FROM events",
    "lists_read": "WITH w AS (SELECT split_part(p_name, ' ', 1) AS word FROM part UNION ALL SELECT split_part(p_name, ' ', 2) FROM part WHERE p_partkey % 3 < 2) SELECT 'word_' || word AS word, count(*) AS n FROM w GROUP BY 1",
}
