"""Queries on tables in HTML, the steps of a registry and the evidence for its families, errors beside signals, and clusters of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyagree.operators import errors, registry_build
from polyagree.sources import html
from polyagree.sources.files import table

from . import views
from .views import ERRORS

RIGHT_TO_LEFT = ("Arab",)
SERVICES = ("alpha", "beta")
FALLBACKS, LEGACY = {"bcd": "b-c-d"}, {"zz": "ca", "zy": "ca", "zx": "eaa"}
SIGNALS, KINDS = ("cart", "click", "purchase", "signup", "view"), ("api_error", "max_tokens", "parse_format", "other")


def page_tables(spark, d):
    """Every order is a page: a table of its lines whose first cell spans them all, with the flag over two columns and a table within the last cell; read back, row by row."""
    w = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", "l_partkey"))).alias("x"))
    line = lambda x, i: F.concat(
        F.lit("<TR>"), F.when(i == 0, F.concat(F.lit('<th rowspan="'), F.size("x").cast("string"), F.lit('">order<br>'), F.col("l_orderkey").cast("string"), F.lit("</th>"))).otherwise(""),
        F.lit("<td colspan=2> "), x["l_returnflag"], F.lit(" &amp; <b>"), x["l_linestatus"], F.lit("</b><td>"), F.lit("<table><tr><td>part</td><td>"), x["l_partkey"].cast("string"), F.lit("</table></td></tr>\n"),
    )
    pages = w.select(F.col("l_orderkey").alias("page_id"), F.concat(F.lit("<html><!-- <table> --><table class=a>"), F.array_join(F.transform("x", line), ""), F.lit("</table>")).alias("html"))
    return html.tables(pages, "page_id").select("page_id", F.col("table").alias("table_id"), F.col("row").alias("row_id"), F.array_join("cells", "|").alias("cells"))


def _letters(k, n):
    """A code of n letters for a number; codes of high numbers come again."""
    k = k.cast("long")
    return F.concat(*(F.char((F.lit(97) + F.floor(k / 26**i) % 26).cast("int")) for i in range(n)))


def _sources(spark, d):
    key = F.col("c_custkey")
    code = F.when(key % 10 == 0, _letters(F.floor(key / 10), 2)).otherwise(_letters(key, 3))
    script = F.when(F.col("c_nationkey") % 3 == 0, "").when(F.col("c_nationkey") % 3 == 1, "Latn").otherwise("Arab")
    main = table(spark, d, "customer").where(key % 3 == 0).select(
        code.alias("code"), F.when(key % 7 == 0, code).otherwise(F.lower("c_mktsegment")).alias("name"), script.alias("script"),
        (F.col("c_nationkey") % 4).alias("n_scripts"), (F.col("c_acctbal") > 0).alias("modern"), (F.col("c_nationkey") == 1).alias("is_official"),
    )
    s = F.col("s_suppkey")
    community = table(spark, d, "supplier").select(
        F.when(s % 2 == 0, _letters(s, 2)).otherwise(_letters(s, 3)).alias("code"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 4 == 0, "rtl").when(F.col("s_nationkey") % 4 == 1, "ltr").alias("direction"), F.col("s_name").alias("local_name"),
    )
    p = F.col("p_partkey")
    official = table(spark, d, "part").select(
        _letters(p, 3).alias("code"), F.lower("p_brand").alias("bibliographic"), F.when(p % 5 == 0, _letters(F.floor(p / 5), 2)).otherwise("").alias("short"), F.col("p_name").alias("primary_name"), (F.col("p_size") % 9 == 0).alias("is_group"),
    )
    return main, community, official


def _merged(spark, d):
    out = registry_build.merged(*_sources(spark, d), RIGHT_TO_LEFT, ["ab"])
    n = F.col("n_nationkey")
    extra = table(spark, d, "nation").select(_letters(n * 700 + 1, 3).alias("code"), F.lower("n_name").alias("name"), F.when(n % 2 == 0, "rtl").otherwise("ltr").alias("direction"), (n % 3 == 0).alias("modern"))
    return registry_build.supplemented(out, extra, "supplement")


def registry_merged(spark, d):
    """Customers, suppliers and parts stand for a main, a community's and an official list of codes; nations supplement them."""
    return _merged(spark, d)


def _families(spark, d):
    s, c, p = F.col("s_suppkey"), F.col("c_custkey"), F.col("p_partkey")
    group = lambda k: F.concat(F.lit("G"), k.cast("long").cast("string"))
    hierarchy = table(spark, d, "supplier").select(group(s).alias("code"), F.when(s >= 5, group(F.floor(s / 5))).alias("parent"), F.concat(F.lit("Stock "), s.cast("string"), F.lit(" languages")).alias("name"))
    by_hand = table(spark, d, "customer").where(c % 4 == 0).select(_letters(c, 3).alias("code"), F.when(c % 16 == 0, "isolate").otherwise(group(1 + c % 9)).alias("family_code"))
    assessed = table(spark, d, "customer").where(c % 5 == 0).select(_letters(c, 3).alias("code"), F.when(c % 2 == 0, group(1 + c % 7)).otherwise("").alias("family_code"), F.concat(F.lit("Stock "), (1 + c % 3).cast("string")).alias("family_name"))
    rows = registry_build.with_families(_merged(spark, d), hierarchy, by_hand, assessed)
    parts = table(spark, d, "part")
    rows = registry_build.named_from(rows, parts.select(_letters(p, 3).alias("code"), F.col("p_name").alias("name")), {"ca": "Ca"})
    other = parts.select(_letters(p, 3).alias("code"), F.concat(F.lit("stock "), (1 + p % 4).cast("string"), F.lit(" Family")).alias("family"))
    one = table(spark, d, "region").select(F.lit("Stock 1 languages").alias("family_name"), F.concat(F.lit("stock "), (1 + F.col("r_regionkey")).cast("string"), F.lit(" Family")).alias("family_other"), F.lit("First").alias("chosen"))
    return registry_build.reconciled(rows, other, one), one, assessed, by_hand


def registry_families(spark, d):
    """Families by a hierarchy of groups, by hand and by assessment, names that lack, and names that two lists give otherwise."""
    return _families(spark, d)[0].select("code", "name", "family_direct", "family_code", "family_name", "subfamily_name", "family_other", "family_name_reconciled")


def families_undecided(spark, d):
    rows, decisions, _, _ = _families(spark, d)
    return registry_build.undecided(rows, decisions)


def registry_services(spark, d):
    """Rows carried on from a run before, tags and candidates, and the codes of two services that take some of them."""
    rows = _merged(spark, d)
    c = F.col("c_custkey")
    before = table(spark, d, "customer").where(c % 4 == 0).select(_letters(c, 3).alias("code"), F.lit("was").alias("name")).dropDuplicates(["code"]).withColumns({"first_seen": F.lit("2024-01-01"), "last_seen": F.lit("2024-03-01")})
    rows = registry_build.carried_on(before, rows, "2024-06-01")
    rows = registry_build.identified(rows, FALLBACKS, LEGACY)
    k = F.col("p_partkey")
    support = table(spark, d, "part").select(F.when(k % 3 == 0, "alpha").when(k % 3 == 1, "beta").otherwise("gamma").alias("service"), F.when(k % 2 == 0, _letters(k, 3)).otherwise(_letters(F.floor(k / 7), 2)).alias("code"))
    out = registry_build.matched(rows, support, SERVICES)
    return out.select("code", "first_seen", "last_seen", "tag", "tag_source", "tag_is_code", F.array_join("candidates", "|").alias("candidates"), *(x for s in SERVICES for x in (f"{s}_code", f"{s}_supported")))


def registry_growth(spark, d):
    """What each list adds to the codes of those before it, and what it confirms."""
    steps = {"short": F.col("in_short"), "community": F.col("in_community"), "official": F.col("in_official"), "main": F.startswith("sources", F.lit("main"))}
    return registry_build.build_up(_merged(spark, d), "code", steps)


def registry_enrichment(spark, d):
    rows = _families(spark, d)[0]
    layers = {
        "group": (F.col("family_direct") != "", F.col("family_name") != ""), "local_name": (F.col("local_name") != "", F.col("local_name") != F.col("name")),
        "other_list": (F.col("family_other") != "", F.col("family_name_reconciled") != F.col("family_name")), "direction": (F.col("direction_community") != "", F.col("direction_community") != F.col("direction")),
    }
    return registry_build.enrichment(rows, layers)


def _evidence(spark, d):
    rows, _, assessed, by_hand = _families(spark, d)
    read = assessed.groupBy("code").agg(F.lit(True).alias("read"))
    hand = by_hand.select("code").distinct().withColumn("hand", F.lit(True))
    rows = rows.join(read, "code", "left").join(hand, "code", "left")
    return registry_build.family_evidence(rows, F.col("family_name"), F.col("hand"), F.col("read"), F.col("read") & (F.char_length("code") == 3), F.startswith("family_code", F.lit("G")), F.col("family_direct") != "")


def family_evidence(spark, d):
    return registry_build.evidence_by_family(_evidence(spark, d), "family_name")


def family_evidence_combos(spark, d):
    return registry_build.evidence_shares(_evidence(spark, d), "family_combo")


def _kind(k):
    return F.when(k % 6 == 0, "api_error").when(k % 6 == 1, "max_tokens").when(k % 6 == 2, "parse_format").otherwise("other")


def signals_by_error(spark, d):
    """Users stand for languages: kinds of events they have beside kinds of their errors."""
    signals = table(spark, d, "events").select("user_id", F.col("event_type").alias("signal"))
    return errors.signals_by_kind(signals, views.errors(spark, d).select("user_id", _kind(F.col("k")).alias("kind")), ["user_id"], SIGNALS, KINDS)


def failing_together(spark, d):
    """Users whose errors come from two services or more, and the services that fail otherwise."""
    rows = views.errors(spark, d).withColumns({"service": F.col("k") % 7, "kind": _kind(F.col("k"))})
    return errors.several_services(rows, ["user_id"], "service", F.col("kind") == "other", F.col("kind") == "api_error")


def reply_openings(spark, d):
    """How replies of each role begin."""
    return errors.openings(table(spark, d, "conversations").where("text is not null"), ["role"], F.col("text"), words=3, top=5)


QUERIES = {f.__name__: f for f in (page_tables, registry_merged, registry_families, families_undecided, registry_services, registry_growth, registry_enrichment, family_evidence, family_evidence_combos, signals_by_error, failing_together, reply_openings)}


def _sql_letters(k: str, n: int) -> str:
    return "(" + " || ".join(f"chr(CAST(97 + ({k}) // {26**i} % 26 AS INTEGER))" for i in range(n)) + ")"


L2, L3 = (lambda k: _sql_letters(k, 2)), (lambda k: _sql_letters(k, 3))
MERGED = f"""main0 AS (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN {L2('c_custkey // 10')} ELSE {L3('c_custkey')} END AS code FROM customer WHERE c_custkey % 3 = 0),
main AS (SELECT code, CASE WHEN c_custkey % 7 = 0 THEN code ELSE lower(c_mktsegment) END AS name, CASE c_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Latn' ELSE 'Arab' END AS script, CAST(c_nationkey % 4 AS INTEGER) AS n_scripts, c_acctbal > 0 AS modern, c_nationkey = 1 AS is_official FROM main0),
com AS (SELECT code, min(s_name) AS name, min(direction) AS direction_community, min(s_name) AS local_name FROM (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN {L2('s_suppkey')} ELSE {L3('s_suppkey')} END AS code, CASE s_nationkey % 4 WHEN 0 THEN 'rtl' WHEN 1 THEN 'ltr' ELSE '' END AS direction FROM supplier) GROUP BY 1),
off AS (SELECT {L3('p_partkey')} AS code, min(lower(p_brand)) AS bibliographic, min(CASE WHEN p_partkey % 5 = 0 THEN {L2('p_partkey // 5')} ELSE '' END) AS short, min(p_name) AS name FROM part WHERE p_size % 9 <> 0 GROUP BY 1),
bth AS (SELECT code, name, script, n_scripts, modern, is_official, 'main' AS base, 0 AS rk FROM main UNION ALL SELECT code, name, '', 0, true, false, 'community_only', 1 FROM com),
al AS (FROM bth UNION ALL SELECT CASE WHEN short <> '' THEN short ELSE code END, name, '', 0, true, false, 'official_only', 2 FROM off WHERE code NOT IN (SELECT code FROM bth) AND short NOT IN (SELECT code FROM bth)),
rw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY rk, name, script, n_scripts, modern, is_official, base) AS rn FROM al) WHERE rn = 1 AND code <> 'ab'),
ids AS (SELECT code AS id, code AS official, bibliographic, short FROM off UNION ALL SELECT short, min(code), min(bibliographic), short FROM off WHERE short <> '' GROUP BY short),
st AS (SELECT rw.code, rw.name, coalesce(local_name, '') AS local_name, CASE WHEN length(rw.code) = 2 THEN rw.code ELSE coalesce(ids.short, '') END AS short, coalesce(official, '') AS official, coalesce(bibliographic, '') AS bibliographic, script, n_scripts, coalesce(direction_community, '') AS direction_community, modern, is_official, com.code IS NOT NULL AS in_community, base FROM rw LEFT JOIN ids ON rw.code = id LEFT JOIN com ON com.code = rw.code),
mg AS (SELECT code, name, local_name, short, official, bibliographic, script, n_scripts, CASE WHEN script = 'Arab' OR script = '' AND direction_community = 'rtl' THEN 'rtl' ELSE 'ltr' END AS direction, direction_community, modern, is_official, length(short) = 2 AS in_short, length(official) = 3 AS in_official, in_community,
 base || CASE WHEN base <> 'official_only' AND length(short) = 2 THEN '|short' ELSE '' END || CASE WHEN base <> 'official_only' AND length(official) = 3 THEN '|official' ELSE '' END || CASE WHEN base <> 'community_only' AND in_community THEN '|community' ELSE '' END AS sources FROM st),
merged AS (FROM mg UNION ALL SELECT code, min(lower(n_name)), '', '', '', '', '', 0, min(CASE WHEN n_nationkey % 2 = 0 THEN 'rtl' ELSE 'ltr' END), '', min(n_nationkey % 3 = 0), false, false, false, false, 'supplement' FROM (SELECT *, {L3('n_nationkey * 700 + 1')} AS code FROM nation) WHERE code NOT IN (SELECT code FROM mg) GROUP BY code)"""
PLAIN = "lower(regexp_replace({0}, '(?i)\\s+(languages?|family)$', ''))"
FAMILIES = f"""{MERGED}, up AS (SELECT s_suppkey AS s, s_suppkey AS r FROM supplier UNION ALL SELECT s, r // 5 FROM up WHERE r >= 5), tops AS (SELECT 'G' || s AS direct, 'G' || r AS root, 'Stock ' || r || ' languages' AS root_name, 'Stock ' || s || ' languages' AS direct_name FROM up WHERE r < 5),
hand AS (SELECT {L3('c_custkey')} AS code, min(CASE WHEN c_custkey % 16 = 0 THEN 'isolate' ELSE 'G' || (1 + c_custkey % 9) END) AS hand FROM customer WHERE c_custkey % 4 = 0 GROUP BY 1),
rd AS (SELECT {L3('c_custkey')} AS code, min(CASE WHEN c_custkey % 2 = 0 THEN 'G' || (1 + c_custkey % 7) END) AS read, min('Stock ' || (1 + c_custkey % 3)) AS read_name FROM customer WHERE c_custkey % 5 = 0 GROUP BY 1),
f0 AS (SELECT m.*, coalesce(h.hand, o.hand, read) AS dir, h.code IS NOT NULL AS has_hand, rd.code IS NOT NULL AS has_read, read_name FROM merged m LEFT JOIN hand h ON h.code = m.code LEFT JOIN hand o ON o.code = m.official LEFT JOIN rd ON rd.code = m.code),
f1 AS (SELECT f0.*, CASE WHEN dir = 'isolate' THEN 'isolate' ELSE coalesce(root, dir) END AS top, CASE WHEN dir = 'isolate' THEN 'Language isolate' ELSE root_name END AS known, direct_name FROM f0 LEFT JOIN tops ON direct = dir),
nm AS (SELECT {L3('p_partkey')} AS code, min(p_name) AS given, min('stock ' || (1 + p_partkey % 4) || ' Family') AS theirs FROM part GROUP BY 1),
f2 AS (SELECT f1.* EXCLUDE (name), CASE WHEN name = f1.code THEN CASE WHEN f1.code = 'ca' THEN 'Ca' ELSE coalesce(a.given, name) END ELSE name END AS name, coalesce(dir, '') AS family_direct, coalesce(top, '') AS family_code, coalesce(known, read_name, '') AS family_name, CASE WHEN known IS NULL THEN coalesce(read_name, direct_name, '') ELSE coalesce(direct_name, known) END AS subfamily_name, coalesce(b.theirs, '') AS family_other
 FROM f1 LEFT JOIN nm a ON a.code = f1.code LEFT JOIN nm b ON b.code = CASE WHEN length(f1.code) = 3 THEN f1.code WHEN length(official) = 3 THEN official END),
f3 AS (SELECT *, family_other <> '' AND {PLAIN.format('family_name')} <> {PLAIN.format('family_other')} AS differ, family_name = 'Stock 1 languages' AND family_other IN (SELECT 'stock ' || (1 + r_regionkey) || ' Family' FROM region) AS decided FROM f2),
families AS (SELECT *, CASE WHEN differ AND decided THEN 'First' ELSE family_name END AS family_name_reconciled FROM f3)"""
EVIDENCE = f"""{FAMILIES}, evidence AS (SELECT *, CASE WHEN family_name = '' THEN 'unassigned' WHEN has_hand THEN 'by_hand' WHEN has_read AND length(code) = 3 THEN 'assessed' WHEN family_direct <> '' THEN 'direct' ELSE 'other' END AS family_source,
 coalesce(nullif(concat_ws(' + ', CASE WHEN has_hand THEN 'by_hand' END, CASE WHEN has_read THEN 'assessed' END, CASE WHEN starts_with(family_code, 'G') THEN 'hierarchy' END, CASE WHEN family_name = '' THEN 'unassigned' END), ''), 'other') AS family_combo FROM families)"""
LINES = "w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus, l_partkey) - 1 AS i FROM lineitem)"
KIND = "CASE k % 6 WHEN 0 THEN 'api_error' WHEN 1 THEN 'max_tokens' WHEN 2 THEN 'parse_format' ELSE 'other' END"
LAYERS = {"group": ("family_direct <> ''", "family_name <> ''"), "local_name": ("local_name <> ''", "local_name <> name"), "other_list": ("family_other <> ''", "family_name_reconciled <> family_name"), "direction": ("direction_community <> ''", "direction_community <> direction")}
STEPS = ["in_short", "in_community", "in_official", "starts_with(sources, 'main')"]
TAG = "CASE WHEN code = 'bcd' THEN 'b-c-d' WHEN short <> '' THEN short WHEN official <> '' THEN official ELSE code END"
OLD = "CASE {0} WHEN 'ca' THEN ['zy', 'zz'] WHEN 'eaa' THEN ['zx'] ELSE [] END"
_forms = " || ".join(f"CASE WHEN {c} <> '' AND lower({c}) NOT IN ('none', 'null') THEN [{c}] || [replace({c}, '_', '-')] || CASE WHEN {c} = 'b-c-d' THEN ['b-c-d'] ELSE [{u}] END || {OLD.format(u)} ELSE [] END" for c, u in (("tag", "tag"), ("code", "code"), ("short", "short"), ("official", "official"), ("bibliographic", "usual")))

ORACLE_SQL = {
    "page_tables": f"WITH {LINES} SELECT l_orderkey AS page_id, 0 AS table_id, CAST(i AS INTEGER) AS row_id, 'order ' || l_orderkey || '|' || l_returnflag || ' & ' || l_linestatus || '|' || l_returnflag || ' & ' || l_linestatus || '|' AS cells FROM w UNION ALL SELECT l_orderkey, CAST(i + 1 AS INTEGER), 0, 'part|' || l_partkey FROM w",
    "registry_merged": f"WITH {MERGED} SELECT * FROM merged",
    "registry_families": f"WITH RECURSIVE {FAMILIES} SELECT code, name, family_direct, family_code, family_name, subfamily_name, family_other, family_name_reconciled FROM families",
    "families_undecided": f"WITH RECURSIVE {FAMILIES} SELECT family_name, family_other, count(*) AS n FROM families WHERE differ AND family_name <> '' AND NOT decided GROUP BY 1, 2",
    "registry_services": f"""WITH {MERGED}, prev AS (SELECT DISTINCT {L3('c_custkey')} AS code FROM customer WHERE c_custkey % 4 = 0), c AS (SELECT code, short, official, bibliographic, CASE WHEN code IN (SELECT code FROM prev) THEN '2024-01-01' ELSE '2024-06-01' END AS first_seen, '2024-06-01' AS last_seen FROM merged UNION ALL SELECT code, '', '', '', '2024-01-01', '2024-03-01' FROM prev WHERE code NOT IN (SELECT code FROM merged)),
 t AS (SELECT *, {TAG} AS tag, CASE WHEN code = 'bcd' THEN 'fallback' WHEN short <> '' THEN 'short' WHEN official <> '' THEN 'long' ELSE 'code' END AS tag_source, lower(bibliographic) AS usual FROM c), l AS (SELECT *, {_forms} AS raw FROM t), u AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS cand FROM l),
 s AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS service, CASE WHEN p_partkey % 2 = 0 THEN {L3('p_partkey')} ELSE {L2('p_partkey // 7')} END AS exact FROM part), e AS (SELECT code, unnest(range(1, len(cand) + 1)) AS i, cand FROM u),
 m AS (SELECT code, arg_min(exact, i) FILTER (service = 'alpha') AS a, arg_min(exact, i) FILTER (service = 'beta') AS b FROM e JOIN (SELECT DISTINCT service, exact FROM s) ON exact = cand[i] GROUP BY 1)
 SELECT u.code, first_seen, last_seen, tag, tag_source, lower(tag) = lower(u.code) AS tag_is_code, array_to_string(cand, '|') AS candidates, coalesce(a, '') AS alpha_code, a IS NOT NULL AS alpha_supported, coalesce(b, '') AS beta_code, b IS NOT NULL AS beta_supported FROM u LEFT JOIN m ON m.code = u.code""",
    "registry_growth": f"WITH {MERGED}, x AS (SELECT code, CASE " + " ".join(f"WHEN {s} THEN {i}" for i, s in enumerate(STEPS)) + f" ELSE {len(STEPS)} END AS f, " + ", ".join(f"{s} AS m{i}" for i, s in enumerate(STEPS)) + " FROM merged), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY code) AS rn FROM x) "
    + " UNION ALL ".join(f"SELECT {i} AS step, '{n}' AS source, count(*) FILTER (f = {i}) AS added, count(*) FILTER (f <= {i}) AS cumulative, count(*) FILTER (m{i} AND f < {i}) AS confirmed, coalesce(string_agg(code, ', ' ORDER BY code) FILTER (f = {i} AND rn <= 8), '') AS examples FROM r" for i, n in enumerate(("short", "community", "official", "main")))
    + " UNION ALL SELECT 4, NULL, count(*) FILTER (f = 4), count(*), 0, '' FROM r",
    "registry_enrichment": f"WITH RECURSIVE {FAMILIES} " + " UNION ALL ".join(f"SELECT '{n}' AS layer, count(*) FILTER ({a}) AS enriched, count(*) FILTER ({b}) AS changed, round(count(*) FILTER ({a}) / count(*), 6) AS share FROM families" for n, (a, b) in LAYERS.items()),
    "family_evidence": f"WITH RECURSIVE {EVIDENCE} SELECT family_name, " + ", ".join(f"count(*) FILTER (family_source = '{s}') AS {s}" for s in registry_build.FAMILY_SOURCES) + ", count(*) AS total FROM evidence GROUP BY 1",
    "family_evidence_combos": f"WITH RECURSIVE {EVIDENCE} SELECT family_combo, count(*) AS n, round(count(*) / (SELECT count(*) FROM evidence), 6) AS share FROM evidence GROUP BY 1",
    "signals_by_error": f"WITH {ERRORS}, s AS (SELECT DISTINCT user_id, event_type AS signal FROM events), e AS (SELECT DISTINCT user_id, {KIND} AS kind FROM errors), b AS (SELECT signal, kind, count(*) AS n FROM s JOIN e USING (user_id) GROUP BY 1, 2) SELECT signal, kind, coalesce(n, 0) AS n FROM (SELECT unnest({list(SIGNALS)}) AS signal) CROSS JOIN (SELECT unnest({list(KINDS)}) AS kind) LEFT JOIN b USING (signal, kind)",
    "failing_together": f"WITH {ERRORS}, e AS (SELECT user_id, k % 7 AS service, {KIND} AS kind FROM errors), g AS (SELECT user_id, coalesce(list_sort(list(DISTINCT service) FILTER (kind = 'other')), []) AS f, coalesce(list_sort(list(DISTINCT service) FILTER (kind = 'api_error')), []) AS h0 FROM e GROUP BY 1), x AS (SELECT user_id, f, list_filter(h0, lambda y: NOT list_contains(f, y)) AS h FROM g WHERE len(f) >= 2) SELECT user_id, CAST(len(f) AS INTEGER) AS n_services, array_to_string(f, ',') AS services, CAST(len(h) AS INTEGER) AS n_honest, array_to_string(h, ',') AS honest FROM x",
    "reply_openings": "WITH o AS (SELECT role, array_to_string(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')[1:3], ' ') AS opening FROM conversations WHERE text IS NOT NULL), c AS (SELECT role, opening, count(*) AS n FROM o GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, opening) AS rank, sum(n) OVER (PARTITION BY role) AS t, sum(n) OVER (PARTITION BY role ORDER BY n DESC, opening ROWS UNBOUNDED PRECEDING) AS s FROM c) SELECT role, CAST(rank AS INTEGER) AS rank, opening, n, round(n / t, 6) AS share, round(s / t, 6) AS cumulative FROM r WHERE rank <= 5",
}
