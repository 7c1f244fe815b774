"""Canonical views of the driver's tables: cells, texts, pairs, errors, hierarchy, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyagree.functions import fixed as V
from polyagree.operators.cells import keep_latest
from polyagree.sources.files import table

#: The white space that strip() takes off, as SQL.
SP = "'" + V.WHITE + "'"
CELLS = """cells AS (SELECT l_orderkey AS item, l_linenumber AS service, l_linestatus AS variant, l_returnflag AS term, l_shipdate AS ts FROM
 (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_linestatus ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_returnflag DESC) AS rn FROM lineitem) WHERE rn = 1)"""
TEXTS = r"""texts AS (SELECT doc_id, lang AS language, source AS service, CAST(i - 1 AS INTEGER) AS pos, s[i] AS term, s[i + 1] AS rationale FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM
 (SELECT doc_id, lang, source, list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)))"""
PAIRS = """pairs AS (SELECT conv_id, turn, text AS term, CASE WHEN next_role = 'assistant' THEN next_text END AS rationale FROM
 (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next_text FROM conversations) WHERE role = 'user')"""
ERRORS = """errors AS (SELECT event_id, user_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error')"""

#: Letters that stand for a to z in texts of other scripts; five kinds by the remainder of doc_id: as it is, Cyrillic, Greek, Cyrillic vowels among Latin, Arabic.
LETTERS, CYRILLIC, GREEK, ARABIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопърстувшюыз", "αβψδεφγηιξκλμνοπϙρστθωςχυζ", "ابثدعفغهيجكلمنوپقرستخڤشذظز"
VOWELS, CYRILLIC_VOWELS = "aeiou", "аеиоу"


def _scripted_sql(x: str) -> str:
    of = lambda a, b: f"translate({x}, '{a}{a.upper()}', '{b}{b}')"
    return f"CASE doc_id % 5 WHEN 1 THEN {of(LETTERS, CYRILLIC)} WHEN 2 THEN {of(LETTERS, GREEK)} WHEN 3 THEN {of(VOWELS, CYRILLIC_VOWELS)} WHEN 4 THEN {of(LETTERS, ARABIC)} ELSE {x} END"


def scripts_sql(rows: str, text: str) -> str:
    """Tables s, c and e of a table with doc_id: the text in its script, its letters, and script, mixed, wide and second."""
    letters = lambda n: f"regexp_extract_all(t, '\\p{{{n}}}')"
    return f"""s AS (SELECT *, {_scripted_sql(text)} AS t, CASE doc_id % 5 WHEN 2 THEN 'Greek' WHEN 4 THEN 'Arabic' ELSE 'Cyrillic' END AS other FROM {rows}),
 c AS (SELECT *, {letters('Latin')} AS l, CASE other WHEN 'Greek' THEN {letters('Greek')} WHEN 'Arabic' THEN {letters('Arabic')} ELSE {letters('Cyrillic')} END AS x FROM s),
 d AS (SELECT *, CASE WHEN len(l) = 0 AND len(x) = 0 THEN 'Unknown' WHEN len(l) > len(x) OR len(l) = len(x) AND strpos(t, l[1]) < strpos(t, x[1]) THEN 'Latin' ELSE other END AS script FROM c),
 m AS (SELECT *, CASE WHEN script = 'Latin' THEN x ELSE l END AS m, len(l) + len(x) AS n FROM d),
 w AS (SELECT *, len(m) > 0 AND len(m) >= CAST(0.1 AS DOUBLE) * n AS wide, CASE WHEN script = 'Latin' THEN other ELSE 'Latin' END AS second FROM m),
 e AS (SELECT *, wide AND (len(list_distinct(m)) >= 5 OR len(list_distinct(m)) >= 3 AND len(m) >= CAST(0.2 AS DOUBLE) * n) AS mixed FROM w)"""


def scripted(x: Column) -> Column:
    """A text in the script of its document's kind."""
    of = lambda a, b: F.translate(x, a + a.upper(), b + b)
    k = F.col("doc_id") % 5
    return F.when(k == 1, of(LETTERS, CYRILLIC)).when(k == 2, of(LETTERS, GREEK)).when(k == 3, of(VOWELS, CYRILLIC_VOWELS)).when(k == 4, of(LETTERS, ARABIC)).otherwise(x)


def cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_shipdate", "l_extendedprice", "l_partkey")
    last = keep_latest(rows, ["l_orderkey", "l_linenumber", "l_linestatus"], F.col("l_shipdate"), F.col("l_extendedprice"), F.col("l_partkey"), F.col("l_returnflag"))
    return last.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("service"), F.col("l_linestatus").alias("variant"), F.col("l_returnflag").alias("term"), F.col("l_shipdate").alias("ts"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every text is a term, and the next one its rationale."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("lang").alias("language"), F.col("source").alias("service"), "text")
    parts = F.filter(F.transform(F.split("text", "[.!?\\n]+"), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x != "")
    rows = docs.select("doc_id", "language", "service", parts.alias("s"))
    both = F.transform("s", lambda x, i: F.struct(x.alias("term"), F.get(F.col("s"), i + 1).alias("rationale")))
    return rows.select("doc_id", "language", "service", F.posexplode(both).alias("pos", "x")).select("doc_id", "language", "service", "pos", "x.term", "x.rationale")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, d, "conversations").withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)}).where("role = 'user'")
    return rows.select("conv_id", "turn", F.col("text").alias("term"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("rationale"))


def errors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
