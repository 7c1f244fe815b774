"""Queries on repaired terms, alike texts, families and genres."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyagree.functions import curation
from polyagree.operators import families, genre, similarity
from polyagree.sources.files import table

from . import views
from .views import SP


def curation_actions(spark, d):
    """What becomes of each document's first word, by source."""
    return curation.action_counts(views.texts(spark, d), "term", "service")


def rationale_similarity(spark, d):
    """How alike the turns of a conversation are phrased."""
    return similarity.mean_similarity(table(spark, d, "conversations"), "conv_id", ["turn", "role", "text"], "text")


def _registry(spark, d):
    """Customers stand for languages, nations for their families, regions for reconciled ones; the first nation's is blank."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("family_name"), F.when(F.col("n_nationkey") == 0, "").otherwise(F.col("r_name")).alias("family_name_reconciled"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("language_code"), F.col("c_name").alias("language_name"), F.col("c_mktsegment").alias("family_glottolog"), "c_nationkey")
    return rows.join(names, "c_nationkey").drop("c_nationkey")


def family_mapping(spark, d):
    return families.proposed_labels(families.mapping(_registry(spark, d)), "family", {"ASIA": "EURASIA", "EUROPE": "EURASIA"}, ["AFRICA"], ["AMERICA"], [])


def family_review(spark, d):
    rows = _registry(spark, d)
    pairs = table(spark, d, "nation").where("n_nationkey % 5 = 1").select(F.col("n_name").alias("family_name"), F.lit("BUILDING").alias("family_glottolog"), F.lit("PAIRED").alias("chosen"))
    one = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("language_code"), F.when(F.col("s_suppkey") % 2 == 0, "SINGLE").otherwise(" ").alias("chosen"))
    labels = table(spark, d, "region").select(F.col("r_name").alias("family"), F.concat(F.lit("label of "), "r_name").alias("label"))
    return families.reviewed(rows, pairs, one, labels).select("language_code", "reviewed", "review_source", "analysis")


def genre_confusion(spark, d):
    """Labels of documents predicted out of fold from their words."""
    rows = table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return genre.confusion(genre.out_of_fold(rows, "doc_id", "text", "quality", ["0", "1"]))


QUERIES = {f.__name__: f for f in (curation_actions, rationale_similarity, family_mapping, family_review, genre_confusion)}

REGISTRY = "registry AS (SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS name, c_mktsegment AS glottolog, n_nationkey, n_name AS raw, CASE WHEN n_nationkey = 0 THEN '' ELSE r_name END AS family FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"

SIMILAR = r"""k AS (SELECT *, row_number() OVER () AS r FROM (SELECT DISTINCT conv_id, turn, role, text FROM ROWS WHERE text IS NOT NULL AND lower(trim(text, WHITE)) NOT IN ('', 'nan', 'none', 'null'))),
 w AS (SELECT conv_id, r, ' ' || unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) || ' ' AS w FROM k), g AS (SELECT conv_id, r, substr(w, CAST(i AS BIGINT), CAST(z AS BIGINT)) AS gram FROM (SELECT conv_id, r, w, z, unnest(range(1, length(w) - z + 2)) AS i FROM w CROSS JOIN (VALUES (3), (4), (5)) AS s(z) WHERE z <= length(w))),
 tf AS (SELECT conv_id, r, gram, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT conv_id, count(DISTINCT r) AS n FROM w GROUP BY 1), d AS (SELECT conv_id, gram, count(*) AS df FROM tf GROUP BY ALL),
 x AS (SELECT conv_id, r, gram, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM tf JOIN d USING (conv_id, gram) JOIN n USING (conv_id)), u AS (SELECT conv_id, r, gram, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, r)) AS v FROM x),
 p AS (SELECT a.conv_id, sum(a.v * b.v) AS s FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.gram = b.gram AND a.r < b.r GROUP BY 1),
 alike AS (SELECT conv_id, n, CASE WHEN n > 1 THEN round(coalesce(s, 0) / (n * (n - 1) / 2), 4) END AS similarity FROM n LEFT JOIN p USING (conv_id))"""

ORACLE_SQL = {
    "rationale_similarity": "WITH " + SIMILAR.replace("WHITE", SP).replace("ROWS", "conversations") + " SELECT * FROM alike",
    "family_mapping": f"""WITH {REGISTRY}, c AS (SELECT family, raw, count(*) AS n FROM registry GROUP BY 1, 2), m AS (SELECT family, CAST(sum(n) AS BIGINT) AS n_languages, string_agg(raw || ': ' || n, '; ' ORDER BY n DESC, raw) AS raw_family_names FROM c GROUP BY 1),
 s AS (SELECT family, string_agg(code || ' (' || name || ')', '; ' ORDER BY name, code) AS sample_languages FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY name, code) AS k FROM registry) WHERE k <= 8 GROUP BY 1)
 SELECT family, n_languages, sample_languages, raw_family_names, CASE WHEN family = '' THEN 'Unassigned' WHEN family IN ('ASIA', 'EUROPE') THEN 'EURASIA' WHEN family = 'AMERICA' THEN 'Exclude from family aggregation' ELSE family END AS label,
 CASE WHEN family = '' THEN 'missing_family' WHEN family IN ('ASIA', 'EUROPE') THEN 'normalize_variant' WHEN family = 'AFRICA' THEN 'row_level_reconciliation' WHEN family = 'AMERICA' THEN 'exclude_special' ELSE 'preserve_reconciled' END AS action,
 CASE WHEN family IN ('', 'ASIA', 'EUROPE', 'AMERICA') THEN 'pending' WHEN family = 'AFRICA' THEN 'reference_only' ELSE 'accepted' END AS status FROM m JOIN s USING (family)""",
    "family_review": f"""WITH {REGISTRY}, t AS (SELECT *, code IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 2 = 0) AS one, n_nationkey % 5 = 1 AND glottolog = 'BUILDING' AS pair FROM registry), v AS (SELECT code AS language_code, CASE WHEN one THEN 'SINGLE' WHEN pair THEN 'PAIRED' WHEN family = '' THEN raw ELSE family END AS reviewed,
 CASE WHEN one THEN 'language' WHEN pair THEN 'pair' ELSE 'reconciled' END AS review_source FROM t) SELECT *, CASE WHEN reviewed IN (SELECT r_name FROM region) THEN 'label of ' || reviewed ELSE reviewed END AS analysis FROM v""",
}
