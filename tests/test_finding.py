"""Results of searches, registers of definitions, wide exports and embeddings, against plain Python."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from polyagree.functions import fixed as V
from polyagree.operators import explorer, registers, results
from polyagree.plans import finding

DATA = "/root/testdata/sf0.001"
TERMS = [("Loan", "en, fr", "ltr", "a, b"), ("glosa ", "es", "rtl", "b"), ("nada", "", "ltr", "a"), ("Wort", "de, sw", "ltr", "b, a")]
FOUND = [("repos", 1, "loan"), ("repos", 1, " LOAN"), ("repos", 1, "glosa"), ("repos", 2, "wort"), ("users", 1, "Glosa"), ("repos", 3, "stale"), ("repos", None, "loan"), ("users", 9, "wort\t"), ("repos", 4, "glosa")]


def _tables(spark):
    return spark.createDataFrame(FOUND, "kind string, id long, search_term string"), spark.createDataFrame(TERMS, "search_term string, natural_language string, direction string, category string")


def test_results_count_each_id_once_and_known_terms_only(spark):
    found, terms = _tables(spark)
    got = {r.kind: (r.raw_rows, r.unique_items, r.terms_that_hit, r.avg_term_hits) for r in results.repeats(found, terms).collect()}
    assert got == {"repos": (6, 3, 3, 2.0), "users": (2, 2, 2, 1.0)}
    hits = results.hits(found, terms, ["repos", "users"])
    assert {r.term: (r.n_repos, r.n_users, r.total, r.any_hit) for r in hits.collect()} == {"loan": (1, 0, 1, True), "glosa": (2, 1, 3, True), "nada": (0, 0, 0, False), "wort": (1, 1, 2, True)}
    by = {r.direction: tuple(r)[1:] for r in results.productivity(hits, "direction").collect()}
    assert by == {"ltr": (3, 2, 3, 66.7, 1.5), "rtl": (1, 1, 3, 100.0, 3.0)}
    none = results.productivity(hits.where("term = 'nada'").withColumn("c", results.primary(F.col("category"))), "c").first()
    assert (none.hit_rate_pct, none.avg_per_hit) == (0.0, None)


def test_languages_beyond_the_first_add_results(spark):
    found, terms = _tables(spark)
    got = {r.kind: r.asDict() for r in results.added_value(found, terms, "en", ["es"]).collect()}
    assert {k: (r["first_only"], r["major_only"], r["full"], r["added_over_first"], r["added_over_major"], r["first_pct"]) for k, r in got.items()} == {"repos": (1, 2, 3, 2, 1, 33.3), "users": (0, 1, 2, 2, 1, 0.0)}
    families = spark.createDataFrame([("en", "west"), ("fr", "roman"), ("es", "roman"), ("de", "west"), ("sw", None)], "language string, family string")
    reach = {r.family: (r.n_repos, r.n_users, r.total, r.unique, r.reach) for r in results.reached(found, terms, families, ["repos", "users"], "en", ["es"]).collect()}
    assert reach == {"west": (2, 1, 3, 2, "first"), "roman": (2, 1, 3, 2, "first")}
    own = families.select("language", F.col("language").alias("code"))
    reach = {r.code: (r.total, r.unique, r.reach) for r in results.reached(found, terms, own, ["repos", "users"], "en", ["es"], "code").collect()}
    assert reach == {"en": (1, 0, "first"), "fr": (1, 0, "first"), "es": (3, 2, "first"), "de": (2, 2, "multilingual only"), "sw": (2, 2, "multilingual only")}
    assert results.reached(found.limit(0), terms, families, ["repos"], "en", []).collect() == []


def test_registers_and_their_flags(spark):
    said = [
        ("a", "x", "It combines the word for digital with that for people", 2), ("a", "y", "An Interdisciplinary field; scholarly work on digital texts", 0), ("a", "y", "digital wisdom and knowledge", 4),
        ("b", "x", None, 7), ("b", "x", "  ", 7), ("b", "x", "plain", None), ("b", "y", "technology and human culture", 1),
    ]
    rows = registers.marked(spark.createDataFrame(said, "service string, variant string, why string, flags int"), "why", V.REGISTERS | V.GLOSSES, has_humanities_gloss_any=["has_humanities_gloss_scholar", "has_humanities_gloss_generic"])
    names = list(V.REGISTERS)
    got = {r.service: (r.n, *(r[n] for n in names)) for r in registers.prevalence(rows, ["service"], names).collect()}
    assert got == {"a": (3, 33.3, 33.3, 0.0, 33.3), "b": (2, 0.0, 0.0, 0.0, 0.0)}
    gap = {r.service: (r.has_digital_gloss, r.has_humanities_gloss_any, r.gap) for r in registers.asymmetry(rows, ["service"], "has_digital_gloss", "has_humanities_gloss_any").collect()}
    assert gap == {"a": (0.0, 33.3, -33.3), "b": (50.0, 50.0, 0.0)}
    effect = {(r.service, r.variant, r.register): r.effect for r in registers.by_variant(rows, "service", "variant", names, "x").collect()}
    assert effect["a", "y", "compositional_literal"] == -100.0 and effect["a", "y", "scholarly_methodological"] == 50.0 and effect["a", "x", "knowledge_generic"] == 0.0
    flags = {r.register: (r.with_n, r.without_n, r.with_mean, r.without_mean) for r in registers.flags_by(rows, "flags", names).collect()}
    assert flags["knowledge_generic"] == (1, 4, 4.0, 0.75) and flags["human_centered"] == (0, 5, None, 1.4)


def test_exports_are_wide_and_placed(spark):
    base = spark.createDataFrame([(1, "none", 3), (2, "odd", 2), (3, "whole", 1), (4, "odd", 5)], "item int, category string, n int")
    scores = spark.createDataFrame([(1, "v2", 0.5, 1, 2), (1, "v1", 1.0, 3, 3), (2, "v2", 0.25, 1, 4)], "item int, variant string, llm double, agreeing_services int, total_services int")
    frame = explorer.confidences(scores, ["item"], "variant", ["v1", "v2"], ["llm"])
    got = {r.item: (r.place, r.mean_llm, r.n_total) for r in explorer.export(base, [frame], ["item"], "category", ["odd", "whole"], "n").collect()}
    assert got == {4: (1, None, None), 2: (2, 0.25, 4), 3: (3, None, None), 1: (4, 0.75, 3)}
    said = spark.createDataFrame([(1, "abcd"), (1, "nan"), (1, None), (2, None), (3, "abc"), (3, "ab")], "item int, why string")
    assert {r["item"]: r.mean_length for r in explorer.lengths(said, ["item"], "why").collect()} == {1: 2.0, 2: None, 3: 2.5}
    cells = spark.createDataFrame([(1, "b", "x"), (1, "b", " "), (2, "a", None), (3, "z", "t")], "item int, service string, term string")
    assert {r["item"]: (r.n_services, r.missing, r.tier) for r in explorer.missing(cells, ["item"], "service", ["a", "b"]).collect()} == {1: (1, "a", "sparse"), 2: (0, "a; b", "none"), 3: (0, "a; b", "none")}


def test_the_map_of_embeddings_is_that_of_plain_algebra(spark):
    rows = [r for r in pq.read_table(f"{DATA}/embeddings.parquet").to_pylist() if r["embedding"] is not None]
    at = np.array([r["embedding"] for r in rows], np.float64)
    axes = np.linalg.svd(at - at.mean(0), full_matrices=False)[2][:2]
    axes = np.array([a if a[abs(a).argmax()] > 0 else -a for a in axes])
    want = {r["vec_id"]: v for r, v in zip(rows, (at - at.mean(0)) @ axes.T)}
    got = finding.embedding_map(spark, DATA).collect()
    assert len(got) == len(rows) and all(abs(r.d1 - want[r.vec_id][0]) < 1e-5 and abs(r.d2 - want[r.vec_id][1]) < 1e-5 for r in got)
    assert sum(r.n for r in finding.embedding_clusters(spark, DATA).collect()) == len(rows)
