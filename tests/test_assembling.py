"""Assembly, comparison, orders, codes, readers of archives and maps of embeddings on small fixtures, odd values among them."""

import io
import tarfile

import numpy as np
from pyspark.sql import functions as F

from polyagree.functions import text as X
from polyagree.operators import assembly, comparison, genre, ordering, projection, registry
from polyagree.sources import files

CELL = "item long, service string, variant string, term string, rationale string, ts int"


def got(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_a_service_without_prompts_belongs_to_each_variant(spark):
    rows = [(1, "wiki", None, "a", None, 1), (1, "m", "f", "old", "why", 1), (1, "m", "f", "new", "why", 2), (1, "m", "f", None, None, 3), (1, "m", "x", "no", "why", 1), (2, "m", "o", "b", "N/A", 1), (2, "n", "o", None, "why", 1)]
    out = assembly.assembled(spark.createDataFrame(rows, CELL), ["item"], ["f", "o"], ["ts"], F.col("service") != "wiki")
    assert got(out, "item", "service", "variant", "term") == {(1, "wiki", "f", "a"), (1, "wiki", "o", "a"), (1, "m", "f", "new"), (2, "m", "o", None), (2, "n", "o", None)}
    assert assembly.assembled(spark.createDataFrame([], CELL), ["item"], ["f"], ["ts"], F.lit(True)).count() == 0


def test_wanted_skips_what_is_done_and_asks_once(spark):
    languages = spark.createDataFrame([("aa",), ("aa",), ("bb",)], "code string")
    done = spark.createDataFrame([("aa", "x"), (None, "y")], "code string, term_source string")
    assert got(assembly.wanted(languages, ["x", "y"], done, "code"), "code", "term_source") == {("aa", "y"), ("bb", "x"), ("bb", "y")}


DECISION = "code string, service string, original_term string, corrected_term string"


def test_decisions_by_hand_part_in_three(spark):
    rows = [("aa", "analysis_exclusion", None, None), (" ", "analysis_exclusion", None, None), (None, "analysis_exclusion", "t", None), ("bb", "search_exclusion", "t", None), ("bb", "search_exclusion", "t", None), ("cc", " term_correction ", "t", "u"), ("cc", "term_correction", "t", "v"), ("cc", "term_correction", "w", " "), ("dd", "service", "t", "u")]
    whole, search, better = assembly.by_hand(spark.createDataFrame(rows, DECISION), "code")
    assert got(whole, "code") == {("aa",)} and got(search, "code", "original_term") == {("bb", "t")} and got(better, "code", "original_term", "corrected_term") == {("cc", "t", "v")}


def test_drops_come_from_signals_and_by_hand(spark):
    found = spark.createDataFrame([(1, "bad", "A, B"), (1, "fine", "C"), (2, "bad", "")], "item long, signal string, services string")
    by_hand = spark.createDataFrame([(1, "D ", True), (1, "e", False), (1, "search_exclusion", True), (2, None, True), (3, "a", True), (3, "B", True)], "item long, service string, excluded boolean")
    dropped = assembly.drops(found, ["bad"], by_hand, ["item"])
    assert got(dropped, "item", "service") == {(1, "a"), (1, "b"), (1, "d"), (3, "a"), (3, "b")}
    cells = spark.createDataFrame([(1, "A", "x"), (1, "C", "y"), (1, None, "z"), (None, "a", "w")], "item long, service string, term string")
    assert got(assembly.without(cells, dropped, ["item"]), "term") == {("y",), ("z",), ("w",)}
    assert got(assembly.dropped_by_all(dropped, ["item"], ["a", "b"]), "item", "n_dropped", "whole") == {(1, 3, True), (3, 2, True)}
    assert got(assembly.dropped_by_all(dropped, ["item"], ["a", "c"]), "item", "whole") == {(1, False), (3, False)}


def test_a_run_corrects_drops_and_judges(spark):
    cells = [("aa", "m", "Haus", "a house"), ("aa", "n", "haus", "a house"), ("bb", "m", "casa", "one"), ("bb", "n", "hogar", "two"), ("bb", "o", "maison", "none"), ("cc", "m", "x", "y"), ("dd", "m", "wrong", "same"), ("dd", "n", "right", "same")]
    rows = spark.createDataFrame(cells, "code string, service string, term string, rationale string")
    decisions = spark.createDataFrame([("cc", "analysis_exclusion", None, None), ("dd", "term_correction", "wrong", "right")], DECISION)
    out = assembly.run(rows, "code", decisions, spark.createDataFrame([("bb", "N")], "code string, service string").withColumn("service", F.lower("service")), F.lit(True), ["the"], "anchor")
    assert got(out, "code", "n", "category", "n_rationales") == {("aa", 2, "COMPLETE_CONSENSUS", 2), ("bb", 1, "COMPLETE_CONSENSUS", 1), ("dd", 2, "COMPLETE_CONSENSUS", 2)}
    assert {r["code"]: r["similarity"] for r in out.collect()} == {"aa": 1.0, "bb": None, "dd": 1.0}


def test_retention_tells_words_from_what_holds_them(spark):
    rows = spark.createDataFrame([("m", "Digital Humanities"), ("m", "humanités digitales"), ("m", "digital lore"), ("m", "x"), ("m", None), ("n", " ")], "service string, term string")
    assert got(comparison.retention(rows, ["service"], "term", "digital humanities"), "service", "n", "exact", "inside", "by_word") == {("m", 4, 0.25, 0.5, 0.25)}


def test_correlations_within_groups_equal_those_of_ranks(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(rng.integers(0, 9)), float(rng.integers(0, 9))) for g in ("a", "b") for _ in range(60)] + [("a", None, 1.0)]
    out = {r["g"]: r for r in comparison.correlations(spark.createDataFrame(rows, "g string, u double, v double"), "u", "v", ["g"]).collect()}
    for g in ("a", "b"):
        x, y = (np.array([r[i] for r in rows if r[0] == g and r[1] is not None]) for i in (1, 2))
        rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() - 1) / 2 for a in v])
        assert out[g]["n"] == 60 and abs(out[g]["pearson"] - np.corrcoef(x, y)[0, 1]) < 1e-5 and abs(out[g]["spearman"] - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-5


def test_influence_shares_ranks(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 3, 0.0)], "a int, b int, rate double")
    assert got(comparison.influence(pairs), "service", "rank") == {(1, 1), (2, 2), (3, 2)}


def test_folds_are_dealt_evenly_and_alike_on_reruns(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(1000)] + [(7, "a")] * 3, "id long, label string")
    out = ordering.folds(rows, "id", "label", 5)
    sizes = {}
    for r in out.collect():
        sizes[r["label"], r["fold"]] = sizes.get((r["label"], r["fold"]), 0) + 1
    assert sum(sizes.values()) == 1003 and len(sizes) == 10
    assert all(max(v) - min(v) <= 1 for v in ([n for (label, _), n in sizes.items() if label == x] for x in ("a", None)))
    once, again = (sorted((r["id"], r["fold"]) for r in ordering.folds(rows.repartition(n), "id", "label", 5).collect()) for n in (1, 7))
    assert once == again and once != sorted((r["id"], r["fold"]) for r in ordering.folds(rows, "id", "label", 5, seed=1).collect())


def test_reindexed_has_each_value_once(spark):
    counts = spark.createDataFrame([("b", 2), ("z", 9)], "k string, n long")
    assert got(ordering.reindexed(counts, "k", ["a", "b"]), "place", "k", "n") == {(0, "a", 0), (1, "b", 2)}


def test_codes(spark):
    rows = spark.createDataFrame([("en",), ("e",), ("a b",), ("1a",), ("zz",), (None,), ("nan",)], "c string")
    assert [r[0] for r in rows.select(registry.valid_key(F.col("c"), ["zz"])).collect()] == ["valid", "form", "space", "form", "excluded", "blank", "blank"]
    cells = spark.createDataFrame([("ger (B)",), (" deu(T) ",), ("deu",), (None,), ("",)], "c string")
    assert [r[0] and tuple(r[0]) for r in cells.select(registry.code_cell(F.col("c"))).collect()] == [("B", "ger"), ("T", "deu"), None, None, None]
    keys = spark.createDataFrame([("uz",), ("uz-alt-secondary",), ("x-alt-y-alt-z",), ("",)], "c string")
    assert [tuple(r[0]) for r in keys.select(registry.split_alternative(F.col("c"))).collect()] == [("uz", None, True), ("uz", "secondary", False), ("x", "y-alt-z", True), ("", None, True)]


def test_search_terms_worth_a_look(spark):
    rows = spark.createDataFrame([("plan", 1), ("plan", 2), ("plän", 1), ("𐐀𐐁𐐂", 1), ("", 1), (None, 1)], "t string, n int")
    out = rows.select(X.is_suspicious(F.col("t"), F.col("n")), X.is_short_search(F.col("t"))).collect()
    assert [tuple(r) for r in out] == [(True, False), (False, False), (False, False), (False, True), (False, False), (False, False)]


def test_archives_and_globs(spark, tmp_path):
    for name, mode in (("a.tar", "w"), ("b.tar.gz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as archive:
            for member, data in (("d/x.json", b"{}"), ("d/y.txt", b"no")):
                info = tarfile.TarInfo(member)
                info.size = len(data)
                archive.addfile(info, io.BytesIO(data))
    out = files.read_archive(spark, f"{tmp_path}/*.tar*", ".json")
    assert sorted((r["archive"].rsplit("/", 1)[-1], r["member"], bytes(r["content"])) for r in out.collect()) == [("a.tar", "d/x.json", b"{}"), ("b.tar.gz", "d/x.json", b"{}")]
    (tmp_path / "one.csv").write_text("b,a\n1,2\n")
    (tmp_path / "two.csv").write_text("a\n3\n")
    assert got(files.read_glob(spark, f"{tmp_path}/*.csv", ["a", "b"]), "a", "b") == {("2", "1"), ("3", None)}
    assert files.read_glob(spark, f"{tmp_path}/*.none", ["a"]).collect() == []


def test_main_directions_and_clusters(spark):
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.normal(0, 0.1, (40, 6)), rng.normal(3, 0.1, (40, 6)) * [1, 1, 1, 0, 0, 0]])
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(at)] + [(99, None)], "id long, v array<double>")
    out = {r["id"]: r for r in projection.projected(rows, "v").collect()}
    centred = at - at.mean(0)
    first = np.linalg.svd(centred)[2][0]
    want = centred @ (first if first[abs(first).argmax()] > 0 else -first)
    assert len(out) == 80 and all(abs(out[i]["d1"] - w) < 1e-8 for i, w in enumerate(want))
    found = {r["id"]: r["cluster"] for r in projection.clustered(rows, "v", 2).collect()}
    assert len({found[i] for i in range(40)}) == 1 and len({found[i] for i in range(40, 80)}) == 1 and found[0] != found[79]


def test_stable_terms_are_those_that_tell_classes_apart(spark):
    rows = spark.createDataFrame([(i, ("apple orchard " if i % 2 else "engine piston ") + f"filler{i % 7}", str(i % 2)) for i in range(120)], "id long, t string, y string")
    out = got(genre.stable_terms(rows, "id", "t", "y", ["0", "1"], n=4, min_df=2), "class", "term")
    assert {("1", "apple"), ("1", "orchard"), ("0", "engine"), ("0", "piston")} <= out


def test_a_run_shuffles_no_ngrams(spark):
    rows = spark.createDataFrame([("aa", "m", "Haus", "a house"), ("aa", "n", "haus", "a house, too"), ("bb", "m", "casa", "one")], "code string, service string, term string, rationale string")
    out = assembly.run(rows, "code", spark.createDataFrame([], DECISION), spark.createDataFrame([], "code string, service string"), F.lit(True), ["the"], "anchor")
    assert got(out, "code", "n_rationales") == {("aa", 2), ("bb", 1)}
    assert "gram" not in out._jdf.queryExecution().optimizedPlan().toString()
