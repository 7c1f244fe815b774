"""What is computed for a row is computed once: plans of the text queries, and results that a second pass lost."""

import re

from pyspark.sql import functions as F

from polyagree.operators import disagreement, genre, ordering, results, review, search_terms

CELLS = [(1, 0, "a", "слово"), (1, 0, "b", "слова"), (1, 0, "c", "word"), (2, 0, "a", "λόγος"), (2, 0, "b", "..."), (None, 0, "a", "слово"), (3, 1, "a", "سخن"), (3, 1, "b", "word")]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scripts_are_found_once(spark):
    rows = spark.createDataFrame(CELLS, "item long, pos int, service string, term string")
    found = review.script_agreement(rows, ["item", "pos"], "service")
    got = {(r["item"], r.service): (r.script, r.majority, r.outlier) for r in found.collect()}
    assert got == {
        (1, "a"): ("Cyrillic", "Cyrillic", False), (1, "b"): ("Cyrillic", "Cyrillic", False), (1, "c"): ("Latin", "Cyrillic", True), (2, "a"): ("Greek", "Greek", False),
        (3, "a"): ("Arabic", "Arabic", False), (3, "b"): ("Latin", "Arabic", True),
    }
    sides = review.side_scripts(rows, ["item", "pos"], {"a": F.col("service") == "a", "b": F.col("service") != "a"})
    for df in (found, sides):
        plan = optimized(df)
        assert "Join" not in plan and not any("IsCyrillic" in line for line in plan.splitlines() if "Filter" in line)
        assert sum("IsCyrillic" in line for line in plan.splitlines()) == 1


def test_signals_are_found_once(spark):
    rows = spark.createDataFrame(CELLS, "item long, pos int, service string, term string").withColumn("rationale", F.col("term"))
    plan = optimized(review.signals(rows, ["item", "pos"], "service", review.term_signals(F.col("term"), F.col("rationale"), "of the")))
    assert sum("IsCyrillic" in line for line in plan.splitlines()) == 1


def test_flow_is_one_pass_and_keeps_nulls(spark):
    rows = spark.createDataFrame([(None, "a", "one", "why"), (None, "b", "another thing", "why"), ("en", "a", "one", "why")], "language string, service string, term string, rationale string")
    chain = disagreement.standard_chain()
    found = disagreement.flow(disagreement.features(rows, ["language"], ["the"], "z", english=F.lit(True)), chain, chain.without("sparse", "convergent"))
    assert sum(r.n for r in found.collect()) == 2 and "Join" not in optimized(found)


def test_alike_terms_count_as_many(spark):
    rows = spark.createDataFrame([("word", "en", "ltr", False), ("word", "en", "ltr", False), ("single", "en", "ltr", False), ("backed", "de", "rtl", True), ("nota: ", "de", "ltr", False), ("word", None, None, None)], "term string, language string, direction string, valid boolean")
    none = spark.createDataFrame([], "term string")
    got = {r.search_term: (r.natural_language, r.counts, r.directionality_conflict) for r in search_terms.build(rows, "the thing", none).collect()}
    assert got == {"word": ("en", 1, False), "backed": ("de", 1, False)}
    plan = optimized(search_terms.build(rows, "the thing", none)).splitlines()
    assert not any("Expand" in line for line in plan)


def test_groups_of_languages_are_not_shuffled_by_language(spark):
    found = spark.createDataFrame([("A", 1, "x"), ("A", 1, "y"), ("N", 1, "x"), ("A", 2, "y"), ("A", None, "x"), ("A", 3, "z")], "kind string, id long, search_term string")
    terms = spark.createDataFrame([("x", "en, de"), ("y", "de, fr"), ("z", "")], "search_term string, natural_language string")
    groups = spark.createDataFrame([("en", "G"), ("de", "G"), ("fr", "R"), ("it", None)], "language string, family string")
    out = results.reached(found, terms, groups, ["A", "N"], "en", ["de"])
    assert {r.family: tuple(r)[1:] for r in out.collect()} == {"G": (2, 1, 3, 1, "first"), "R": (2, 0, 2, 1, "first")}
    assert not re.search(r"hashpartitioning\(language#\d+, \d", out._jdf.queryExecution().executedPlan().toString())


def test_folds_are_weighted_from_one_count(spark, monkeypatch):
    rows = [(i, "ab"[i % 2], " ".join(["red apple", "blue pear", "green plum stone", "red plum"][j] for j in {i % 3, i % 4, (i // 2) % 4})) for i in range(1, 61)]
    dealt = ordering.folds(genre.terms(spark.createDataFrame(rows, "id int, kind string, why string"), "why"), "id", "kind", genre.FOLDS, seed=17, name="__fold").persist()
    sizes = [dealt.where(F.col("__fold") == k).count() for k in range(genre.FOLDS)]
    for k, got in enumerate(genre._vocabularies(dealt, sizes, 5)):
        seen = genre.Weights(dealt.where(F.col("__fold") != k), 5)
        assert got.keys() == set(seen.vocabulary) and all(abs(got[t] - x) < 1e-9 for t, x in zip(seen.vocabulary, seen.idf))
    whole, every = spark.createDataFrame(rows, "id int, kind string, why string"), genre.terms
    calls = []
    monkeypatch.setattr(genre, "terms", lambda *a: calls.append(a) or every(*a))
    monkeypatch.setattr(genre, "Weights", None)
    assert genre.out_of_fold(whole, "id", "why", "kind", ["a", "b"]).count() == 60 and len(calls) == 1


def test_mixes_of_scripts_are_found_once_and_by_one_pattern(spark, tmp_path):
    from polyagree.functions import text as X
    from polyagree.plans import reviewing

    texts = ["слово", "word", "слово ab", "σλόγος", "سخن، ۱۲", "漢字かな", "漢字 abcdef", "слово ԱԲԳ", "ꆈꌠ abc", "été слово", "a\u0301б", "", None, "слово\n", "\u0378бв", "ⅣБ", "한국 abc де"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    slow = X.script_mix(F.col("x"))
    found = rows.select(X.is_mixed(F.col("x")).alias("a"), X.has_any_mixing(F.col("x")).alias("b"), F.coalesce(slow["mixed"], F.lit(False)).alias("c"), F.coalesce(slow["any"], F.lit(False)).alias("d"))
    got = [tuple(r) for r in found.collect()]
    assert [r[:2] for r in got] == [r[2:] for r in got] and any(r[1] for r in got)
    spark.createDataFrame([(i, "en", "src0", "Was ist. Das e ist.") for i in range(24)], "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = optimized(reviewing.all_signals(spark, str(tmp_path)))
    assert plan.count("IsThaana") and sum("IsThaana" in line for line in plan.splitlines()) == 1
    assert sum("Aggregate" in line for line in plan.splitlines()) == 1 and "Expand" not in plan
    alone = optimized(rows.select(X.mix(F.col("x")).alias("m")))
    assert plan.count("IsThaana") <= alone.count("IsThaana")


def test_selected_terms_cross_few_shuffles(spark, tmp_path):
    from polyagree.plans import reviewing

    rows = [(i, "en" if i % 3 else "de", f"src{i % 4}", "The loan. A word of loan. the loan. " + "Alike here. " * (i % 5 == 0)) for i in range(1, 61)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = reviewing.search_terms_selected(spark, str(tmp_path))
    assert {r.search_term for r in found.collect()} >= {"the loan", "a word of loan"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) == 2  # with the categories, and with what is excluded


def test_folds_read_terms_in_small_batches(spark):
    import pyarrow as pa

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        genre.bound_batches(spark)
        rows = spark.range(0, 400, 1, 1).select(F.array_repeat(F.lit("x" * 50), 1000).alias("terms"))  # 20 MB
        sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())}) for b in batches), "n long").collect()
        assert len(sizes) > 3 and max(r.n for r in sizes) < 8 << 20
        spark.conf.set(name, "1000000")
        genre.bound_batches(spark)
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.set(name, before)
