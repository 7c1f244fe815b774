"""Patterns that are tried only where one of their pieces stands, and where signals are computed."""

PHRASES = [
    "does not have a direct translation", "don't have any term", "without an equivalent", "lacks a word", "no direct word", "there is no exact term", "i'm not aware of", "I know of any", "are not widely used",
    "Often kept in English", "usually borrowed", "can't find a term", "is not typically translated", "transliterated", "spelled phonetically", "a stand-in for", "STANDS IN FOR", "stopgap", "filler word",
    "serves as a substitute", "placeholder", "note :", "untranslatable", "cannot be translated", "not applicable", "no equivalent", "fictional_term", "fictional translation", "isn't a direct translation",
    "ſtands in for", "uſed as is", "often Kept in english", "fİller word", "fıctıonal_term", "plain words", "", None,
]


def test_pieces_change_no_answer(spark):
    from pyspark.sql import functions as F

    from polyagree.functions import fixed as V
    from polyagree.functions import text as X

    rows = spark.createDataFrame([(i, p) for i, p in enumerate(PHRASES)], "i int, x string")
    for pattern in V.PIECES:
        plain = F.coalesce(F.col("x").rlike(X.any_of(pattern)), F.lit(False))
        assert rows.where(plain).count() and rows.where(X.says(F.col("x"), pattern) != plain).count() == 0


def test_signals_are_computed_before_they_are_made_rows(spark):
    from pyspark.sql import functions as F

    from polyagree.functions import text as X
    from polyagree.operators import review

    rows = spark.createDataFrame([(1, "a", "stands in for")], "item int, service string, term string")
    out = review.signals(rows, ["item"], "service", {"p": X.is_placeholder_rationale(F.col("term")), "r": X.is_refusal(F.col("term"))})
    assert [(r["signal"], r["services"]) for r in out.collect()] == [("p", "a")]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Generate" in line and "RLIKE" in line for line in plan) and any("Project" in line and "RLIKE" in line for line in plan)


def test_loops_at_the_bound(spark):
    from pyspark.sql import functions as F

    from polyagree.functions.text import is_repetition_loop

    texts = {"a a a a": True, "a a a b": False, "a a a a " + " ".join("bcdefghij"): True, "a a a a " + " ".join("bcdefghijk"): False, "a a a a a b b b b b b c d e f g h i": True, " ".join("abcdefgh" * 9): False}
    rows = spark.createDataFrame(list(texts), "string").select("value", is_repetition_loop(F.col("value")).alias("x")).collect()
    assert {r["value"]: r["x"] for r in rows} == texts
