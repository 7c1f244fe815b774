"""Masks of several presets at once, whose first layers are taken out once."""

TEXTS = [
    (1, "Claude, the judge, on digital humanities in English", "English", "en", "Claude"), (2, "  JUDGE  en de  German  humaniſt ", "German language", "de", "JUDGE"), (3, "dh minimal gemınİ dıgİtal", None, "en", ""), (4, "", "English", "en", "x"),
    (5, None, "English", "en", "x"), (6, "plain words stay", "Spanish", "e", None), (7, "lLama\tllama llamas Qwen digital humanity digital", "French", "fr", "lLama\tllama"), (8, "a\\Eb (c) a\\Eb", "a\\Eb", None, "a\\Eb"),
]


def test_presets_at_once_are_those_one_by_one(spark):
    from pyspark.sql import functions as F

    from polyagree.functions import masking

    rows = spark.createDataFrame(TEXTS, "i int, x string, name string, code string, term string")
    columns = [F.col(c) for c in ("name", "code", "term")]
    out = masking.masked_by(rows, F.col("x"), masking.PRESETS, *columns)
    assert out.columns == [*rows.columns, *(f"masked_{k}" for k in masking.PRESETS)]
    want = rows.select("i", *(masking.masked(F.col("x"), m, *columns).alias(f"masked_{k}") for k, m in masking.PRESETS.items()))
    assert sorted(out.select(want.columns).collect()) == sorted(want.collect())
    fixed = out.where("i = 3").first()
    assert fixed["masked_NAMES_ONLY"] == "dh dıgİtal" and fixed["masked_STANDARD"] == ""


def test_a_pattern_is_not_repeated_for_each_preset(spark, tmp_path):
    from polyagree.plans import measuring

    spark.createDataFrame([(1, "en", "a", "The judge. The judge. Digital text")], "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = measuring.masked_rationales(spark, str(tmp_path))
    assert {(r["preset"], r["n"], r["changed"], r["chars"]) for r in out.collect()} == {("NONE", 3, 0, 30), ("NAMES_ONLY", 3, 2, 18), ("STANDARD", 3, 3, 10), ("AGGRESSIVE", 3, 3, 4)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|judge)") <= 2  # in the two branches of what comes after it
