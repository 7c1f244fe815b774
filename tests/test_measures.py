"""Curation, similarity, families and streams on small fixtures."""

import math
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from polyagree.functions import curation
from polyagree.operators import families, genre, similarity
from polyagree.streaming import logs


def test_curation(spark):
    cases = {
        None: (None, "unchanged"), "": ("", "unchanged"), "humanidades digitales": ("humanidades digitales", "unchanged"),
        "translation not available": (None, "placeholder"), "open seas = Velmora tikan": ("Velmora tikan", "stripped"), "/Oskar Thelu/": ("Oskar Thelu", "stripped"),
        "цифровые гуманитарные науки (tsifrovye)": ("цифровые гуманитарные науки", "stripped"), "цифровые науки / tsifrovye nauki": ("цифровые науки", "stripped"),
        "Humanities: цифровые гуманитарные науки": ("цифровые гуманитарные науки", "stripped"), "Digital Humanities цифровые гуманитарные": ("цифровые гуманитарные", "stripped"),
        "цифроdigitвыеhumanные": (None, "nulled"),
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, term string")
    got = {r.i: (r.term_curated, r.term_action) for r in curation.curated(rows, "term").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert not curation.curated(rows.limit(0), "term").count()


def vector(text):
    return Counter(p[i : i + n] for w in text.lower().split() for p in [f" {w} "] for n in (3, 4, 5) for i in range(len(p) - n + 1))


def test_similarity_is_the_mean_over_pairs(spark):
    groups = {1: ["a loan of words", "words on loan", "nothing alike"], 2: ["same words here", "same words here"], 3: ["alone"], 4: ["ab", "xyz", "", None, "nan"], 5: ["één über", "über één één"]}
    rows = spark.createDataFrame([(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)], "g int, i int, t string")
    got = {r.g: r for r in similarity.mean_similarity(rows, "g", ["i"], "t").collect()}
    for g, texts in groups.items():
        vectors = [vector(t) for t in texts if t and t != "nan"]
        n, df = len(vectors), Counter(k for v in vectors for k in v)
        unit = []
        for v in vectors:
            w = {k: c * (math.log((n + 1) / (df[k] + 1)) + 1) for k, c in v.items()}
            unit.append({k: x / math.sqrt(sum(y * y for y in w.values())) for k, x in w.items()})
        pairs = [sum(x * unit[j].get(k, 0) for k, x in unit[i].items()) for i in range(n) for j in range(i + 1, n)]
        assert got[g].n == n
        assert got[g].similarity is None if n < 2 else abs(got[g].similarity - sum(pairs) / len(pairs)) < 1e-4


def test_assignments_fill_blanks_and_add_rows(spark):
    old = spark.createDataFrame([("aa", "X", None), ("bb", " ", "n")], "code string, family string, note string")
    new = spark.createDataFrame([("aa", "Y", "m"), ("bb", "Z", "o"), ("cc", "W", None)], "code string, family string, note string")
    assert sorted(map(tuple, families.assigned(old, new, "code").collect())) == [("aa", "X", "m"), ("bb", "Z", "n"), ("cc", "W", None)]


def test_stream_windows_drop_what_is_late(spark, tmp_path):
    schema = "k string, at timestamp"
    for batch in ([("a", 1), ("a", 1), ("b", 1)], [("a", 9)], [("a", 1), ("a", 9)]):
        spark.createDataFrame([(k, datetime(2024, 1, day, 3)) for k, day in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = logs.windowed_counts(logs.read_log(spark, str(tmp_path / "log"), schema), "at", "1 hour", "1 day", "k")
        query = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    closed = spark.read.parquet(str(tmp_path / "out")).select("k", F.dayofmonth("window.start").alias("day"), "n")
    assert sorted(map(tuple, closed.collect())) == [("a", 1, 2), ("b", 1, 1)]


def test_genre(spark):
    kinds = {"loan": "borrowed foreign wording taken", "gloss": "literal rendering described meaning", "none": "missing absent nothing found"}
    rows = [(i, k, " ".join(kinds[k].split()[j] for j in {i % 4, (i // 3) % 4, (i // 5) % 4}) + " subject") for i in range(120) for k in [list(kinds)[i % 3]]]
    rows = spark.createDataFrame([*rows, (900, None, "borrowed"), (901, "loan", None)], "id int, kind string, why string")
    found = genre.out_of_fold(rows, "id", "why", "kind", list(kinds))
    got = found.collect()
    assert len(got) == 121 and sum(r.label == r.predicted for r in got) >= 115
    hits = {c: 2 * sum(r.label == r.predicted == c for r in got) / (sum(r.label == c for r in got) + sum(r.predicted == c for r in got)) for c in kinds}
    assert abs(genre.macro_f1(found).first().macro_f1 - sum(hits.values()) / 3) < 1e-9
    assert all(abs(sum(r.percent for r in genre.confusion(found).collect() if r.label == c) - 100) < 0.01 for c in kinds)
    weighted = genre.Weights(seen := genre.terms(rows.where("id < 120").withColumn("c", (F.col("id") % 3).cast("double")), "why"))
    model = genre.fit(weighted.transform(seen), "c")
    best = genre.top_terms(model, weighted, list(kinds), spark, n=3).collect()
    assert all(r.term.split()[0] in kinds[r["class"]] for r in best)
    masked = spark.createDataFrame([("The C++ (Loan) word loaned, LOAN  word",)], "t string").select(genre.masked(F.col("t"), ["loan", "loan word"])).first()[0]
    assert masked == "The C++ ( ) word loaned,"


def test_the_greatest_distance_is_that_of_all_pairs(spark):
    import random

    from pyspark.sql import functions as F

    from polyagree.operators.disagreement import greatest_distance

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(4)
    lists = [["".join(rng.choice("abя漢") for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(0, 9))] for _ in range(200)] + [None]
    out = spark.createDataFrame(list(enumerate(lists)), "id int, x array<string>").select("id", greatest_distance(F.col("x")).alias("d")).collect()
    want = {i: max((edits(a, b) for a in x for b in x), default=0) if x else 0 for i, x in enumerate(lists)}
    assert {r["id"]: r["d"] for r in out} == want


def test_the_script_of_plain_text_is_that_of_its_letters(spark):
    from pyspark.sql import functions as F

    from polyagree.functions import text as X

    rows = spark.createDataFrame([(x,) for x in ("plan", "élan ÿ", "12 ×÷!", "", None, "abc где", "aбв", "漢字", "a ", "ǅ2²")], "x string")
    assert [r[0] for r in rows.select(X.dominant_script(F.col("x"))).collect()] == ["Latin", "Latin", "Unknown", "Unknown", "Unknown", "Latin", "Cyrillic", "CJK", "Latin", "Latin"]
    slow = F.coalesce(X._main(X.script_entries(F.col("x"))), F.lit("Unknown"))
    assert rows.where(X.dominant_script(F.col("x")) != slow).count() == 0


def test_similarity_broadcasts_no_ngrams(spark):
    rows = spark.createDataFrame([(i % 3, i, f"word{i} and {i % 5} more") for i in range(60)], "g int, i int, t string")
    found = similarity.mean_similarity(rows, "g", ["i"], "t")
    assert len(found.collect()) == 3
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_ngrams_stay_in_the_task(spark, monkeypatch):
    words = ["loan", "über", "字", "word's", "of", "alike", "phrase", "𝔘x", "at"]
    texts = [(i % 4, i, " \t".join(words[(i * j + j) % 9] + str(j % 3) for j in range(1 + i % 11))) for i in range(120)] + [(9, 0, "alone"), (9, 0, "alone"), (8, 0, "ab"), (8, 1, "xyz")]
    rows = spark.createDataFrame(texts, "g int, i int, t string")
    found = similarity.mean_similarity(rows, "g", ["i"], "t")
    whole = {r.g: (r.n, r.similarity) for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "gram" not in plan
    assert whole[9] == (1, None) and whole[8] == (2, 0.0) and whole[0][0] == 30
    monkeypatch.setattr(similarity, "LIMIT", 200)  # blocks of a group or two, and groups in parts
    parted = similarity.mean_similarity(rows, "g", ["i"], "t")
    got = {r.g: (r.n, r.similarity) for r in parted.collect()}
    assert got.keys() == whole.keys()
    for g, (n, x) in whole.items():
        vectors = [vector(t) for t in sorted({(i, t) for k, i, t in texts if k == g}) for t in t[1:]]
        df, unit = Counter(k for v in vectors for k in v), []
        for v in vectors:
            w = {k: c * (math.log((len(vectors) + 1) / (df[k] + 1)) + 1) for k, c in v.items()}
            unit.append({k: y / math.sqrt(sum(z * z for z in w.values())) for k, y in w.items()})
        pairs = [sum(y * unit[j].get(k, 0) for k, y in unit[i].items()) for i in range(n) for j in range(i + 1, n)]
        assert got[g][0] == n == len(vectors)
        assert x is None and got[g][1] is None or abs(x - sum(pairs) / len(pairs)) < 1e-4 and abs(got[g][1] - x) < 1.5e-4
