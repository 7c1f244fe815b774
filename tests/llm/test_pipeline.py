"""The pipeline's stages against brute-force versions, on the smallest tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from polyagree.llm import mixing, quality_fm, shared

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "near_copies", "mix", "pack"]
    good = stages["quality"](spark, docs, DATA)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    model = quality_fm.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert kept == {r.doc_id for r in quality_fm.score(docs, model).collect() if r.score >= quality_fm.THRESHOLD}
    assert sum(labels[i] == 1 for i in labels if i in kept) >= 0.9 * sum(labels.values())
    known = stages["language"](spark, good, DATA)
    assert known.columns == docs.columns and known.count() >= 0.95 * good.count()
    rows = known.collect()
    sets = {r.doc_id: shingles(r.text or "") for r in rows}
    one = stages["near_copies"](spark, known, DATA)
    kept = {r.doc_id for r in one.collect()}
    alike = {i: [j for j in sets if i != j and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))] for i in sets}
    label = {i: i for i in sets}
    while (after := {i: min([label[i], *(label[j] for j in alike[i])]) for i in sets}) != label:
        label = after
    assert kept == {min(i for i in sets if label[i] == k) for k in set(label.values())}  # one of each group of texts alike to 0.8, and no other goes
    mixed = stages["mix"](spark, one, DATA)
    times = {r.doc_id: -(-r.taken // r["size"]) for r in mixing.mix(one).collect() if r["size"]}
    found = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert found == {i: n for i, n in times.items() if n}
    packed = stages["pack"](spark, mixed, DATA).collect()
    assert {r.doc_id for r in packed} == set(found) and max(r.offset + r.length for r in packed) <= 1024


def test_stages_on_nulls_repeats_and_nothing(spark):
    """Nulls in any column, empty texts, repeated rows and an empty table pass through all stages."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(60).unionByName(docs.limit(20)).withColumns({"lang": F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("lang")), "source": F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("source"))})
    more = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "src1", 0), (7, None, "en", None, None), (900001, " \n", None, "src1", 3)], docs.schema)
    for rows in (odd.unionByName(more), docs.limit(0)):
        n = rows.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, DATA)
            assert out.columns == docs.columns and (name == "mix" or out.count() <= rows.count())
            rows = shared.staged(out, f"test-{name}")
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, DATA).collect()
        assert bool(packed) == bool(n)
        assert sum(r.start + r.length == r.doc_tokens for r in packed) == rows.count()
