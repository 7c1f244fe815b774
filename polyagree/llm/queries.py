"""The registered queries of this subpackage, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, hard_negatives, langid, licenses, lm, media, minhash, mixing, packing, quality_fm, quality_rules, shared, simhash, token_store


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    path = token_store.write(docs, shared.new_folder(spark, "tokens"), tokenizer_path(), end_id=2)
    return token_store.read_back(spark, path, width=2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(shared.documents(spark, sf_dir), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(shared.documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(shared.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    held_out = shared.crc_of_id(F.col("doc_id")) % 5 == 0
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    held_out = shared.crc_of_id(F.col("doc_id")) % 7 == 2
    model, counts = lm.train(docs.where(F.coalesce(~held_out, F.lit(True))))
    found = lm.score(docs, model, counts)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(shared.documents(spark, sf_dir))
    return media.store_tiles(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(shared.documents(spark, sf_dir)).drop("spans")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digests(shared.documents(spark, sf_dir), tokenizer_path(), end_id=0, capacity=1024)


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    held_out = shared.crc_of_id(F.col("doc_id")) % 4 == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_fm.train(docs, labels.where(~held_out))
    found = quality_fm.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_fm.THRESHOLD).cast("int").alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.prepare(spark)
    rows = hard_negatives.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "label", "embedding")
    return hard_negatives.mine(hard_negatives.relabelled(rows, every=7, labels=10))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(shared.documents(spark, sf_dir), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(shared.documents(spark, sf_dir), shingle=5)


QUERIES = {f.__name__: f for f in (op1_token_store, op2_simhash, op3_quality_rules, op4_mixing, op5_langid, op6_lm, op7_media, op8_licenses, op9_packing, op10_quality_fm, op11_hard_negatives, op12_alignment, op13_minhash)}

ORACLE_SQL = {
    "op3_quality_rules": r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT *, CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) ELSE [] END AS grams FROM w),
p AS (SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM g),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM p) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
c AS (SELECT g.doc_id, g.source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM g LEFT JOIN r ON g.doc_id = r.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS failed FROM f GROUP BY source),
m AS (SELECT sum(failed) / sum(n) AS m, count(*) AS k, sum(n) AS n, sum(n * n) AS n2, sum(failed * failed / n) AS q FROM h),
b AS (SELECT m, least(greatest((q - n * m * m - (k - 1) * m * (1 - m)) / (n - n2 / n), 1e-6 * m * (1 - m)), 0.99 * m * (1 - m)) AS v FROM m),
s AS (SELECT m, m * (1 - m) / v - 1 AS strength FROM b),
v AS (SELECT h.source, (failed + m * strength) / (n + strength) AS rate FROM h, s)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(v.rate, 0) <= 0.5 AS kept
FROM f LEFT JOIN v ON f.source IS NOT DISTINCT FROM v.source
""",
}
