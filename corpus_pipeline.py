"""A corpus pipeline: quality, language, near copies, mixing, packing. Each stage's rows are written and read again.

Cases: a null text counts as empty, gets the score of an empty text in quality and goes in language, as texts without a letter do;
null ids and repeated rows are rows like others, of which near_copies keeps one of each group; a null source is a source of its
own in mix; an empty table passes through all stages and gives no sequence; other columns of any name stay until pack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyagree.llm import langid, mixing, packing, quality_fm, shared, simhash
from polyagree.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts."""
    model = quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_fm.accepted(docs, model)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language."""
    return langid.accepted(docs, langid.train(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles alike to 0.8 or more."""
    return simhash.keep_one(docs, shingle=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, with the digest of their ids."""
    return packing.pack_digests(docs, tokenizer_path(), end_id=0, capacity=1024)


STAGES = [("quality", quality), ("language", language), ("near_copies", near_copies), ("mix", mix), ("pack", pack)]

#: Trained models, a 64-bit hash and a tokenizer: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the table `documents`."""
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared.staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
