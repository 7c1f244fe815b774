"""Append-only logs as streams: windows, what is pending, and runs of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, late: str, width: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def sliding_counts(stream: DataFrame, time: str, late: str, width: str, slide: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide), *keys).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, time: str, late: str, gap: str, *keys: str) -> DataFrame:
    """Runs of events of a key with less than `gap` between them."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def pending(wanted: DataFrame, done: DataFrame | None, key: list[str]) -> DataFrame:
    """What is still to do: the wanted keys that the log `done`, if there is one, does not have."""
    return wanted if done is None else wanted.join(done.select(*key).distinct(), key, "left_anti")


def breaks(events: DataFrame, service: str, order: list[str], failed: Column, most: int = 3) -> DataFrame:
    """Runs of consecutive failures of a service that reach `most`: service, run length."""
    w = Window.partitionBy(service).orderBy(*order)
    runs = events.withColumn("failed", failed).withColumn("run", F.sum((~F.col("failed")).cast("int")).over(w)).where("failed")
    return runs.groupBy(service, "run").agg(F.count("*").alias("length")).where(F.col("length") >= most)


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
