"""Maps of embeddings: two or more main directions, and clusters around means. Fitting and applying are Spark ML's, distributed over rows."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).withColumn("__v", array_to_vector(F.col(column).cast("array<double>")))


def projected(rows: DataFrame, column: str, k: int = 2) -> DataFrame:
    """`rows` that have a vector, with d1 to dk: places along the main directions about the mean of all. The greatest part of a direction is positive."""
    ready = _vectors(rows, column)
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(ready)
    directions = model.pc.toArray()
    signs = [1.0 if d[abs(d).argmax()] >= 0 else -1.0 for d in directions.T]
    places = vector_to_array("__p")
    out = model.transform(ready).withColumns({f"d{i + 1}": places[i] * s for i, s in enumerate(signs)}).drop("__v", "__p")
    means = out.agg(*(F.avg(f"d{i + 1}").alias(f"__m{i + 1}") for i in range(k)))  # one row
    out = out.crossJoin(F.broadcast(means))
    return out.withColumns({f"d{i + 1}": F.col(f"d{i + 1}") - F.col(f"__m{i + 1}") for i in range(k)}).drop(*(f"__m{i + 1}" for i in range(k)))


def clustered(rows: DataFrame, column: str, k: int, seed: int = 0) -> DataFrame:
    """`rows` that have a vector, with the number of their cluster."""
    ready = _vectors(rows, column)
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(ready)
    return model.transform(ready).drop("__v")
