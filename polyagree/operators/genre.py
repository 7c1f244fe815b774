"""Classifying rationales by their words: weighted one- and two-word terms, multinomial regression, folds, masking.

Counting, document frequencies and fitting are distributed over rows; the vocabulary and the coefficients, at most
`TERMS` of each class, are on the driver. Out of fold, terms are counted once by fold, and what a fold's model has not seen is taken off. Folds are dealt in turn within each class, in the order of a hash of the id, without a class in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import log

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyagree.operators import ordering
from polyagree.sources.files import stored

TERMS = 15_000
FOLDS = 5


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold 4 MB instead of 64, as a text's terms take several times its length and a task's arrays several times its batch; a session's own setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "67108864b"):
        spark.conf.set(name, str(4 << 20))


def masked(x: Column, terms: Sequence[str]) -> Column:
    """`x` without these words and phrases, in any case and with any space between their words, and with single spaces; longer phrases go first."""
    if not terms:
        return x
    word = lambda w: "\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    quoted = "|".join("\\s+".join(map(word, t.split())) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.trim(F.regexp_replace(F.regexp_replace(x, f"(?iu)(?<!\\w)(?:{quoted})(?!\\w)", " "), "\\s+", " "))


def terms(rows: DataFrame, text: str) -> DataFrame:
    """`rows` with `terms`: words of two letters or more but stop words, and pairs of neighbours among them; null has none."""
    rows = rows.withColumn("__text", F.coalesce(text, F.lit("")))
    rows = RegexTokenizer(inputCol="__text", outputCol="__all", gaps=False, pattern="(?U)\\b\\w\\w+\\b").transform(rows)
    rows = StopWordsRemover(inputCol="__all", outputCol="__words").transform(rows)
    rows = NGram(n=2, inputCol="__words", outputCol="__pairs").transform(rows)
    return rows.withColumn("terms", F.concat("__words", "__pairs")).drop("__text", "__all", "__words", "__pairs")


class Weights:
    """Fitted on rows with `terms`: (1 + ln count) times (1 + ln((n + 1) / (df + 1))), with length 1."""

    def __init__(self, rows: DataFrame, min_df: float = 5, max_df: float = 0.7):
        self.counts = CountVectorizer(inputCol="terms", outputCol="__counts", minDF=min_df, maxDF=max_df, vocabSize=TERMS).fit(rows)
        self.idf = IDF(inputCol="__counts", outputCol="__idf").fit(self.counts.transform(rows)).idf.toArray() + 1

    @property
    def vocabulary(self) -> list[str]:
        return self.counts.vocabulary

    def transform(self, rows: DataFrame) -> DataFrame:
        idf = self.idf

        def of(vectors):
            import numpy as np

            values = []
            for places, counts in zip(vectors["indices"], vectors["values"]):
                w = (1 + np.log(counts)) * idf[places]
                values.append(w / (np.sqrt((w * w).sum()) or 1.0))
            return vectors.assign(type=0, values=values)

        of.__annotations__ = {"vectors": pd.DataFrame, "return": pd.DataFrame}
        weighted = F.pandas_udf(of, VectorUDT())  # Spark has no logarithm of sparse counts
        return self.counts.transform(rows).withColumn("features", weighted(F.unwrap_udt("__counts"))).drop("__counts")


def fit(rows: DataFrame, label: str, c: float = 1.0, rounds: int = 60, n: int | None = None) -> LogisticRegressionModel:
    """Multinomial regression of rows with `features` and a class number; the penalty is that of inverse strength `c` over the sum of losses. `n`: how many rows there are, if known."""
    strength = 1 / (c * max(1, rows.count() if n is None else n))
    return LogisticRegression(family="multinomial", labelCol=label, regParam=strength, standardization=False, maxIter=rounds).fit(rows)


def _numbered(rows: DataFrame, key: str, text: str, label: str, classes: Sequence[str]) -> DataFrame:
    """(key, label, __class, __source) of the rows whose label is among `classes`."""
    names = F.array(*(F.lit(c) for c in classes))
    number = (F.array_position(names, F.col(label).cast("string")) - 1).cast("double")
    return rows.select(key, F.col(label).cast("string").alias("label"), number.alias("__class"), F.col(text).alias("__source")).where(F.col("__class") >= 0)


def _counts_by_fold(rows: DataFrame) -> DataFrame:
    """(term, n, df): how often a term of the rows' `terms` comes, and in how many rows, as arrays by `__fold`. A batch of rows is added up in Arrow, batches by Spark."""

    def of(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            terms = batch.column(1)
            words = terms.flatten().dictionary_encode()
            size = len(words.dictionary)
            if not size:
                continue
            pairs, counts = np.unique(np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy())) * size + words.indices.to_numpy(), return_counts=True)
            cells, where = np.unique(batch.column(0).to_numpy()[pairs // size].astype(np.int64) * size + pairs % size, return_inverse=True)
            n, df = np.bincount(where, weights=counts).astype(np.int64), np.bincount(where)
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(cells % size)), pa.array((cells // size).astype(np.int32)), pa.array(n), pa.array(df.astype(np.int64))], ["term", "fold", "n", "df"])

    found = rows.select("__fold", "terms").mapInArrow(of, "term string, fold int, n long, df long")
    by_fold = lambda x: F.array(*(F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(x))), F.lit(0)) for k in range(FOLDS))).alias(x)
    return found.groupBy("term").agg(by_fold("n"), by_fold("df"))


def _vocabularies(rows: DataFrame, sizes: Sequence[int], min_df: float, max_df: float = 0.7) -> list[dict[str, float]]:
    """For each fold, the weights by rarity, as in Weights, of the terms of the other folds; `sizes`: rows by fold. Of equally frequent terms the least goes first."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    counts = stored(_counts_by_fold(rows).where(total("df") >= min_df), "terms")
    out = []
    for k in range(FOLDS):
        n = sum(sizes) - sizes[k]
        seen = counts.select("term", (total("n") - F.col("n")[k]).alias("n"), (total("df") - F.col("df")[k]).alias("df"))
        kept = seen.where(F.col("df").between(min_df if min_df >= 1 else min_df * n, max_df * n)).where("df > 0")
        out.append({r.term: log((n + 1) / (r.df + 1)) + 1 for r in kept.orderBy(F.desc("n"), "term").limit(TERMS).collect()})
    return out


def _placed(rows: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """`rows` with places in the vocabulary and counts of those of their terms that are in it, in place of the terms."""
    others = [c for c in rows.columns if c != "terms"]

    def of(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known, size = pa.array(vocabulary, pa.string()), max(1, len(vocabulary))
        for batch in batches:
            terms = batch.column("terms")
            place = pc.fill_null(pc.index_in(terms.flatten().cast(pa.string()), value_set=known), -1).to_numpy()
            row = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
            pairs, counts = np.unique((row * size + place)[place >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(len(terms) + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pairs % size, counts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *lists], [*others, "places", "counts"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "terms")
    return rows.select(*others, "terms").mapInArrow(of, f"{schema}, places array<int>, counts array<int>")


def _weighted(rows: DataFrame, rarity: Sequence[float]) -> DataFrame:
    """`rows` with `features`, as Weights makes them, of places and counts; `rarity` is zero for what is not in the fold's vocabulary."""

    def of(places, counts):
        import numpy as np

        idf, indices, values = np.asarray(rarity), [], []
        for p, c in zip(places, counts):
            w = (1 + np.log(c)) * idf[p]
            indices.append(p[w > 0])
            values.append(w[w > 0] / (np.sqrt((w * w).sum()) or 1.0))
        return pd.DataFrame({"type": np.zeros(len(values), np.int8), "size": np.full(len(values), len(idf), np.int32), "indices": indices, "values": values})

    of.__annotations__ = {"places": pd.Series, "counts": pd.Series, "return": pd.DataFrame}
    return rows.withColumn("features", F.pandas_udf(of, VectorUDT())("places", "counts")).drop("places", "counts")


def _fitted(seen: DataFrame, min_df: float) -> tuple[Weights, LogisticRegressionModel]:
    weights = Weights(seen, min_df)
    ready = weights.transform(seen).persist()
    model = fit(ready, "__class")
    ready.unpersist()
    return weights, model


def out_of_fold(rows: DataFrame, key: str, text: str, label: str, classes: Sequence[str], min_df: float = 5) -> DataFrame:
    """(key, label, predicted) of each row whose label is among `classes`, predicted by a model that has not seen its fold."""
    bound_batches(rows.sparkSession)
    names = F.array(*(F.lit(c) for c in classes))
    rows = stored(ordering.folds(_numbered(rows, key, text, label, classes), key, "label", FOLDS, seed=17, name="__fold"), "folds")
    sizes = {r["__fold"]: r["count"] for r in rows.groupBy("__fold").count().collect()}
    whole = terms(rows, "__source").drop("__source")
    rarity = _vocabularies(whole, [sizes.get(k, 0) for k in range(FOLDS)], min_df)
    vocabulary = sorted(set().union(*rarity)) or [""]
    placed = stored(_placed(whole, vocabulary), "places")
    parts = []
    for k in range(FOLDS):
        ready = _weighted(placed, [rarity[k].get(t, 0.0) for t in vocabulary])
        model = fit(ready.where(F.col("__fold") != k), "__class", n=sum(sizes.values()) - sizes.get(k, 0))
        parts.append(model.transform(ready.where(F.col("__fold") == k)).select(key, "label", names[F.col("prediction").cast("int")].alias("predicted")))
    return reduce(DataFrame.unionByName, parts)


def stable_terms(rows: DataFrame, key: str, text: str, label: str, classes: Sequence[str], seeds: int = 5, least: int = 4, n: int = 20, min_df: float = 5) -> DataFrame:
    """(class, term, seeds): terms that are among a class's `n` greatest coefficients in `least` of `seeds` fits or more; each fit leaves out a fold dealt by its seed."""
    whole = terms(_numbered(rows, key, text, label, classes), "__source").drop("__source")
    found = []
    for seed in range(seeds):
        weights, model = _fitted(ordering.folds(whole, key, "label", FOLDS, seed, "__fold").where("__fold > 0"), min_df)
        found.append(top_terms(model, weights, classes, rows.sparkSession, n).where("coefficient > 0"))
    return reduce(DataFrame.unionByName, found).groupBy("class", "term").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least)


def confusion(predictions: DataFrame) -> DataFrame:
    """(label, predicted, n, percent of the label)."""
    counts = predictions.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("label")), 4))


def macro_f1(predictions: DataFrame) -> DataFrame:
    """One row, macro_f1: the mean over labels of 2 hits / (rows of the label + rows predicted as it)."""
    both = predictions.select(F.explode(F.array(F.struct(F.col("label").alias("c"), (F.col("label") == F.col("predicted")).alias("hit")), F.struct(F.col("predicted").alias("c"), F.lit(False).alias("hit")))).alias("x"))
    each = both.groupBy("x.c").agg((2 * F.count_if("x.hit") / F.count("*")).alias("f1"))
    return each.agg(F.avg("f1").alias("macro_f1"))


def top_terms(model: LogisticRegressionModel, weights: Weights, classes: Sequence[str], spark, n: int = 20) -> DataFrame:
    """(class, rank, term, coefficient): the n greatest coefficients of each class."""
    table = model.coefficientMatrix.toArray()
    rows = []
    for c, row in zip(classes, table):
        best = sorted(range(len(row)), key=lambda i: (-row[i], weights.vocabulary[i]))[:n]
        rows += [(c, rank, weights.vocabulary[i], float(row[i])) for rank, i in enumerate(best, 1)]
    return spark.createDataFrame(rows, "class string, rank int, term string, coefficient double")


def ablation(rows: DataFrame, key: str, text: str, label: str, classes: Sequence[str], presets: Mapping[str, Sequence[str]], min_df: float = 5) -> DataFrame:
    """(preset, macro_f1) with the words of each preset masked."""
    runs = [macro_f1(out_of_fold(rows.withColumn(text, masked(F.col(text), words)), key, text, label, classes, min_df)).select(F.lit(name).alias("preset"), "macro_f1") for name, words in presets.items()]
    return reduce(DataFrame.unionByName, runs)


def probabilities(model: LogisticRegressionModel, rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    """`rows` with a column p_<class> for each class."""
    p = vector_to_array("probability")
    return model.transform(rows).withColumns({f"p_{c}": p[k] for k, c in enumerate(classes)}).drop("rawPrediction", "probability", "prediction")
