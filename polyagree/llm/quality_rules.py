"""Quality rules of documents, and the verdict on their hosts. DataFrame functions only.

Documents get counts and base rules of their own. Failures are summed by host; a host's rate is shrunk towards an empirical
beta prior, fitted by moments over all hosts, so that a host of few documents is not judged by them alone. A host whose
shrunk rate is above `worst` loses all its documents.

Words are runs of characters that are not one of the six ASCII spaces. `n_repeat_words`: words in five-word windows found
twice or more in the text. Windows are hashed first; only texts with two equal hashes compare the windows themselves.

Cases: null text has no words and fails; a null host is a host of its own; repeated rows count each; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Characters of markup and tables.
SYMBOLS = "[#*$%&|<>]"
#: The shrunk rate of failures above which a host fails.
WORST = 0.5


def let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, shared.SPACE_RUN), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that are found twice or more."""

    def of(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(w) - (window - 1))
        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(places, lambda i: F.xxhash64(*(F.get(h, i + (k - 1)) for k in range(window)))))
        found = F.array_sort(F.transform(places, lambda i: F.struct(F.array_join(F.slice(w, i, window), " ").alias("s"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, k: F.coalesce(x["s"] == F.get(s, k)["s"], F.lit(False))
            return F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))

        starts = F.array_sort(F.transform(let(found, twice), lambda x: x["i"]))
        covered = F.aggregate(starts, F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")), lambda a: a["n"])
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered).otherwise(0))

    return F.when(F.size(words) >= window + 1, let(words, of)).otherwise(0)


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long"), F.col(host).alias("host"), text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = split.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """alpha and beta by moments: the mean rate, and the spread of hosts' rates beyond what their sizes explain."""
    total = hosts.agg((F.sum("failed") / F.sum("n")).alias("m"), F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("q")).first()
    m = total.m
    if m is None or total.k < 2 or not 0 < m < 1:
        return (m or 0.0) * 2 + 1e-3, (1 - (m or 0.0)) * 2 + 1e-3
    between = (total.q - total.n * m * m - (total.k - 1) * m * (1 - m)) / (total.n - total.n2 / total.n)
    between = min(max(between, 1e-6 * m * (1 - m)), 0.99 * m * (1 - m))
    strength = m * (1 - m) / between - 1
    return m * strength, (1 - m) * strength


def judge(docs: DataFrame, host: str = "source", worst: float = WORST) -> DataFrame:
    """document_rules with host_rate (shrunk) and kept, for each row."""
    rules = shared.staged(document_rules(docs, host), "rules")
    hosts = rules.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    alpha, beta = beta_prior(hosts)
    rates = hosts.select(F.col("host").alias("host_"), ((F.col("failed") + alpha) / (F.col("n") + alpha + beta)).alias("host_rate"))
    joined = rules.join(rates, F.col("host").eqNullSafe(F.col("host_")), "left").drop("host_")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= worst))
