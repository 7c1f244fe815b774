"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_j x_j + 1/2 sum_f [(sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2]): all pairs of features interact
through rows of a low rank, in time linear in the features present. Features: hashed words by their share of the text,
statistics of the whole text (shares of capitals, symbols, digits, marks, repeated words and lines, word length), and its
length as metadata. Words and statistics are counted over the buffer of a whole Arrow batch, in blocks, without a Python
object for each word. Training runs on the driver, on a bounded sample of labelled rows whose features executors made.

Cases: null text counts as empty and has a score; a label that is null is no label; several labels of a document count
each; no labelled row gives the score 0.5 to all; repeated rows get equal scores; an empty table gives an empty result; only the
text is an input of a score, and `accepted` returns other columns whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

WORDS, STATS, RANK = 1 << 12, 14, 6
#: Labelled rows that training sees about, least hashes of their ids.
SAMPLE = 6000
EPOCHS, RATE, DECAY, DAMP = 14, 0.02, 1e-4, 20
THRESHOLD = 0.7
BLOCK = 1 << 19
FEATURES = WORDS + STATS

_KIND = np.zeros(256, np.int64)  # 1 capital, 2 small, 3 digit, 4 white space, 5 mark of a sentence, 6 symbol, 7 other ASCII, 8 beyond ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[list(shared.SPACES)] = 4
_KIND[list(b".,;:'-()\"")] = 5
_KIND[list(b"#*$%&|<>!?{}[]\\/^~=_@+")] = 6
_KIND[128:] = 8
_KIND[_KIND == 0] = 7


def features(raw: np.ndarray, offsets: np.ndarray):
    """Blocks of (first text, texts, (text, feature, value) arrays). A text is never parted."""
    for first, last in shared.row_blocks(offsets, BLOCK):
        at = offsets[first : last + 1] - offsets[first]
        part, n = raw[offsets[first] : offsets[last]], last - first
        low = shared.lowered(part)
        starts, ends, counts = shared.word_spans(low, at)
        text = np.repeat(np.arange(n), counts)
        hashes = shared.word_hashes(low, starts, ends)
        cell, times = np.unique(text * WORDS + (hashes & np.uint64(WORDS - 1)).astype(np.int64), return_counts=True)
        words = np.maximum(counts, 1)
        of = cell // WORDS
        value = np.sqrt(times / (words[of] + DAMP))  # near a unit vector; words of a short text tell less
        size = np.maximum(np.diff(at), 1)
        byte_text = np.repeat(np.arange(n), np.diff(at))
        kinds = np.bincount(byte_text * 9 + _KIND[part], minlength=9 * n).reshape(n, 9) if n else np.zeros((0, 9))
        distinct = _distinct(text, hashes, n)
        same = np.bincount(text[1:][(text[1:] == text[:-1]) & (hashes[1:] == hashes[:-1])], minlength=n)
        short = np.bincount(text[ends - starts <= 2], minlength=n)
        capital = np.bincount(text[_KIND[part[starts]] == 1], minlength=n) if len(starts) else np.zeros(n)
        letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
        lines = np.bincount(byte_text[part == 10], minlength=n) + 1
        stats = np.stack([
            np.ones(n), kinds[:, 1] / letters, 3 * kinds[:, 6] / size, kinds[:, 3] / size, kinds[:, 5] / size, kinds[:, 8] / size, kinds[:, 4] / size,
            1 - distinct / words, same / words, short / words, capital / words, np.log1p(size) / 10, np.log1p(counts / lines) / 5, np.minimum(size / words, 30) / 30,
        ], axis=1)
        rows = np.concatenate([of, np.repeat(np.arange(n), STATS)])
        cols = np.concatenate([cell % WORDS, np.tile(WORDS + np.arange(STATS), n)])
        yield first, n, (rows, cols, np.concatenate([value, stats.ravel()]))


def _distinct(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    if not len(text):
        return np.zeros(n)
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    return np.bincount(t[np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])])], minlength=n)


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray  # features x RANK

    def margin(self, n: int, rows: np.ndarray, cols: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = self.w0 + np.bincount(rows, self.w[cols] * x, minlength=n)
        for f in range(self.v.shape[1]):
            t = self.v[cols, f] * x
            out += 0.5 * (np.bincount(rows, t, minlength=n) ** 2 - np.bincount(rows, t * t, minlength=n))
        return out

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for first, n, (rows, cols, x) in features(raw, offsets):
            out[first : first + n] = self.margin(n, rows, cols, x)
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def fit(examples: list, seed: int = 10) -> Model:
    """examples: (features, values, label) of each text. Adam on the log loss, so scores are shares of label 1 among alike texts."""
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, RANK))
    if not examples:
        return Model(w0, w, v * 0)
    y = np.array([x[2] for x in examples], float)
    theta = np.concatenate([w[:, None], v], axis=1)
    m1, m2, step = np.zeros_like(theta), np.zeros_like(theta), 0
    data = [(a, b) for a, b, _ in examples]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        order = rng.permutation(len(data))
        for i in range(0, len(order), 64):
            some = order[i : i + 64]
            rows = np.repeat(np.arange(len(some)), [len(data[j][0]) for j in some])
            cols, x = np.concatenate([data[j][0] for j in some]), np.concatenate([data[j][1] for j in some])
            t = theta[cols, 1:] * x[:, None]
            sums = np.stack([np.bincount(rows, t[:, f], minlength=len(some)) for f in range(RANK)], axis=1)
            squares = np.bincount(rows, (t * t).sum(axis=1), minlength=len(some))
            z = w0 + np.bincount(rows, theta[cols, 0] * x, minlength=len(some)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[some]) / len(some)
            gx = g[rows] * x
            grad = np.concatenate([gx[:, None], gx[:, None] * (sums[rows] - t)], axis=1)
            found, to = np.unique(cols, return_inverse=True)
            total = np.stack([np.bincount(to, grad[:, c], minlength=len(found)) for c in range(RANK + 1)], axis=1) + DECAY * theta[found]
            step += 1
            m1[found] = 0.9 * m1[found] + 0.1 * total
            m2[found] = 0.99 * m2[found] + 0.01 * total**2
            theta[found] -= rate * m1[found] / (np.sqrt(m2[found]) + 1e-6)
            w0 -= rate * g.sum()
    return Model(w0, theta[:, 0].copy(), theta[:, 1:].copy())


def _featured(batches):
    import pyarrow as pa

    for b in batches:
        raw, at = shared.buffer_of(b.column(0))
        out: list = [(np.zeros(0), np.zeros(0))] * b.num_rows
        for first, n, (rows, cols, x) in features(raw, at):
            order = np.argsort(rows, kind="stable")
            edges = np.searchsorted(rows[order], np.arange(n + 1))
            for i in range(n):
                own = order[edges[i] : edges[i + 1]]
                out[first + i] = (cols[own], x[own])
        yield pa.RecordBatch.from_arrays([pa.array([a.astype(np.int32).tobytes() for a, _ in out], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in out], pa.binary()), b.column(1)], ["features", "values", "label"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Model:
    """From documents (doc_id, text) with labels (doc_id, and 0 or 1 in the column `label`).

    The sample is drawn from the labels, so what is broadcast is bounded by twice `most`.
    """
    shared.prepare(docs.sparkSession)
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
    chosen = shared.hash_sample(chosen, most, 10, "id")
    texts = docs.select("doc_id", shared.text_bytes().alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("text", "label")
    found = rows.mapInArrow(_featured, "features binary, values binary, label int").toPandas()
    examples = sorted(found.itertuples(index=False, name=None), key=lambda x: (x[2], len(x[0]), x[0], x[1]))
    return fit([(np.frombuffer(f, np.int32), np.frombuffer(v, np.float32), y) for f, v, y in examples])


def scored(model: Model, text: Column) -> Column:
    """Column of scores of a column of texts as bytes (no nulls)."""

    @F.arrow_udf("double")
    def of(texts):
        import pyarrow as pa

        return pa.array(model.scores(*shared.buffer_of(texts)))

    return of(text)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for each row."""
    shared.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), scored(model, shared.text_bytes()).alias("score"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score `threshold` or more; columns stay."""
    shared.prepare(docs.sparkSession)
    marked = docs.select(F.struct("*").alias("document"), scored(model, shared.text_bytes()).alias("score"))
    return marked.where(F.col("score") >= threshold).select("document.*")
