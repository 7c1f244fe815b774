"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Subwords are the runs of SIZES bytes of a text's words, a white space on either side included. Each hashes to a row of an
embedding table; a text is the mean of its subwords' rows, and a linear softmax gives languages. Training runs on the
driver over a bounded sample of labelled rows, whose subwords executors have already counted. A temperature and a floor on
the confidence are fitted on a part of the sample that training has not seen. As a softmax is sure of some language whatever the
text, a text is also rejected whose subwords are much rarer in the sample, on average, than those of any text learnt. As the model is linear in the mean, scoring
multiplies table and softmax once and adds up a few numbers for each subword; whole texts are read, in blocks.

Cases: null text and text without a letter give `und` with score 0; texts with subwords of no learnt language have a score
below the floor and are rejected by `accepted`; an empty table, or no labelled row, gives `und` for all; repeated rows get
the same result; only the text is an input of a prediction, and `accepted` returns other columns whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SIZES, ROWS, WIDTH = (2, 3, 4), 1 << 14, 16
#: Labelled rows that training sees about, least hashes of their ids, and the part of them kept for calibration.
SAMPLE, HELD = 3000, 0.2
EPOCHS, RATE, BATCH = 12, 2.0, 16
#: How far below the least usual of the learnt texts, in parts of the way from there to the median, a text may be.
SLACK = 0.4
UNKNOWN = "und"
BLOCK = 1 << 19


def subwords(raw: np.ndarray, offsets: np.ndarray, upto: int | None = None):
    """(rows of the table, number of the text) of the subwords that begin before `upto`, a pair of arrays for each size."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    space = shared._SPACE[raw]
    low = np.where(space, np.uint8(32), shared.lowered(raw)).astype(np.uint32)
    for size in SIZES:
        m = min(len(low) - size + 1, len(low) if upto is None else upto)
        if m <= 0:
            continue
        code = np.zeros(m, np.uint32)
        for k in range(size):
            code |= low[k : k + m] << np.uint32(8 * k)
        fine = text[:m] == text[size - 1 : size - 1 + m]
        for k in range(1, size - 1):
            fine &= ~space[k : k + m]
        if size == 2:
            fine &= ~(space[:m] & space[1 : 1 + m])
        hashed = (code * np.uint32(2654435761) + np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(33 - ROWS.bit_length())
        yield hashed[fine].astype(np.int64), text[:m][fine]


def blocks(raw: np.ndarray, offsets: np.ndarray):
    """(first text, bytes, offsets, number of bytes where subwords may begin): runs of short texts, or pieces of a long one."""
    for first, last in shared.row_blocks(offsets, BLOCK):
        begin, end = int(offsets[first]), int(offsets[last])
        if end - begin <= BLOCK:
            yield first, raw[begin:end], offsets[first : last + 1] - begin, end - begin
        else:
            for at in range(begin, end, BLOCK):
                piece = raw[at : min(at + BLOCK + max(SIZES) - 1, end)]
                yield first, piece, np.array([0, len(piece)]), BLOCK


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # ROWS x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    floor: float
    usual: np.ndarray | None = None  # log of each row's share of the subwords learnt from
    least: float = -np.inf  # the mean of `usual` over a text's subwords below which the text is of none of the languages

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, one row for each text."""
        return self.judged(raw, offsets)[0]

    def judged(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities, one row for each text, and the mean of `usual` over its subwords."""
        n, k = len(offsets) - 1, len(self.languages)
        sums, counts, known = np.zeros((n, k)), np.zeros(n), np.zeros(n)
        for first, piece, at, upto in blocks(raw, offsets):
            for rows, text in subwords(piece, at, upto):
                if len(rows):
                    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                    to = first + text[starts]
                    counts[to] += np.diff(np.append(starts, len(text)))
                    for c in range(k):
                        sums[to, c] += np.add.reduceat(self.columns[c][rows], starts)
                    if self.usual is not None:
                        known[to] += np.add.reduceat(self.usual[rows], starts)
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), known / np.maximum(counts, 1)

    @property
    def columns(self) -> list[np.ndarray]:
        if not hasattr(self, "_columns"):
            self._columns = [np.ascontiguousarray(self.table[:, c], np.float32) for c in range(len(self.languages))]
        return self._columns


def _counted(batches):
    import pyarrow as pa

    for b in batches:
        raw, at = shared.buffer_of(b.column(0))
        found = []
        for i in range(len(at) - 1):
            counts = np.zeros(ROWS, np.int64)
            for _, piece, inner, upto in blocks(raw, at[i : i + 2]):
                for rows, _ in subwords(piece, inner, upto):
                    counts += np.bincount(rows, minlength=ROWS)
            at_ = np.flatnonzero(counts)
            found.append((at_.astype(np.int32), counts[at_].astype(np.float32)))
        yield pa.RecordBatch.from_arrays([pa.array([x[0].tobytes() for x in found], pa.binary()), pa.array([x[1].tobytes() for x in found], pa.binary()), b.column(1).cast(pa.string())], ["rows", "counts", "lang"])


def fit(examples: list, seed: int = 5) -> Model:
    """examples: (rows, counts, language) of each text."""
    languages = sorted({x[2] for x in examples})
    if not languages:
        return Model([UNKNOWN], np.zeros((ROWS, 1)), np.zeros(1), 1.0, 1.0)
    rng, k = np.random.default_rng(seed), len(languages)
    of = {x: i for i, x in enumerate(languages)}
    data = [(r, c / max(1.0, float(np.sum(c))), of[lang]) for r, c, lang in examples if len(r)]
    order = rng.permutation(len(data))
    held = [data[i] for i in order[: int(len(data) * HELD)]]
    learn = [data[i] for i in order[len(held) :]]
    emb = rng.normal(0, 0.3, (ROWS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, k), np.float32), np.zeros(k, np.float32)
    emb_sum, out_sum, bias_sum, steps = np.zeros_like(emb), np.zeros_like(out), np.zeros_like(bias), 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(learn), BATCH):
            picked = [learn[j] for j in rng.integers(0, len(learn), BATCH)]
            x = np.stack([c @ emb[r] for r, c, _ in picked])
            z = x @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(picked)), [y for _, _, y in picked]] -= 1
            p /= len(picked)
            back = p @ out.T
            out -= rate * (x.T @ p)
            bias -= rate * 0.1 * p.sum(axis=0)
            for (r, c, _), g in zip(picked, back):
                emb[r] -= rate * c[:, None] * g[None, :] * len(picked)
        if epoch >= EPOCHS // 2:  # the mean of the later epochs' weights
            emb_sum, out_sum, bias_sum, steps = emb_sum + emb, out_sum + out, bias_sum + bias, steps + 1
    emb, out, bias = emb_sum / steps, out_sum / steps, bias_sum / steps
    table = emb @ out
    logits = np.array([c @ table[r] + bias for r, c, _ in held or learn], np.float64).reshape(-1, k)
    truth = np.array([y for _, _, y in held or learn], np.int64)

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean()) if len(z) else 0.0

    temperature = min(np.geomspace(0.25, 8, 41), key=loss)
    z = logits / temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    floor = min(0.5, float(np.quantile(right, 0.002))) if len(right) else 0.5
    counts = np.zeros(ROWS)
    for r, c, _ in data:
        counts[r] += c
    usual = np.log((counts + 1e-3) / (counts.sum() + 1)).astype(np.float32)
    found = np.array([c @ usual[r] for r, c, _ in data])
    spread = float(np.median(found) - found.min()) if len(found) else 0.0
    least = float(found.min()) - SLACK * spread if len(found) else -np.inf
    return Model(languages, table, bias, float(temperature), floor, usual, least)


def train(docs: DataFrame, most: int = SAMPLE) -> Model:
    """From rows (doc_id, text, lang) with a text and a language."""
    shared.prepare(docs.sparkSession)
    rows = shared.hash_sample(docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"), most, seed=5)
    counted = rows.select(shared.text_bytes().alias("text"), "lang").mapInArrow(_counted, "rows binary, counts binary, lang string").toPandas()
    examples = sorted(counted.itertuples(index=False, name=None), key=lambda x: (x[2], len(x[0]), x[0], x[1]))
    return fit([(np.frombuffer(r, np.int32), np.frombuffer(c, np.float32), lang) for r, c, lang in examples])


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text[:64].decode("utf-8", "ignore")) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predicted(model: Model, text: Column) -> Column:
    """Struct of lang_pred, score and usual (the mean of model.usual) of a column of texts as bytes (no nulls)."""
    # the model goes with the function to each task: ROWS x languages numbers

    @F.arrow_udf("struct<lang_pred:string,score:double,usual:double>")
    def of(texts):
        import pyarrow as pa

        raw, at = shared.buffer_of(texts)
        p, usual = model.judged(raw, at)
        letters = np.array([_has_letter(raw[at[i] : at[i + 1]].tobytes()) for i in range(len(texts))], bool)
        names = np.array(model.languages, object)[p.argmax(axis=1)] if len(p) else np.zeros(0, object)
        names = [x if y else UNKNOWN for x, y in zip(names, letters)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(letters & (np.array(names, object) != UNKNOWN), p.max(axis=1) if len(p) else 0.0, 0.0).astype(np.float64)), pa.array(usual)], ["lang_pred", "score", "usual"])

    return of(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for each row."""
    shared.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), predicted(model, shared.text_bytes()).alias("p")).select("doc_id", "p.lang_pred", "p.score")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` whose language is known with the calibrated confidence, and whose subwords are as usual as learnt texts'; columns stay."""
    shared.prepare(docs.sparkSession)
    marked = docs.select(F.struct("*").alias("document"), predicted(model, shared.text_bytes()).alias("p"))
    return marked.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= model.floor) & (F.col("p.usual") >= model.least)).select("document.*")
