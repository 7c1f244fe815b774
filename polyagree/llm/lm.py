"""LM scoring: a gated recurrent language model with a class-factored output, trained by truncated backpropagation in numpy.

Words are counted over the whole training part in one shuffle by a 64-bit hash of the word. The TOP most frequent, a bounded
table, go to all tasks; the counts of all other words stay distributed, and meet the words of the texts in a join.

P(word | before) = P(class | state) P(word | class, state). The DYNAMIC most frequent words lie in classes with a softmax
over the state; further words of the table lie in bands of frequency, and all others, known or not, in one last class, with
the shares of their counts (one added, and one unseen word more). The end of a text is a class of its own. So the
probabilities of all words sum to one. States start at zero with each text and go on from window to window until its end;
training is cut after WINDOW steps, scoring never.

Training starts on the driver, over a bounded sample of training texts that gives all tasks the same start. Each partition
then trains a copy of it in one pass over all its training texts, and the copies are averaged by their words. So the
network has seen every training text, as the counts have; its weights depend on how texts lie in partitions. Cases: null text counts as
empty and has only its end; without a training text all counts are zero; repeated rows are scored each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

TOP, DYNAMIC, IN_CLASS, BANDS = 1 << 17, 1024, 32, 14
HIDDEN, INPUTS, STREAMS, WINDOW = 16, 2048, 64, 32
#: Texts that the network starts with, about, those of the least hashes of their ids; passes over them; and the words after which no text is added.
SAMPLE, EPOCHS, RATE, SAMPLE_WORDS = 1500, 3, 0.01, 1_200_000
#: In the pass over all texts: lanes of a stream, its words, the first rate, and weights in a row of those that are averaged.
LANES, STREAM_WORDS, PASS_RATE, BLOCK = 512, 1 << 20, 0.006, 2048
#: Words of the texts that are scored together.
POOL_WORDS, POOL_ROWS = 4_000_000, 8192


def hashed_words(raw: np.ndarray, at: np.ndarray):
    """Hashes of all words of the texts and the number of words of each, a block at a time."""
    hashes, counts = [], []
    for first, last in shared.row_blocks(at, 1 << 20):
        low = shared.lowered(raw[at[first] : at[last]])
        starts, ends, n = shared.word_spans(low, at[first : last + 1] - at[first])
        hashes.append(shared.word_hashes(low, starts, ends))
        counts.append(n)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), (np.concatenate(counts) if counts else np.zeros(0, np.int64))


def _count(batches):
    import pyarrow as pa

    for b in batches:
        words, _ = hashed_words(*shared.buffer_of(b.column(0)))
        found, times = np.unique(words, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], ["word", "c"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts (a column of bytes)."""
    return texts.mapInArrow(_count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Table:
    """The most frequent words, by falling count; `order` sorts their hashes."""

    hashes: np.ndarray
    counts: np.ndarray
    texts: int  # training texts, and so ends
    tokens: int
    distinct: int

    def __post_init__(self):
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]
        n = len(self.hashes)
        rank = np.arange(n)
        band = np.minimum(np.log2(np.maximum(rank, 1) / DYNAMIC).clip(0) * 2, BANDS - 1).astype(np.int64)
        self.dynamic_classes = -(-min(n, DYNAMIC) // IN_CLASS)
        self.classes = DYNAMIC // IN_CLASS + BANDS + 2
        self.tail, self.end = self.classes - 2, self.classes - 1
        self.of = np.append(np.where(rank < DYNAMIC, rank // IN_CLASS, DYNAMIC // IN_CLASS + band), [self.tail, self.end])  # by id: words, tail, end
        sums = np.bincount(self.of[:n], self.counts, minlength=self.classes)
        self.inside = np.append(np.where(rank < DYNAMIC, 0.0, np.log(np.maximum(self.counts, 1) / np.maximum(sums[self.of[:n]], 1))), [0.0, 0.0])
        self.input = np.append(np.where(rank < INPUTS, rank, INPUTS + self.of[:n]), [INPUTS + self.tail, INPUTS + self.end])

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Places in the table; its length for all others."""
        if not len(self.sorted):
            return np.zeros(len(words), np.int32)
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.order[at], len(self.sorted)).astype(np.int32)


def _sigmoid(x):
    x = np.tanh(0.5 * x)
    x *= 0.5
    x += 0.5
    return x


def _softmax(h: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and their sums, one row a state. Biases are at most zero and states within one, so nothing overflows below 60."""
    z = h @ w
    z += b
    np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


class Network:
    """Gated recurrent units: one row of gate inputs for each input word, and weights to classes and to words in classes."""

    def __init__(self, table: Table, seed: int = 6):
        rng = np.random.default_rng(seed)
        f = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        c = table.classes
        seen = np.bincount(table.of[: len(table.counts)], table.counts, minlength=c).astype(np.float64)
        seen[table.tail] = max(1, table.tokens - table.texts - seen.sum())
        seen[table.end] = max(1, table.texts)
        words = np.zeros(DYNAMIC)
        words[: min(DYNAMIC, len(table.counts))] = table.counts[:DYNAMIC]
        self.p = {
            "x": f(INPUTS + c, 3 * HIDDEN), "u": f(HIDDEN, 3 * HIDDEN), "wc": f(HIDDEN, c), "bc": np.log((seen + 0.01) / (seen.max() + 0.01)).astype(np.float32),
            "wd": f(DYNAMIC // IN_CLASS, HIDDEN, IN_CLASS), "bd": np.where(words > 0, np.log((words + 0.01) / (words.max() + 0.01)), -30).reshape(-1, IN_CLASS).astype(np.float32),
        }

    def step(self, h: np.ndarray, rows: np.ndarray):
        g, a = self.p["x"][rows], h @ self.p["u"]
        zr = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        return n + z * (h - n), (z, r, n, a[:, 2 * HIDDEN :])

    def loss(self, table: Table, h: np.ndarray, ids: np.ndarray, back: dict | None = None):
        """Natural log probabilities of words (the class alone for static ones, plus their share) after states; with `back`, also what flows back."""
        c, every = table.of[ids], np.arange(len(ids))
        e, total = _softmax(h, self.p["wc"], self.p["bc"])
        out = np.log(e[every, c] / total).astype(np.float64) + table.inside[ids]
        if back is not None:
            e /= total[:, None]
            e[every, c] -= 1
            back["wc"] += h.T @ e
            back["bc"] += np.ones(len(e), e.dtype) @ e
            flow = e @ self.p["wc"].T
        some = np.flatnonzero(ids < min(DYNAMIC, len(table.hashes)))
        kind = c[some].astype(np.int16)
        some = some[np.argsort(kind, kind="stable")]
        edges = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=DYNAMIC // IN_CLASS))])
        for k in range(DYNAMIC // IN_CLASS):
            own = some[edges[k] : edges[k + 1]]
            if len(own):
                hk, word, each = h[own], ids[own] % IN_CLASS, np.arange(len(own))
                e, total = _softmax(hk, self.p["wd"][k], self.p["bd"][k])
                out[own] += np.log(e[each, word] / total)
                if back is not None:
                    e /= total[:, None]
                    e[each, word] -= 1
                    back["wd"][k] += hk.T @ e
                    back["bd"][k] += np.ones(len(e), e.dtype) @ e
                    flow[own] += e @ self.p["wd"][k].T
        return out if back is None else (out, flow)

    def score(self, table: Table, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log probability of each text: `ids` without ends, end to end; the end is added. States last for the whole text."""
        end = len(table.hashes) + 1
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        order = np.argsort(-lengths, kind="stable")
        starts, sizes = starts[order], lengths[order] + 1
        out, h = np.zeros(len(lengths)), np.zeros((len(lengths), HIDDEN), np.float32)
        padded = np.append(ids, end)
        falling = -sizes
        for begin in range(0, int(sizes.max(initial=0)), WINDOW):
            live = int(np.searchsorted(falling, -begin, side="left"))
            steps = min(WINDOW, int(sizes[0]) - begin)
            at = starts[:live, None] + begin + np.arange(steps)
            place = begin + np.arange(steps)
            block = padded[np.minimum(at, len(ids))]
            block[place[None, :] == (sizes[:live] - 1)[:, None]] = end
            states, words, rows_of = [], [], []
            h = h[:live].copy()
            for t in range(steps):
                n = int(np.searchsorted(falling[:live], -(begin + t), side="left"))
                states.append(h[:n].copy())
                words.append(block[:n, t])
                rows_of.append(np.arange(n))
                h[:n] = self.step(h[:n], table.input[block[:n, t]])[0]
            states, words, rows_of = np.concatenate(states), np.concatenate(words), np.concatenate(rows_of)
            for i in range(0, len(words), 1 << 15):
                got = self.loss(table, states[i : i + (1 << 15)], words[i : i + (1 << 15)])
                out[:live] += np.bincount(rows_of[i : i + (1 << 15)], got, minlength=live)
        back = np.empty_like(out)
        back[order] = out
        return back


class Learner:
    """Truncated backpropagation with Adam over one stream after another, each dealt into lanes; `planned` updates bring the rate to a tenth."""

    def __init__(self, network: Network, table: Table, lanes: int, rate: float, planned: float):
        self.network, self.table, self.lanes, self.rate, self.planned, self.count = network, table, lanes, rate, max(1, planned), 0
        self.m1, self.m2 = ({k: np.zeros_like(v) for k, v in network.p.items()} for _ in range(2))

    def learn(self, stream: np.ndarray) -> np.ndarray:
        """One pass over `stream`, ids with an end after each text. Returns what is left at its end, fewer ids than lanes."""
        many = min(self.lanes, max(1, len(stream) // WINDOW))
        length = len(stream) // many
        lanes, h = stream[: length * many].reshape(many, length).T, np.zeros((many, HIDDEN), np.float32)
        for begin in range(0, length, WINDOW):
            h = self._update(lanes[begin : begin + WINDOW], h)
        return stream[length * many :]

    def _update(self, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        network, table = self.network, self.table
        kept, states, on = [], [], (table.of[ids] != table.end)[:, :, None]
        inputs = table.input[ids]
        for t in range(len(ids)):
            states.append(h)
            after, parts = network.step(h, inputs[t])
            kept.append(parts)
            h = after * on[t]
        back = {k: np.zeros_like(v) for k, v in network.p.items()}
        _, flow = network.loss(table, np.concatenate(states), ids.ravel(), back)
        flow = flow.reshape(*ids.shape, HIDDEN)
        dh, grads = np.zeros_like(h), np.empty((*ids.shape, 3 * HIDDEN), np.float32)
        inner, turned = np.empty((len(h), 3 * HIDDEN), np.float32), np.ascontiguousarray(network.p["u"].T)
        for t in range(len(ids) - 1, -1, -1):
            dh *= on[t]
            before, (z, r, n, a) = states[t], kept[t]
            rest = 1 - z
            dn = dh * rest
            dn *= 1 - n * n
            inner[:, :HIDDEN] = dh * (before - n) * z * rest
            inner[:, HIDDEN : 2 * HIDDEN] = dn * a * r * (1 - r)
            inner[:, 2 * HIDDEN :] = dn * r
            grads[t, :, : 2 * HIDDEN], grads[t, :, 2 * HIDDEN :] = inner[:, : 2 * HIDDEN], dn
            back["u"] += before.T @ inner
            dh = dh * z + inner @ turned + flow[t]
        rows, grads = inputs.ravel(), grads.reshape(-1, 3 * HIDDEN)
        order = np.argsort(rows, kind="stable")
        starts = np.flatnonzero(np.diff(rows[order], prepend=-1))
        back["x"][rows[order[starts]]] = np.add.reduceat(grads[order], starts, axis=0)
        self.count += 1
        rate = self.rate * max(0.1, 1 - 0.9 * self.count / self.planned)
        for k, g in back.items():
            g /= self.lanes * WINDOW
            m1, m2 = self.m1[k], self.m2[k]
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            network.p[k] -= (rate / (1 - 0.9**self.count) * m1 / (np.sqrt(m2 / (1 - 0.99**self.count)) + 1e-7)).astype(np.float32)
        return h


@dataclass
class Model:
    table: Table
    network: Network
    seen: int = 0  # words and ends of the pass over all texts


def _hashes(batches):
    import pyarrow as pa

    for b in batches:
        words, n = hashed_words(*shared.buffer_of(b.column(1)))
        texts = [x.tobytes() for x in np.split(words, np.cumsum(n)[:-1])] if len(n) else []
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(texts, pa.binary())], ["order", "n", "words"])


def least_count(counts: DataFrame) -> int:
    """The least count, of those that end a bin, that TOP words or fewer reach. Bins are a sixteenth of a doubling wide."""
    bins = counts.groupBy(F.floor(F.log2("c") * 16).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()  # 1024 rows at most
    found, total = 1 << 62, 0
    for r in sorted(bins, key=lambda r: -r.bin):
        total += r.n
        if total > TOP:
            break
        found = r.least
    return found


def _learner(model, planned: float):
    """Trains a copy of the network over the texts of a partition, and yields its weights in blocks with the words it has seen."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        table = model.value.table
        network = Network(table)
        network.p = {k: v.copy() for k, v in model.value.network.p.items()}
        learner, seen, size, pool = Learner(network, table, LANES, PASS_RATE, planned), 0, 0, []
        for b in batches:
            words, n = hashed_words(*shared.buffer_of(b.column(0)))
            ids = np.insert(table.ids(words), np.cumsum(n), len(table.hashes) + 1)
            pool.append(ids)
            seen, size = seen + len(ids), size + len(ids)
            if size >= STREAM_WORDS:
                pool = [learner.learn(np.concatenate(pool))]
                size = len(pool[0])
        left = np.concatenate(pool) if pool else np.zeros(0, np.int32)
        while len(left):
            left = learner.learn(left)
        if seen:
            flat = np.concatenate([v.ravel() for v in network.p.values()])
            blocks = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            n, part = len(blocks), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([seen] * n, pa.int64()), pa.array(blocks, pa.binary())], ["block", "part", "seen", "weights"]
            )

    return run


def _averaged(blocks):
    """Of one block, the mean of its weights by words seen, in the order of the partitions."""
    import pyarrow as pa

    rows = blocks.sort_by("part")
    seen = rows["seen"].to_numpy().astype(np.float64)
    weights = np.zeros(len(rows["weights"][0].as_py()) // 4)
    for n, x in zip(seen / seen.sum(), rows["weights"]):
        weights += n * np.frombuffer(x.as_py(), np.float32)
    return pa.table({"block": rows["block"][:1], "seen": pa.array([int(seen.sum())], pa.int64()), "weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary())})


def learn_all(texts: DataFrame, model: Model) -> int:
    """Train the network of `model` over all texts (a column of bytes), a copy a partition, and average. Returns the words seen, ends included."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    planned = model.table.tokens / max(1, texts.rdd.getNumPartitions()) / (LANES * WINDOW)
    trained = texts.mapInArrow(_learner(sent, planned), "block int, part int, seen long, weights binary")
    blocks = sorted(trained.groupBy("block").applyInArrow(_averaged, "block int, seen long, weights binary").collect())  # the size of one network
    if not blocks:
        return 0
    flat, at = np.frombuffer(b"".join(bytes(r.weights) for r in blocks), np.float32), 0
    for k, v in model.network.p.items():
        model.network.p[k] = flat[at : at + v.size].reshape(v.shape).copy()
        at += v.size
    return blocks[0].seen


def starting_texts(rows: DataFrame) -> list[np.ndarray]:
    """Hashes of words of the texts that the network starts with, of `rows` (doc_id, text), in the order of the hashes of their ids.

    Texts are added until they have SAMPLE_WORDS words, the last one whole; texts of one id come together. Only these reach the driver.
    """
    order = F.xxhash64(F.lit(6), "doc_id").alias("order")
    sample = shared.hash_sample(rows, SAMPLE, 6).select(order, "text").mapInArrow(_hashes, "order long, n long, words binary")
    sample = shared.staged(sample, "sample")
    sizes = sample.groupBy("order").agg(F.sum("n").alias("n")).toPandas().sort_values("order")  # twice SAMPLE rows at most
    before = sizes["n"].cumsum() - sizes["n"]
    if not len(sizes):
        return []
    last = sizes["order"][before < SAMPLE_WORDS].max()
    found = sample.where(F.col("order") <= F.lit(int(last))).select("order", "words").collect()
    return [np.frombuffer(r.words, np.uint64) for r in sorted(found, key=lambda r: (r.order, bytes(r.words)))]


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts of `docs` (doc_id, text), and the counts (word, c) of all their words as a staged table."""
    shared.prepare(docs.sparkSession)
    rows = docs.select("doc_id", shared.text_bytes().alias("text"))
    counts = shared.staged(word_counts(rows.select("text")), "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    texts = docs.count()
    least = least_count(counts)
    top = counts.where(F.col("c") >= least).toPandas().sort_values(["c", "word"], ascending=[False, True])  # TOP rows at most
    table = Table(top["word"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), texts, (total.n or 0) + texts, total.v + bool(texts))
    start = [np.append(table.ids(words), len(table.hashes) + 1) for words in starting_texts(rows)]
    start = np.concatenate(start) if start else np.zeros(0, np.int64)
    model = Model(table, Network(table))
    learner = Learner(model.network, table, STREAMS, RATE, EPOCHS * len(start) / (STREAMS * WINDOW))
    for _ in range(EPOCHS if len(start) else 0):
        learner.learn(start)
    model.seen = learn_all(rows.select("text"), model)
    return model, counts


def _scorer(model):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        table, network = model.value.table, model.value.network
        known = np.append(np.log10(table.counts + 1.0), [0.0])
        row = TaskContext.get().partitionId() << 40
        pool: list = []

        def scored():
            nonlocal row
            words = np.concatenate([w for _, w, _ in pool])
            lengths = np.concatenate([n for _, _, n in pool])
            ids = table.ids(words)
            text = np.repeat(np.arange(len(lengths)), lengths)
            tail = ids == len(table.hashes)
            fine = network.score(table, ids, lengths) / math.log(10)
            tails = np.bincount(text[tail], minlength=len(lengths))
            top = np.bincount(text, known[ids], minlength=len(lengths))
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([d for d, _, _ in pool]),
                    pa.array(np.arange(row, row + len(lengths))),
                    pa.array(lengths.astype(np.int64)),
                    pa.array((lengths - tails).astype(np.int64)),
                    pa.array(top),
                    pa.array(fine),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tails)]).astype(np.int32)), pa.array(words[tail].view(np.int64))),
                ],
                ["doc_id", "row", "n_words", "n_top", "top_log", "network_log", "tail"],
            )
            row += len(lengths)
            pool.clear()
            return batch

        size = rows = 0
        for b in batches:
            words, n = hashed_words(*shared.buffer_of(b.column(1)))
            pool.append((b.column(0), words, n))
            size, rows = size + len(words), rows + b.num_rows
            if size >= POOL_WORDS or rows >= POOL_ROWS:
                yield scored()
                size = rows = 0
        if rows:
            yield scored()

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) for each row."""
    spark = docs.sparkSession
    shared.prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # TOP words and a small network at most
    schema = "doc_id long, row long, n_words long, n_top long, top_log double, network_log double, tail array<long>"
    first = shared.staged(docs.select(F.col("doc_id").cast("long"), shared.text_bytes().alias("text")).mapInArrow(_scorer(sent), schema), "scored")
    table = model.table
    tail = first.select("row", F.explode("tail").alias("word")).join(counts, "word", "left")
    sums = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("tail_log"), F.count("c").alias("tail_known"))
    rest_tokens = table.tokens - table.texts - int(table.counts.sum())
    rest_words = table.distinct - bool(table.texts) - len(table.hashes)
    base = math.log10(table.tokens + table.distinct + 1)
    tail_base = math.log10(rest_tokens + rest_words + 1)
    tail_log, tail_words = F.coalesce("tail_log", F.lit(0.0)), F.col("n_words") - F.col("n_top")
    joined = first.drop("tail").join(sums, "row", "left")
    return joined.select(
        "doc_id",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_top") + F.coalesce("tail_known", F.lit(0)) + int(table.texts > 0)).alias("n_known"),
        F.lit(table.tokens).cast("long").alias("train_tokens"),
        (F.col("top_log") + tail_log + math.log10(table.texts + 1) - (F.col("n_words") + 1) * base).alias("base_score"),
        (F.col("network_log") + tail_log - tail_words * tail_base).alias("score"),
    )
