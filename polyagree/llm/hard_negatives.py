"""Hard negatives of anchors by product quantisation with stored residual norms.

Vectors are integers, scores their inner products. A vector is stored in blocks of rows with the codes of its parts (the nearest
of CENTROIDS centroids each) and the norms of what the codes leave of each part. For a block of anchors against a block of rows,
tables of anchor parts times centroids give a score for each pair by look-ups; the true score lies within the sum over parts of
the anchor part's norm times the residual's, by Cauchy and Schwarz. Only pairs whose interval reaches what is sought are scored
in integers, so results are exact whatever the codebooks are like; these are fitted on a bounded sample, every row is coded.

Two passes over the blocks: the first finds each anchor's positives, the second completes a window of scores for each anchor and
positive. Blocks of anchors meet blocks of rows by groups of blocks, so a task holds one block of each; best rows are merged
within a task while the block of anchors stays the same, and the rest by rank.

Cases: rows with a null id, label or vector, or with a component that is null, not finite or 2^20 and more in size (scores might
not fit a long), take no part; of rows with one id counts the one of least label, then vector; vectors of other lengths count as
ended by zeros; an anchor is no positive of its own; equal scores go by the smaller id; anchors without positives, and positives
without a negative in the window, give no row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Rows that the codebooks are fitted on (at most twice as many), parts of a vector, centroids of each part, and rounds of fitting.
SAMPLE, PARTS, CENTROIDS, ROUNDS = 4096, 16, 64, 8
#: Rows of a block, anchors of a block, and blocks of rows that a key brings together at most.
ROWS, ANCHORS, TOGETHER = 2048, 512, 64
SCALE, LARGEST = 256, 1 << 20

BLOCK = "of long, ids binary, labels binary, vectors binary, codes binary, residuals binary"


def usable(rows: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """vec_id, label, vector (doubles) of the rows that take part, one for each id."""
    some = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < LARGEST))  # NaN is greater than any number
    some = some.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fine)
    return some.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")


def relabelled(rows: DataFrame, every: int, labels: int) -> DataFrame:
    """Rows whose vec_id is divisible by `every` get the next of `labels` labels: known noise that a miner must live with."""
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def scaled(lists, dim: int) -> np.ndarray:
    """Integers of an Arrow array of lists of doubles, rows x dim."""
    import pyarrow.compute as pc

    sizes = np.minimum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dim)
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE).astype(np.int64)
    if (sizes == dim).all():
        return flat.reshape(len(lists), dim)
    out = np.zeros((len(lists), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def parted(x: np.ndarray) -> np.ndarray:
    """rows x PARTS x width; ended by zeros."""
    width = max(1, -(-x.shape[1] // PARTS))
    out = np.zeros((len(x), PARTS * width), np.float32)
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), PARTS, width)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T * -2 + (centroids * centroids).sum(axis=1)).argmin(axis=1)


def fit(sample: np.ndarray) -> np.ndarray:
    """PARTS x CENTROIDS x width: centroids of each part by rounds of nearest means, from rows at even steps."""
    x = parted(sample)
    books = np.zeros((PARTS, CENTROIDS, x.shape[2]), np.float32)
    if len(x):
        for j in range(PARTS):
            centroids = x[np.linspace(0, len(x) - 1, CENTROIDS).astype(int), j]
            for _ in range(ROUNDS):
                at = nearest(x[:, j], centroids)
                n = np.bincount(at, minlength=CENTROIDS)
                sums = np.zeros(centroids.shape, np.float64)
                np.add.at(sums, at, x[:, j])
                centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids).astype(np.float32)
            books[j] = centroids
    return books


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x PARTS) and norms of residuals, rounded up."""
    parts, codes = parted(x), np.zeros((len(x), PARTS), np.uint8)
    residuals = np.zeros((len(x), PARTS), np.float32)
    for j in range(PARTS):
        codes[:, j] = nearest(parts[:, j], books[j])
        rest = parts[:, j].astype(np.float64) - books[j][codes[:, j]]
        residuals[:, j] = np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-6)
    return codes, residuals


def _blocks(books: np.ndarray, dim: int, groups: int, size: int):
    def of(batches):
        import pyarrow as pa

        kept, n = [], 0
        for b in batches:
            kept.append((b.column(0).to_numpy(), b.column(1).to_numpy(), scaled(b.column(2), dim)))
            n += b.num_rows
            while n >= size:
                ids, labels, x = (np.concatenate(c) for c in zip(*kept))
                yield block(ids[:size], labels[:size], x[:size])
                kept, n = [(ids[size:], labels[size:], x[size:])], n - size
        if n:
            yield block(*(np.concatenate(c) for c in zip(*kept)))

    def block(ids, labels, x):
        import pyarrow as pa

        codes, residuals = encode(x, books)
        of = int(shared._mixed(ids[:1].astype(np.uint64))[0] % np.uint64(groups))
        columns = [pa.array([of], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in (ids.astype("<i8"), labels.astype("<i8"), packed(x), codes, residuals))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCK.split(", ")])

    return of


def packed(x: np.ndarray) -> np.ndarray:
    return x.astype("<i2") if len(x) and np.abs(x).max(initial=0) < 1 << 15 else x.astype("<i4")


def vectors_of(data: bytes, rows: int, dim: int) -> np.ndarray:
    """rows x dim doubles, which hold these integers exactly."""
    return np.frombuffer(data, "<i2" if len(data) == 2 * rows * dim else "<i4").reshape(rows, dim).astype(np.float64)


class Index:
    """A stored table of blocks: `of` groups of them, `dim` components, the codebooks."""

    def __init__(self, blocks: DataFrame, books: np.ndarray, dim: int, groups: int):
        self.blocks, self.books, self.dim, self.groups = blocks, books, dim, groups


def index(rows: DataFrame, size: int = ROWS) -> Index:
    """Code all `rows` (vec_id, label, vector) and store them in blocks of `size` rows."""
    spark = rows.sparkSession
    rows = shared.staged(rows, "vectors")
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    dim = max(1, dim)
    sample = [(x.vec_id, x.vector) for x in shared.hash_sample(rows, SAMPLE, seed=11, key="vec_id").select("vec_id", "vector").collect()]
    found = np.zeros((len(sample), dim), np.int64)
    for i, (_, v) in enumerate(sorted(sample)):
        found[i, : len(v)] = np.floor(np.array(v, np.float64) * SCALE)
    books = fit(found)
    many = -(-n // size)
    groups = max(1, min(many, max(int(spark.conf.get("spark.sql.shuffle.partitions")), many // TOGETHER)))
    made = rows.mapInArrow(_blocks(books, dim, groups, size), BLOCK)
    return Index(shared.staged(made, "blocks"), books, dim, groups)


# -- scoring a block of anchors against a block of rows ---------------------------------------------------------------------


class Anchors:
    """A block of anchors: integers, their part norms, and tables of parts times centroids."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, books: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        parts = parted(vectors)
        self.norms = (np.sqrt((parts.astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-6)).astype(np.float32)
        self.length = np.sqrt((vectors * vectors).sum(axis=1))
        self.tables = [np.ascontiguousarray(books[j] @ parts[:, j].T) for j in range(PARTS)]  # centroids x anchors
        self.reach = float(np.sqrt(sum((b.astype(np.float64) ** 2).sum(axis=1).max() for b in books)))

    def bounds(self, codes: np.ndarray, residuals: np.ndarray, some=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score, rows x anchors; float32 sums are allowed for."""
        score = self.tables[0][codes[:, 0]][:, some]
        for j in range(1, PARTS):
            score = score + self.tables[j][codes[:, j]][:, some]
        slack = residuals @ self.norms[some].T
        slack = slack * np.float32(1 + 1e-5) + (1e-5 * self.length[some] * self.reach + 1e-3).astype(np.float32)
        return score - slack, score + slack


def exact(anchors: np.ndarray, rows: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer scores of pairs: in doubles where sums stay below 2^53, else in longs."""
    small = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * anchors.shape[1] < 1 << 53
    if small and len(a) * 4 > len(anchors) * len(rows):
        return (anchors @ rows.T)[a, r].astype(np.int64)
    out = np.zeros(len(a), np.int64)
    if not small:
        anchors, rows = anchors.astype(np.int64), rows.astype(np.int64)
    for i in range(0, len(a), 1 << 16):
        out[i : i + (1 << 16)] = np.einsum("ij,ij->i", anchors[a[i : i + (1 << 16)]], rows[r[i : i + (1 << 16)]])
    return out


def best_of(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` best of each slot: by score, then the smaller id."""
    order = np.lexsort((ids, -score, slot))
    s = slot[order]
    first = np.append(True, s[1:] != s[:-1])
    rank = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0)) if len(s) else s
    return order[rank < most]


class Best:
    """The best rows so far for each of a number of slots."""

    def __init__(self, slots: int, most: int):
        self.most, self.slot, self.score, self.ids = most, *(np.zeros(0, np.int64) for _ in range(3))
        self.bar = np.full(slots, -np.inf)  # a row below cannot be among the best of a slot that is full

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.append(self.slot, slot), np.append(self.score, score), np.append(self.ids, ids)
        kept = best_of(slot, score, ids, self.most)
        self.slot, self.score, self.ids = slot[kept], score[kept], ids[kept]
        full = np.flatnonzero(np.bincount(self.slot, minlength=len(self.bar)) == self.most)
        last = np.searchsorted(self.slot, full, side="right") - 1
        self.bar[full] = self.score[last]


def least_of_best(low: np.ndarray, most: int) -> np.ndarray:
    """The `most`-th greatest of each column, -inf where there are fewer rows."""
    if len(low) < most:
        return np.full(low.shape[1], -np.inf)
    return np.partition(low, len(low) - most, axis=0)[len(low) - most]


def positives_in(anchors: Anchors, best: Best, ids, labels, rows, codes, residuals) -> None:
    """Add to `best` (a slot for each anchor) what this block of rows has of the anchors' labels."""
    for label in np.intersect1d(anchors.labels, labels):
        a, r = np.flatnonzero(anchors.labels == label), np.flatnonzero(labels == label)
        low, high = anchors.bounds(codes[r], residuals[r], a)
        other = ids[r][:, None] != anchors.ids[a]
        bar = np.maximum(best.bar[a], least_of_best(np.where(other, low, -np.inf), best.most))
        k, i = np.nonzero(other & (high >= bar))
        best.add(a[i], exact(anchors.vectors, rows, a[i], r[k]), ids[r[k]])


def negatives_in(anchors: Anchors, windows: np.ndarray, best: Best, ids, labels, rows, codes, residuals) -> None:
    """Add to `best` what this block has within windows (anchor, least, most; a slot each) of other labels than the anchor's."""
    low, high = anchors.bounds(codes, residuals)
    other = labels[:, None] != anchors.labels
    turn = np.arange(len(windows)) - np.searchsorted(windows[:, 0], windows[:, 0])  # windows go by anchors
    for k in range(int(turn.max(initial=-1)) + 1):  # the k-th window of each anchor
        slots = np.flatnonzero(turn == k)
        a, least, most = windows[slots].T
        lows, highs = low[:, a], high[:, a]
        inside = other[:, a] & (highs >= least) & (lows <= most)
        sure = inside & (lows >= least) & (highs <= most)
        bar = np.maximum(best.bar[slots], least_of_best(np.where(sure, lows, -np.inf), best.most))
        r, i = np.nonzero(inside & (highs >= bar))
        score = exact(anchors.vectors, rows, a[i], r)
        fits = (score >= least[i]) & (score <= most[i])
        best.add(slots[i][fits], score[fits], ids[r[fits]])


def _row_block(b, i: int, dim: int):
    ids = np.frombuffer(b.column("ids")[i].as_buffer(), "<i8")
    labels = np.frombuffer(b.column("labels")[i].as_buffer(), "<i8")
    rows = vectors_of(b.column("vectors")[i].as_buffer(), len(ids), dim)
    codes = np.frombuffer(b.column("codes")[i].as_buffer(), np.uint8).reshape(-1, PARTS)
    return ids, labels, rows, codes, np.frombuffer(b.column("residuals")[i].as_buffer(), "<f4").reshape(-1, PARTS)


def _anchor_block(b, i: int, books: np.ndarray, dim: int) -> Anchors:
    ids = np.frombuffer(b.column("a_ids")[i].as_buffer(), "<i8")
    return Anchors(ids, np.frombuffer(b.column("a_labels")[i].as_buffer(), "<i8"), vectors_of(b.column("a_vectors")[i].as_buffer(), len(ids), dim), books)


def _found(found: list[np.ndarray], names: list[str]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names)


def _positives(books: np.ndarray, dim: int, most: int):
    names = ["anchor_id", "positive_id", "positive_score"]

    def of(batches):
        now, anchors, best = None, None, None
        for b in batches:
            for i in range(b.num_rows):
                key = b.column("a_block")[i].as_py()
                if key != now:
                    if best:
                        yield _found([anchors.ids[best.slot], best.ids, best.score], names)
                    now, anchors = key, _anchor_block(b, i, books, dim)
                    best = Best(len(anchors.ids), most)
                positives_in(anchors, best, *_row_block(b, i, dim))
        if best:
            yield _found([anchors.ids[best.slot], best.ids, best.score], names)

    return of


def parts_of(score: np.ndarray, part: int, whole: int) -> np.ndarray:
    """score * part / whole, rounded down, without a product beyond a long."""
    return score // whole * part + score % whole * part // whole


def _negatives(books: np.ndarray, dim: int, most: int, share: tuple[int, int, int]):
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    low, high, whole = share

    def of(batches):
        now, anchors, best, windows, positives = None, None, None, None, None

        def out():
            p = positives[best.slot]
            return _found([anchors.ids[p[:, 0]], p[:, 1], p[:, 2], best.ids, best.score], names)

        for b in batches:
            for i in range(b.num_rows):
                key = b.column("a_block")[i].as_py()
                if key != now:
                    if best:
                        yield out()
                    now, anchors = key, _anchor_block(b, i, books, dim)
                    positives = np.frombuffer(b.column("a_positives")[i].as_buffer(), "<i8").reshape(-1, 3)
                    windows = np.stack([positives[:, 0], -parts_of(-positives[:, 2], low, whole), parts_of(positives[:, 2], high, whole)], axis=1)
                    best = Best(len(windows), most)
                negatives_in(anchors, windows, best, *_row_block(b, i, dim))
        if best:
            yield out()

    return of


# -- anchors ------------------------------------------------------------------------------------------------------------------


def _picked(every: int, dim: int):
    """Anchors of blocks of rows: those whose id is divisible by `every`."""

    def of(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                ids, labels, rows, _, _ = _row_block(b, i, dim)
                some = ids % every == 0
                vectors = pa.array([x.tobytes() for x in rows[some].astype("<i4")], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(labels[some]), vectors], ["anchor_id", "label", "vector"])

    return of


def _anchor_blocks(dim: int, size: int):
    """Blocks of rows anchor_id, label, vector, positives (list of id, score)."""

    def of(batches):
        import pyarrow as pa

        names = ["a_block", "a_ids", "a_labels", "a_vectors", "a_positives"]
        for b in batches:
            for first in range(0, b.num_rows, size):
                some = b.slice(first, size)
                ids, labels = some.column(0).to_numpy(), some.column(1).to_numpy()
                x = np.frombuffer(b"".join(v.as_py() for v in some.column(2)), "<i4").reshape(len(ids), dim)
                positives = [(k, p["positive_id"], p["positive_score"]) for k, list_ in enumerate(some.column(3)) for p in (list_.as_py() or ())]
                table = np.array(positives, "<i8").reshape(-1, 3)
                columns = [pa.array([int(ids[0])]), *(pa.array([c.tobytes()], pa.binary()) for c in (ids.astype("<i8"), labels.astype("<i8"), packed(x), table))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return of


def against(anchors: DataFrame, found: Index, size: int = ANCHORS) -> DataFrame:
    """Each block of anchors beside each block of rows; those of one block of anchors follow each other.

    Blocks of anchors go to all groups of blocks of rows, and a key holds TOGETHER of these or so.
    """
    made = anchors.mapInArrow(_anchor_blocks(found.dim, size), "a_block long, a_ids binary, a_labels binary, a_vectors binary, a_positives binary")
    each = shared.staged(made, "anchor-blocks").withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(found.groups - 1).cast("long"))))
    return each.hint("merge").join(found.blocks, "of")


def ranked(rows: DataFrame, by: list[str], score: str, tie: str, most: int) -> DataFrame:
    """The `most` best of each group with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def positives(found: Index, every: int, most: int, size: int = ANCHORS) -> DataFrame:
    """anchor_id, label, vector, and a list of the best `most` rows of its label, best first."""
    anchors = shared.staged(found.blocks.select(*[c.split()[0] for c in BLOCK.split(", ")][1:]).mapInArrow(_picked(every, found.dim), "anchor_id long, label long, vector binary"), "anchors")
    none = F.lit(None).cast("array<struct<positive_id:long,positive_score:long>>").alias("positives")
    pairs = against(anchors.select("anchor_id", "label", "vector", none), found, size).mapInArrow(_positives(found.books, found.dim, most), "anchor_id long, positive_id long, positive_score long")
    pairs = shared.staged(ranked(pairs, ["anchor_id"], "positive_score", "positive_id", most), "positives")
    lists = pairs.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))
    return anchors.join(lists, "anchor_id").select("anchor_id", "label", "vector", F.transform("p", lambda x: F.struct(x["positive_id"].alias("positive_id"), x["positive_score"].alias("positive_score"))).alias("positives"))


def mine(rows: DataFrame, every: int = 50, most_positives: int = 5, most_negatives: int = 3, share: tuple[int, int, int] = (50, 95, 100), sizes: tuple[int, int] = (ROWS, ANCHORS)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, of `rows` (vec_id, label, vector; see usable()).

    Anchors are rows whose id is divisible by `every`. share: a negative's score is at least the first and at most the second
    part of the third of the positive's score. sizes: rows and anchors of a block.
    """
    shared.prepare(rows.sparkSession)
    found = index(rows, sizes[0])
    wanted = positives(found, every, most_positives, sizes[1])
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    pairs = against(wanted, found, sizes[1]).mapInArrow(_negatives(found.books, found.dim, most_negatives, share), schema)
    best = ranked(pairs, ["anchor_id", "positive_id"], "negative_score", "negative_id", most_negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
