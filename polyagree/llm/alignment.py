"""Alignment of two tokenizers: which tokens of one share bytes with which of the other, counted over all texts.

Both encode the same bytes, a space and the text: A a byte-level BPE, B a sentencepiece model, which puts that space before a text
itself. Byte offsets where tokens of both end cut a text into groups. Each stretch between two ends of either lies in one token of
A and one of B, and each pair of tokens that overlap has one such stretch, so the links of a text are as many as its ends.

An id pair's count is the number of texts that hold it linked. Pairs go to STRIPES stripes by their A id. What a task has read it
counts before the shuffle; a stripe is a dense matrix, A ids of the stripe by B ids, into which np.add.at puts these counts, and row
maxima give the best of each A id. The links of the texts go to the same stripe and are scored there, so counts are never sent to
texts; a stripe that has many links is dealt to several tasks, each with all its counts. What a task has in memory is one stripe's
matrix (100 MB for ids of 50 and 32 thousand) and one chunk of links.

Cases: a null or empty text has no tokens, nor has one whose tokens of A or B don't join to its bytes (a U+2581, which B takes for a
space, or what B does not know); its numbers are 0 and its hash ''. Strings of special tokens in texts are plain text. Texts are
encoded whole, in stretches that no token of B crosses; a very long one is cut at such places for the encoders and has one row.
Ties for the highest count all count as best; repeated rows stay rows, each a document of its own in counts; a null doc_id is an id
like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .tokenizing import Encoder, Memory, byte_characters, spread

#: Stripes of A ids, links (of a text, distinct) and texts in a chunk, and links that a task scores against one stripe.
STRIPES, LINKS, TEXTS, EACH = 128, 1 << 20, 1 << 16, 1 << 26
#: Bytes of texts that are aligned together.
BLOCK = 1 << 20


class Plain(Encoder):
    """Encoder to which strings of special tokens are plain text."""

    _made: dict = {}

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special = []
        shown = {c: b for b, c in byte_characters().items()}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.tokens = [bytes(shown[c] for c in t) if all(c in shown for c in t) else t.encode() for t in names]


class Pieces(Encoder):
    """Ids of a sentencepiece model for texts with a space before them, by stretches: spaces and what follows up to the next.

    No token has a space after another character (else texts are encoded whole), so those of a text are those of its stretches
    in a row; alike stretches are encoded once and remembered.
    """

    _made: dict = {}

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.special, self.classes = [], None
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode("a  b ", out_type=str) == self.model.encode("a", out_type=str) + self.model.encode(" b", out_type=str) + ["▁"]
        self.merger = self.apart
        self.memory, self.powers = Memory(self.kind), np.ones(1, np.uint64)
        self.space = self.model.piece_to_id("▁")
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.model.encode(text[1:].decode("utf-8", "replace"), num_threads=1), self.kind)

    def _pieces(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = raw == 32
        starts = space & ~np.append(False, space[:-1])
        starts[at[:-1]] = True
        return np.flatnonzero(starts), np.zeros(len(at) - 1, bool)

    def _merge(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = raw.tobytes()
        texts = [data[a + 1 : a + n].decode("utf-8", "replace") for a, n in zip(starts.tolist(), sizes.tolist())]
        found = [x or [self.space] for x in self.model.encode(texts, num_threads=1)] if texts else []
        return np.array([i for x in found for i in x], self.kind), np.array([len(x) for x in found], np.int64)


class Table:
    """Bytes of the tokens of an encoder, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)

    def differ(self, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each text, whether the bytes of its tokens are not its own."""
        sizes = self.sizes[ids]
        total = np.append(0, np.cumsum(sizes))
        ends = np.append(0, np.cumsum(counts))
        lengths = total[ends[1:]] - total[ends[:-1]]
        bad = lengths != np.diff(at)
        if bad.any():
            some = np.repeat(~bad, counts)
            ids, sizes, there = ids[some], sizes[some], np.repeat(~bad, np.diff(at))
            raw, texts = raw[there], np.repeat(np.arange(len(bad)), np.diff(at))[there]
        made = self.raw[spread(self.begins[ids], sizes)]
        if not np.array_equal(made, raw):
            texts = texts if bad.any() else np.repeat(np.arange(len(bad)), np.diff(at))
            bad[texts[made != raw]] = True
        return bad


def decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to `most` - 1, with room for a mark, and their number."""
    text = np.char.mod("%d", np.arange(max(1, most)))
    sizes = np.char.str_len(text)
    width = int(sizes.max()) + 1
    return np.frombuffer(text.astype(f"S{width}").tobytes(), np.uint8).reshape(-1, width).copy(), sizes


def aligned(a_ends: np.ndarray, b_ends: np.ndarray) -> list[np.ndarray]:
    """Of byte offsets where tokens of a and b end: the token of a and that of b of each link, in order, and the group of each token of a and of b."""
    common, every = np.intersect1d(a_ends, b_ends, assume_unique=True), np.union1d(a_ends, b_ends)
    return [np.searchsorted(x, y) for x, y in ((a_ends, every), (b_ends, every), (common, a_ends), (common, b_ends))]


class Aligner:
    """Both encoders of a worker."""

    _made: dict = {}

    @classmethod
    def of(cls, a: str, b: str) -> "Aligner":
        if (a, b) not in cls._made:
            cls._made[a, b] = cls(a, b)
        return cls._made[a, b]

    def __init__(self, a: str, b: str):
        self.a, self.b = Plain.of(a), Pieces.of(b)
        self.a_table, self.b_table = Table(self.a.tokens), Table(self.b.tokens)
        self.digits, self.widths = decimals(max(len(self.a.tokens), len(self.b.tokens)))

    def groups(self, ids: np.ndarray, sides: np.ndarray, groups: np.ndarray, ends: np.ndarray) -> list[str]:
        """SHA-256 of each text's tokens as text: those of a group and side in a row, `ends` after the last of each text."""
        mark = np.full(len(ids), 44, np.uint8)
        same = groups[1:] == groups[:-1]
        mark[:-1][same & (sides[1:] != sides[:-1])] = 124
        mark[:-1][~same] = 59
        cells = self.digits[ids]
        widths = self.widths[ids]
        cells[np.arange(len(ids)), widths] = mark
        text = cells[np.arange(cells.shape[1]) <= widths[:, None]].tobytes()
        at = np.append(0, np.cumsum(widths + 1))[np.append(0, ends)]
        return [hashlib.sha256(text[i : j - 1]).hexdigest() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]

    def block(self, raw: np.ndarray, at: np.ndarray):
        """Of texts (each with its space, none empty): numbers of a, b, groups and links and the hash of each, and their distinct linked pairs (text, a, b, how often)."""
        n = len(at) - 1
        a, an = self.a.encode_buffer(raw, at)
        b, bn = self.b.encode_buffer(raw, at)
        bad = self.a_table.differ(a, an, raw, at) | self.b_table.differ(b, bn, raw, at)
        if bad.any():
            a, b = a[np.repeat(~bad, an)], b[np.repeat(~bad, bn)]
            an, bn = np.where(bad, 0, an), np.where(bad, 0, bn)
        la, lb, ga, gb = aligned(np.cumsum(self.a_table.sizes[a]), np.cumsum(self.b_table.sizes[b]))  # texts end with tokens of both
        a_of = np.repeat(np.arange(n), an)
        links = np.bincount(a_of[la], minlength=n)
        n_groups = an + bn - links
        order_a = np.arange(len(a)) + np.searchsorted(gb, ga, side="left")  # tokens of b in earlier groups stand before
        order_b = np.arange(len(b)) + np.searchsorted(ga, gb, side="right")
        ids, sides, groups = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), bool), np.zeros(len(a) + len(b), np.int64)
        ids[order_a], ids[order_b], sides[order_b], groups[order_a], groups[order_b] = a, b, True, ga, gb
        full = np.flatnonzero(~bad)
        hashes = np.full(n, "", object)
        hashes[full] = self.groups(ids, sides, groups, np.cumsum(an + bn)[full]) if len(full) else ()
        keys = (a_of[la].astype(np.uint64) << np.uint64(44)) | (a[la].astype(np.uint64) << np.uint64(22)) | b[lb].astype(np.uint64)
        keys, often = np.unique(keys, return_counts=True)
        return an, bn, n_groups, links, hashes, keys, often


ROW = "kind int, stripe int, chunk long, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n long, payload binary"
NAMES = [c.split()[0] for c in ROW.split(", ")]
_MASK = np.uint64((1 << 22) - 1)


def _record(values: dict, n: int):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(values[c], kinds[k]) if c in values else pa.nulls(n, kinds[k]) for c, k in (x.split() for x in ROW.split(", "))], NAMES)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length end to end, each in the least kind that holds it, named by a byte before all."""
    kinds = [0 if x.max(initial=0) < 256 else 1 if x.max(initial=0) < 1 << 16 else 2 if x.max(initial=0) < 1 << 32 else 3 for x in arrays]
    return bytes(kinds) + b"".join(x.astype(f"<u{1 << k}").tobytes() for x, k in zip(arrays, kinds))


def unpack(data: bytes, many: int) -> list[np.ndarray]:
    kinds, at, out = data[:many], many, []
    n = (len(data) - many) // max(1, sum(1 << k for k in kinds))
    for k in kinds:
        out.append(np.frombuffer(data, f"<u{1 << k}", n, at).astype(np.int64))
        at += n << k
    return out


def _chunk(chunk: int, texts: np.ndarray, a: np.ndarray, b: np.ndarray, often: np.ndarray):
    """Rows of a chunk: for each stripe its links (kind 1) and how many of the chunk's texts hold each pair (kind 0)."""
    stripe = a % STRIPES
    order = np.argsort(stripe, kind="stable")
    edges = np.searchsorted(stripe[order], np.arange(STRIPES + 1))
    rows: dict[str, list] = {"kind": [], "stripe": [], "chunk": [], "n": [], "payload": []}
    for s in np.flatnonzero(np.diff(edges)):
        some = order[edges[s] : edges[s + 1]]
        keys, counts = np.unique((a[some] << 22) | b[some], return_counts=True)
        payloads = pack(keys >> 22, keys & int(_MASK), counts), pack(texts[some], a[some], b[some], often[some])
        for kind, payload in enumerate(payloads):
            for name, x in zip(rows, (kind, s, chunk, len(some), payload)):
                rows[name].append(x)
    return _record(rows, len(rows["kind"]))


def _aligned(path_a: str, path_b: str, most_links: int, most_texts: int):
    def of(batches):
        from pyspark import TaskContext

        aligner = Aligner.of(path_a, path_b)
        chunk, row, kept, n = (TaskContext.get().partitionId() << 36), 0, [], 0

        def links():
            texts, a, b, often = (np.concatenate(c) for c in zip(*kept))
            return _chunk(chunk, texts, a, b, often)

        for batch in batches:
            raw, at = shared.buffer_of(batch.column(1))
            for first, last in ((i, min(i + most_texts, end)) for begin, end in shared.row_blocks(at, BLOCK) for i in range(begin, end, most_texts)):
                sizes = np.diff(at[first : last + 1])
                full = np.flatnonzero(sizes > 0)
                part = np.insert(raw[at[first] : at[last]], at[first : last + 1][full] - at[first], np.uint8(32))
                numbers = {c: np.zeros(last - first, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
                hashes = np.full(last - first, "", object)
                if len(full):
                    an, bn, groups, n_links, hashes[full], keys, often = aligner.block(part, np.append(0, np.cumsum(sizes[full] + 1)))
                    for c, x in zip(numbers, (an, bn, groups, n_links)):
                        numbers[c][full] = x
                    if row + last - first > most_texts or n and n + len(keys) > most_links:
                        if kept:
                            yield links()
                        chunk, row, kept, n = chunk + 1, 0, [], 0
                    texts = row + full[(keys >> np.uint64(44)).astype(np.int64)]
                    kept.append((texts, (keys >> np.uint64(22) & _MASK).astype(np.int64), (keys & _MASK).astype(np.int64), often))
                    n += len(keys)
                elif row + last - first > most_texts:
                    if kept:
                        yield links()
                    chunk, row, kept, n = chunk + 1, 0, [], 0
                values = {"kind": np.full(last - first, 2, np.int32), "chunk": np.full(last - first, chunk), "row": row + np.arange(last - first), "doc_id": batch.column(0).slice(first, last - first), "groups_sha256": hashes.tolist()} | numbers
                yield _record(values, last - first)
                row += last - first
        if kept:
            yield links()

    return of


def encode_all(docs: DataFrame, path_a: str, path_b: str, chunk: tuple[int, int] = (LINKS, TEXTS)) -> DataFrame:
    """Rows of three kinds, stored: of each text (2), and of each chunk (so many links and texts at most, or one text) and stripe the links (1) and their counts (0)."""
    shared.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_bytes().alias("text"))
    return shared.staged(rows.mapInArrow(_aligned(path_a, path_b, *chunk), ROW), "aligned")


def _scored(size_a: int, size_b: int):
    def of(batches):
        import pyarrow as pa

        now, matrix, best = None, None, None
        for batch in batches:
            out: dict[str, list] = {"chunk": [], "payload": []}
            for i in range(batch.num_rows):
                key = batch.column("stripe")[i].as_py(), batch.column("part")[i].as_py()
                if key != now:
                    now, best = key, None
                    matrix = np.zeros((-(-size_a // STRIPES), size_b), np.int64)
                data = batch.column("payload")[i].as_buffer().to_pybytes()
                if batch.column("kind")[i].as_py() == 0:
                    a, b, counts = unpack(data, 3)
                    np.add.at(matrix, (a // STRIPES, b), counts)
                    continue
                if best is None:
                    best = matrix.max(axis=1)
                texts, a, b, often = unpack(data, 4)
                counts = matrix[a // STRIPES, b]
                top, sums = np.where(counts == best[a // STRIPES], often, 0), counts * often
                order = np.argsort(texts, kind="stable")
                texts = texts[order]
                first = np.flatnonzero(np.append(True, texts[1:] != texts[:-1]))
                out["chunk"].append(batch.column("chunk")[i].as_py())
                out["payload"].append(pack(texts[first], np.add.reduceat(top[order], first), np.add.reduceat(sums[order], first)))
            if out["chunk"]:
                yield pa.RecordBatch.from_arrays([pa.array(out["chunk"], pa.int64()), pa.array(out["payload"], pa.binary())], ["chunk", "payload"])

    return of


def _summed(batches):
    """Sums of a chunk's texts over its stripes; chunks come one after another."""
    import pyarrow as pa

    names = ["chunk", "row", "n_best", "count_sum"]
    now, top, sums = None, None, None

    def out():
        rows = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), now)), pa.array(rows), pa.array(top[rows]), pa.array(sums[rows])], names)

    for b in batches:
        for i in range(b.num_rows):
            chunk = b.column(0)[i].as_py()
            if chunk != now:
                if now is not None:
                    yield out()
                now, top, sums = chunk, np.zeros(TEXTS, np.int64), np.zeros(TEXTS, np.int64)
            texts, n, m = unpack(b.column(1)[i].as_buffer().to_pybytes(), 3)
            top[texts] += n  # a text stands once in a row
            sums[texts] += m
    if now is not None:
        yield out()


def sizes_of(path_a: str, path_b: str) -> tuple[int, int]:
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path_a).get_vocab_size(), SentencePieceProcessor(model_file=path_b).get_piece_size()


def striped(found: DataFrame, each: int = EACH) -> DataFrame:
    """Links and counts of encode_all(), those of one stripe and part together, counts first. A stripe of many links has several parts, each with all counts."""
    chunks = found.where("kind < 2").select("kind", "stripe", "chunk", "n", "payload")
    parts = chunks.where("kind = 1").groupBy("stripe").agg(F.ceil(F.sum("n") / each).cast("int").alias("parts"))  # STRIPES rows at most
    chunks = chunks.join(F.broadcast(parts), "stripe")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = F.when(F.col("kind") == 0, every).otherwise(F.array(F.pmod(F.xxhash64("chunk"), "parts").cast("int")))
    chunks = chunks.withColumn("part", F.explode(dealt)).drop("parts", "n")
    return chunks.repartition("stripe", "part").sortWithinPartitions("stripe", "part", "kind")


def align(docs: DataFrame, path_a: str, path_b: str, chunk: tuple[int, int] = (LINKS, TEXTS), each: int = EACH) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row."""
    found = encode_all(docs, path_a, path_b, chunk)
    sums = striped(found, each).mapInArrow(_scored(*sizes_of(path_a, path_b)), "chunk long, payload binary")
    sums = sums.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_summed, "chunk long, row long, n_best long, count_sum long")
    rows = found.where("kind = 2").join(shared.staged(sums, "scores"), ["chunk", "row"], "left")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")


def _best(size_a: int, size_b: int):
    def of(batches):
        import pyarrow as pa

        now, matrix = None, None

        def out():
            a, b = np.nonzero((matrix == matrix.max(axis=1, keepdims=True)) & (matrix > 0))
            return pa.RecordBatch.from_arrays([pa.array(a * STRIPES + now), pa.array(b), pa.array(matrix[a, b])], ["a", "b", "texts"])

        for batch in batches:
            for i in range(batch.num_rows):
                stripe = batch.column("stripe")[i].as_py()
                if stripe != now:
                    if now is not None:
                        yield out()
                    now, matrix = stripe, np.zeros((-(-size_a // STRIPES), size_b), np.int64)
                a, b, counts = unpack(batch.column("payload")[i].as_buffer().to_pybytes(), 3)
                np.add.at(matrix, (a // STRIPES, b), counts)
        if now is not None:
            yield out()

    return of


def best_pairs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, texts): for each A id the B ids with which most texts hold it linked, and how many; a table to translate ids by."""
    counts = encode_all(docs, path_a, path_b).where("kind = 0").select("stripe", "payload")
    return counts.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(_best(*sizes_of(path_a, path_b)), "a long, b long, texts long")
