"""Packing documents into sequences of a fixed capacity by minimum bin slack.

Each task tokenizes its documents. Whole windows of `capacity` ids are sequences of their own; what remains of each
document, shorter than a window, waits in a pool. A subset-sum dynamic program over the pool's lengths, a bitset of the
sums that can be reached, finds the multiset of lengths that fills a window closest to its capacity; it starts from the
longest that waits, and is applied as often as the counts of lengths allow. Where no multiset fills a window, a piece is cut to
fill it, so the pool stays small and at most one sequence of each task is not full. No shuffle: the packing of a task needs its
own rows only.

Cases: null text counts as empty and has only the end id; repeated rows and repeated doc_ids are packed each; an empty
table gives no sequence; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .tokenizing import Encoder

#: Pieces that wait before windows are filled.
POOL = 8192
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the longest in it whose sum is closest to `capacity` from below: {length: number}.

    `reach` has a bit for each sum that lengths so far can make. Each length comes in portions of 1, 2, 4 ... pieces, so
    that any number of them can be made; the bitsets before each portion tell, backwards, which portions were taken.
    """
    longest = max(counts)
    room = capacity - longest
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, portion = min(counts[length] - (length == longest), room // length), 1
        while left > 0:
            take = min(portion, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & full
            left, portion = left - take, portion * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, defaultdict(int, {longest: 1})
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return dict(used)


class Pool:
    """Pieces (document, start, length, ids, tokens of the document) by length, in the order they came."""

    def __init__(self, capacity: int):
        self.capacity, self.by, self.counts, self.n = capacity, defaultdict(list), {}, 0

    def add(self, piece: tuple) -> None:
        self.by[piece[2]].append(piece)
        self.counts[piece[2]] = self.counts.get(piece[2], 0) + 1
        self.n += 1

    def _take(self, length: int, times: int = 1) -> list[tuple]:
        self.n -= times
        self.counts[length] -= times
        if not self.counts[length]:
            del self.counts[length]
        return [self.by[length].pop() for _ in range(times)]

    def fill(self, all_of_it: bool):
        """Full sequences, as lists of pieces, until few are left; with `all_of_it` until none is, the last as it comes.

        Where no multiset of lengths fills a window, the longest piece left is cut to fill it.
        """
        while self.counts and (all_of_it or self.n > POOL // 8):
            used = closest_fill(self.counts, self.capacity)
            room = self.capacity - sum(k * n for k, n in used.items())
            for _ in range(1 if room else min(self.counts[k] // n for k, n in used.items())):
                sequence = [piece for k, n in used.items() for piece in self._take(k, n)]
                if room and self.counts:
                    doc, start, length, ids, total = self._take(max(self.counts))[0]
                    cut = room * (len(ids) // length)
                    sequence.append((doc, start, room, ids[:cut], total))
                    self.add((doc, start + room, length - room, ids[cut:], total))
                yield sequence


def _crc(ids: bytes, width: int) -> int:
    return zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())


def _packer(tokenizer: str, end_id: int, capacity: int, digest: bool):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = Encoder.of(tokenizer)
        pool, sequence_id, width = Pool(capacity), TaskContext.get().partitionId() << 33, 0
        ids_field = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ids_field, ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
        out: list[list] = [[] for _ in schema]

        def put(sequence):
            nonlocal sequence_id
            offset = 0
            for doc, start, length, ids, total in sequence:
                for column, x in zip(out, (doc, start, length, _crc(ids, width) if digest else ids, total, sequence_id, offset)):
                    column.append(x)
                offset += length
            sequence_id += 1

        def flushed():
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            docs, (raw, at) = batch.column(0).to_pylist(), shared.buffer_of(batch.column(1))
            for first, last in shared.row_blocks(at, 2 << 20):
                whole, starts = encoder.ended(raw[at[first] : at[last]], at[first : last + 1] - at[first], end_id)
                width, stream, edges = whole.itemsize, whole.tobytes(), starts.tolist()
                for doc, begin, end in zip(docs[first:last], edges, edges[1:]):
                    total = end - begin
                    for start in range(0, total, capacity):
                        n = min(capacity, total - start)
                        piece = (doc, start, n, stream[(begin + start) * width : (begin + start + n) * width], total)
                        put([piece]) if n == capacity else pool.add(piece)
                    if pool.n >= POOL:
                        for sequence in pool.fill(False):
                            put(sequence)
                    if len(out[0]) >= 4096:
                        yield flushed()
        for sequence in pool.fill(True):
            put(sequence)
        yield flushed()

    return run


def _packed(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, digest: bool) -> DataFrame:
    shared.prepare(docs.sparkSession)
    schema = SCHEMA.replace("ids binary", "ids_crc32 long") if digest else SCHEMA
    return docs.select(F.col("doc_id").cast("long"), shared.text_bytes().alias("text")).mapInArrow(_packer(tokenizer, end_id, capacity, digest), schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """A row for each piece: doc_id, start (its document's ids before it), length, ids (2 bytes each where the vocabulary and `end_id` allow, else 4), doc_tokens, sequence_id, offset."""
    return _packed(docs, tokenizer, end_id, capacity, False)


def pack_digests(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """The rows of pack() with ids_crc32, of a piece's ids as 4-byte little-endian integers, in place of the ids: one pass in Python."""
    return _packed(docs, tokenizer, end_id, capacity, True)
