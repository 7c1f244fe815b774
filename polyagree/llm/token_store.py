"""Token ids in a content-addressed store.

A rolling hash over a window of ids cuts each document's stream into chunks, so equal passages give equal chunks wherever
they stand. A chunk is stored once under the digest of its bytes; a document is a recipe, the list of its chunks' digests,
with the root of a Merkle tree over them. Recipes lie in ascending order of document ids. Reading back checks each chunk
against its digest, each recipe against its root and its chunks' lengths, and the recipes against the manifest.

Layout under the store's folder (Parquet, zstd):
  objects/kind=chunk   digest, payload (ids, little-endian, 2 bytes each if the vocabulary allows, else 4)
  objects/kind=recipe  as the tasks made them
  recipes              part, doc_id, row, n_tokens, root, chunks (digest, tokens after the chunk), sorted by doc_id
  manifest             part, first and last doc_id, documents, tokens, Merkle root over the part's roots

Cases: null text counts as empty and has only the end id; repeated rows and repeated doc_ids stay rows of their own, which
follow each other by root; a null doc_id comes first; an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .tokenizing import Encoder

#: Ids under the rolling hash; the chance of a cut at an id is one of 2^CUT_BITS; chunks but a document's last have these sizes.
WINDOW, CUT_BITS, LEAST, MOST = 16, 9, 64, 4096
DIGEST = 16
MANIFEST = "part int, first_doc long, last_doc long, documents long, tokens long, root binary"
MADE = "kind string, digest binary, payload binary, doc_id long, row long, n_tokens long, root binary, chunks array<struct<digest:binary,after:long>>"


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; a node without a sibling moves up as it is."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _gear(size: int) -> np.ndarray:
    return (shared._mixed(np.arange(size, dtype=np.uint64) + np.uint64(7)) >> np.uint64(32)).astype(np.uint32)


def rolling(ids: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW ids that end at each place, summed by doubling."""
    h, width = gear[ids], 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def cuts(hashes: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document, within it. What a cut depends on lies in its own chunk's document."""
    found = np.flatnonzero(hashes >> np.uint32(32 - CUT_BITS) == 0)
    spans = np.searchsorted(found, starts)
    out = []
    for i in range(len(starts) - 1):
        n, last, ends = int(starts[i + 1] - starts[i]), 0, []
        for at in [*(found[spans[i] : spans[i + 1]] - starts[i] + 1).tolist(), n]:
            while at - last > MOST:
                last += MOST
                ends.append(last)
            if at == n or at - last >= LEAST and at >= WINDOW:
                ends.append(at)
                last = at
                if at == n:
                    break
        out.append(ends)
    return out


def _make(tokenizer: str, end_id: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = Encoder.of(tokenizer)
        gear = _gear(max(encoder.tokenizer.get_vocab_size(), end_id + 1))
        link = pa.struct([("digest", pa.binary()), ("after", pa.int64())])
        schema = pa.schema([("kind", pa.string()), ("digest", pa.binary()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("chunks", pa.list_(link))])
        row, seen = TaskContext.get().partitionId() << 40, set()

        def rows(kind, **columns):
            n = len(columns["digest"])
            return pa.RecordBatch.from_arrays([pa.array([kind] * n) if f.name == "kind" else columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        for batch in batches:
            raw, at = shared.buffer_of(batch.column(1))
            for first, last in shared.row_blocks(at, 2 << 20):
                whole, starts = encoder.ended(raw[at[first] : at[last]], at[first : last + 1] - at[first], end_id)
                n, width, stream = last - first, whole.itemsize, whole.tobytes()
                ends = cuts(rolling(whole, gear), starts)
                many = np.array([len(x) for x in ends])
                inner = np.array([e for x in ends for e in x], np.int64)
                edges = (inner + np.repeat(starts[:-1], many)) * width
                names = [digest(stream[a:b]) for a, b in zip([0, *edges[:-1].tolist()], edges.tolist())]
                of = np.concatenate([[0], np.cumsum(many)]).tolist()
                fresh = []
                for k, name in enumerate(names):
                    if name not in seen:
                        seen.add(name)
                        fresh.append(k)
                begins = np.append(0, edges[:-1])
                yield rows("chunk", digest=pa.array([names[k] for k in fresh], pa.binary()), payload=pa.array([stream[begins[k] : edges[k]] for k in fresh], pa.binary()))
                numbers = np.arange(row, row + n)
                links = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(np.repeat(np.diff(starts), many) - inner)], fields=list(link))
                yield rows(
                    "recipe",
                    digest=pa.array([digest(int(x).to_bytes(8, "little")) for x in numbers], pa.binary()),
                    doc_id=batch.column(0).slice(first, n),
                    row=pa.array(numbers),
                    n_tokens=pa.array(np.diff(starts)),
                    root=pa.array([merkle_root(names[i:j]) for i, j in zip(of, of[1:])], pa.binary()),
                    chunks=pa.ListArray.from_arrays(pa.array(np.array(of, np.int32)), links, type=pa.list_(link)),
                )
                row += n

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> str:
    """Write the store of all documents (doc_id, text) to the folder `path` and return it.

    Tasks drop the chunks they have seen; the rest meet in one shuffle by digest, where each is kept once.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    made = docs.select(F.col("doc_id").cast("long"), shared.text_bytes().alias("text")).mapInArrow(_make(tokenizer, end_id), MADE)
    others = [c for c in made.columns if c not in ("kind", "digest")]
    once = made.groupBy("kind", "digest").agg(*(F.first(c).alias(c) for c in others))
    once.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/objects")
    recipes = spark.read.schema(once.schema).parquet(f"{path}/objects").where("kind = 'recipe'")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = recipes.select("doc_id", "row", "n_tokens", "root", "chunks").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "root", "row")
    ordered.select(F.spark_partition_id().alias("part"), "*").write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest(spark, path).write.option("compression", "zstd").parquet(f"{path}/manifest")
    return path


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each part of the recipes, made from them: its span, totals and Merkle root over the roots in order."""

    def run(batches):
        import pyarrow as pa

        found: dict = {}
        for b in batches:
            for p, d, n, r in zip(*(b.column(i).to_pylist() for i in range(4))):
                x = found.setdefault(p, [d, d, 0, 0, []])
                x[1], x[2], x[3] = d, x[2] + 1, x[3] + n
                carry, level = r, 0
                while level < len(x[4]) and x[4][level] is not None:
                    carry, x[4][level] = digest(b"\x01" + x[4][level] + carry), None
                    level += 1
                x[4][level : level + 1] = [carry]
        for p, (lo, hi, n, t, tree) in found.items():
            top = None
            for x in tree:
                top = x if top is None else top if x is None else digest(b"\x01" + x + top)
            yield pa.RecordBatch.from_pydict({"part": [p], "first_doc": [lo], "last_doc": [hi], "documents": [n], "tokens": [t], "root": [top]}, pa.schema([("part", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64()), ("root", pa.binary())]))

    rows = read_recipes(spark, path).select("part", "doc_id", "n_tokens", "root", "row")
    return rows.repartition("part").sortWithinPartitions("part", "doc_id", "root", "row").select("part", "doc_id", "n_tokens", "root").mapInArrow(run, MANIFEST)


def checked_parts(spark: SparkSession, path: str) -> DataFrame:
    """part and its tokens, of the stored manifest; reading a row fails where the recipes are not as it says."""
    stored = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    both = stored.select("part", F.struct(*stored.columns).alias("s")).join((made := manifest(spark, path)).select("part", F.struct(*made.columns).alias("m")), "part", "full")
    wrong = F.raise_error(F.format_string("part %d of the recipes is not as the manifest says", "part"))
    return both.select("part", F.when(F.col("s").eqNullSafe(F.col("m")), F.col("s.tokens")).otherwise(wrong).alias("tokens"))


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, doc_id long, row long, n_tokens long, root binary, chunks array<struct<digest:binary,after:long>>").parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, digest binary, payload binary").parquet(f"{path}/objects").where("kind = 'chunk'").select("digest", "payload")


def _times_x(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo crc32's, lowest power in the highest bit."""
    out, a, b = np.zeros(len(a), np.uint64), a.astype(np.uint64), b.astype(np.uint64)
    for i in range(32):
        out ^= np.where(a >> np.uint64(31 - i) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ np.uint64(0xEDB88320), b >> np.uint64(1))
    return out


def shifted_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a crc32 adds, by exclusive or, to that of a string in which `after` bytes follow."""
    power = np.full(1, 1 << 23, np.uint64)  # x^8: one byte
    out, left = crc.astype(np.uint64), after.astype(np.int64)
    while (left > 0).any():
        odd = (left & 1) == 1
        out[odd] = _times_x(np.broadcast_to(power, int(odd.sum())), out[odd])
        power, left = _times_x(power, power), left >> 1
    return out


def chunk_facts(spark: SparkSession, path: str, width: int) -> DataFrame:
    """digest, number of ids and their crc32 as 4-byte integers, from each stored chunk, which is checked against its digest."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            names, payloads = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name, payload in zip(names, payloads):
                if digest(payload) != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
            crcs = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in payloads]
            yield pa.RecordBatch.from_pydict({"digest": names, "n": [len(x) // width for x in payloads], "crc": crcs}, pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())]))

    return read_chunks(spark, path).mapInArrow(run, "digest binary, n long, crc long")


def read_back(spark: SparkSession, path: str, width: int) -> DataFrame:
    """doc_id, row, part, start, n_tokens and ids_crc32 of each document, from the stored files.

    Recipes meet their chunks' facts, not the ids: a document's crc32 is an exclusive or of what its chunks add to it.
    It fails where a recipe does not have its root, a chunk is missing or of another length, or the manifest says otherwise.
    """
    facts = chunk_facts(spark, path, width)

    @F.arrow_udf("long")
    def adds(crc, after):
        import pyarrow as pa

        return pa.array(shifted_crc(crc.to_numpy(zero_copy_only=False), after.to_numpy(zero_copy_only=False) * 4).astype(np.int64))

    @F.arrow_udf("binary")
    def rooted(chunks, root):
        import pyarrow as pa

        for names, r in zip(chunks.to_pylist(), root.to_pylist()):
            if merkle_root(names) != r:
                raise ValueError("a recipe does not have its root")
        return pa.array(root, pa.binary())

    names = ["part", "doc_id", "row", "root", "n_tokens"]
    upto = lambda i: F.when(i == 0, F.col("n_tokens")).otherwise(F.get("chunks", i - 1).getField("after"))
    lengths = F.transform("chunks", lambda c, i: F.struct(c.digest.alias("digest"), c.after.alias("after"), (upto(i) - c.after).alias("length")))
    recipes = read_recipes(spark, path).select("part", "doc_id", "row", rooted("chunks.digest", "root").alias("root"), "n_tokens", lengths.alias("chunks"))
    entries = recipes.select(*names, F.explode("chunks").alias("c")).select(*names, "c.*")
    wrong = F.raise_error(F.concat(F.lit("a chunk is missing, or not as long as a recipe says: "), F.hex("digest")))
    joined = entries.join(facts, "digest", "left").withColumn("n", F.when(F.col("n") == F.col("length"), F.col("n")).otherwise(wrong))
    found = joined.select(*names, "n", adds("crc", "after").alias("add"))
    found = found.groupBy(*names).agg(F.sum("n").alias("sum"), F.expr("bit_xor(add)").alias("ids_crc32"))
    short = F.raise_error(F.concat(F.lit("the chunks of a document are not its n_tokens: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("no id"))))
    found = found.withColumn("n_tokens", F.when(F.col("sum") == F.col("n_tokens"), F.col("n_tokens")).otherwise(short)).drop("sum")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = checked_parts(spark, path).select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))  # as many rows as parts
    inside = Window.partitionBy("part").orderBy("doc_id", "root", "row").rowsBetween(Window.unboundedPreceding, -1)
    return found.join(sums, "part").select("doc_id", "row", "part", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def reconstruct(spark: SparkSession, path: str, width: int) -> DataFrame:
    """doc_id, row and ids (array) of each document: the round trip, for spot checks; a document's ids meet in one row."""
    entries = read_recipes(spark, path).select("doc_id", "row", "root", F.posexplode("chunks").alias("k", "c")).select("doc_id", "row", "root", "k", "c.digest")
    rows = entries.join(read_chunks(spark, path), "digest").groupBy("doc_id", "row", "root").agg(F.sort_array(F.collect_list(F.struct("k", "digest", "payload"))).alias("x"))

    @F.arrow_udf("array<long>")
    def joined(x, root):
        import pyarrow as pa

        out = []
        for chunks, r in zip(x.to_pylist(), root.to_pylist()):
            if merkle_root([c["digest"] for c in chunks]) != r:
                raise ValueError("a recipe does not have its root")
            out.append(np.frombuffer(b"".join(c["payload"] for c in chunks), f"<u{width}").astype(np.int64))
        return pa.array(out, pa.list_(pa.int64()))

    return rows.select("doc_id", "row", joined("x", "root").alias("ids"))
