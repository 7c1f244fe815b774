"""Near copies by MinHash with fast similarity sketching.

A sketch has BANDS * WIDTH coordinates. In each round every shingle is thrown by a hash of the round into one coordinate with a
random value; a coordinate keeps the least value of the first round that reaches it. A text of many shingles fills all in a few
rounds. After as many rounds as coordinates, round k throws all shingles into coordinate k, so at most twice as many rounds fill
every coordinate, however few the shingles are. Two sets agree in a coordinate with a chance of their similarity, and the number of
coordinates in which they agree is concentrated around it, as each round spreads the shingles over the coordinates.

Sketches are cut into bands; sets that agree in a band share a key. At a similarity of 0.85 two sets agree in no band in 7 of ten
million cases. One bit of each coordinate sorts out the unlike that share a key, and every link is confirmed on the sets of 64-bit
shingle hashes, taken anew from the texts that need it.

Groups of copies: equal sets are one node from the start. A first pass checks each node against its hub alone, the most central
node near it; a second compares members of a key that are in different components, and of those with one hub only pairs that may
be alike by what each differs from the hub. So a group of near copies costs about its size in rows made, and no link between components is lost.

Cases: null text and a text without words have an empty set and are linked with nothing, not even each other; fewer words than a shingle give
one shingle; repeated rows stay rows and are linked; a null doc_id has no part in naming components, the component of such rows alone
is null, and a row with a null doc_id is not kept; very long texts are cut into shingles whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, simhash

#: Bands, and coordinates of each.
BANDS, WIDTH = 30, 6
SIZE = BANDS * WIDTH
#: Least similarity of linked sets, as a ratio.
ALIKE = (17, 20)
#: Bits of SIZE in which sketches may differ: at 0.85, 13.5 with a deviation of 3.5 are expected, so this is over six deviations above it.
ALIKE_BITS = 36
#: Bytes of texts that are sketched together.
BLOCK = 1 << 20

_TIMES = np.random.default_rng(13).integers(0, 1 << 63, 2 * SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = np.array([pow(shared._BASE, k, 1 << 64) for k in range(64)], np.uint64)


def shingle_hashes(raw: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, sorted, end to end, and how many each has."""
    starts, ends, counts = shared.word_spans(raw, at)
    words = shared.word_hashes(shared.lowered(raw), starts, ends)
    first = np.cumsum(counts) - counts
    h, texts = np.zeros(len(words), np.uint64), np.repeat(np.arange(len(counts)), counts)
    if len(words):
        place, size = np.arange(len(words)) - first[texts], np.minimum(counts, shingle)[texts]
        whole = place + size <= counts[texts]  # a shingle begins here
        padded = np.append(words, np.zeros(shingle, np.uint64))
        for k in range(shingle):
            part = padded[k : k + len(words)] * _ORDER[k + 1]
            h += np.where(k < size, part, np.uint64(0))
        h = shared._mixed(h + size.astype(np.uint64))[whole]
        texts = texts[whole]
        order = np.lexsort((h, texts))
        h, texts = h[order], texts[order]
        new = np.append(True, (h[1:] != h[:-1]) | (texts[1:] != texts[:-1]))
        h, texts = h[new], texts[new]
    return h, np.bincount(texts, minlength=len(counts)).astype(np.int64)


def sketches_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sketches (texts x SIZE) of sets that lie end to end; sets are not empty. A value tells its round too."""
    out = np.full(len(sizes) * SIZE, ~np.uint64(0))
    texts = np.repeat(np.arange(len(sizes)), sizes)
    live, h = texts, hashes
    for k in range(2 * SIZE):
        mixed = shared._mixed(h * _TIMES[k])
        if k < SIZE:
            place = live * SIZE + ((mixed >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64)
        else:
            place = live * SIZE + (k - SIZE)
        if k:
            free = empty[place]
            place, mixed = place[free], mixed[free]
        # the round stands above 48 random bits, so that earlier rounds are less
        np.minimum.at(out, place, np.uint64(k << 48) | (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)))
        empty = out == ~np.uint64(0)
        left = empty.reshape(-1, SIZE).any(axis=1)
        if not left.any():
            break
        going = left[live]
        live, h = live[going], h[going]
    return out.reshape(-1, SIZE)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of its coordinates and its number (texts x BANDS)."""
    parts = sketches.reshape(len(sketches), BANDS, WIDTH)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sketches), 1))
    for k in range(WIDTH):
        keys = shared._mixed(keys * np.uint64(shared._BASE) + parts[:, :, k])
    return keys.view(np.int64)


def bit_words(sketches: np.ndarray) -> np.ndarray:
    """One bit of each coordinate (texts x 3 longs)."""
    bits = np.zeros((len(sketches), 192), np.uint8)
    bits[:, :SIZE] = shared._mixed(sketches) & np.uint64(1)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def set_hashes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, never 0; 0 of an empty one."""
    from xxhash import xxh3_64_intdigest

    data, ends = hashes.tobytes(), np.cumsum(sizes)
    return np.array([(xxh3_64_intdigest(data[8 * (b - n) : 8 * b]) or 1) if n else 0 for b, n in zip(ends.tolist(), sizes.tolist())], np.uint64).view(np.int64)


def _blocks(texts):
    raw, at = shared.buffer_of(texts)
    for first, last in shared.row_blocks(at, BLOCK):
        yield raw[at[first] : at[last]], at[first : last + 1] - at[first]


SKETCH = ["node:long", "n:int", "b0:long", "b1:long", "b2:long", "keys:array<long>"]


def sketched(text, shingle: int) -> F.Column:
    """node (a hash of the set), n (its size), b0 to b2 (bits), keys (of bands; none of an empty set) of a column of texts as bytes."""

    @F.arrow_udf(f"struct<{','.join(SKETCH)}>")
    def of(texts):
        import pyarrow as pa

        node, n, bits, keys, many = [], [], [], [], []
        for raw, at in _blocks(texts):
            hashes, sizes = shingle_hashes(raw, at, shingle)
            full = sizes > 0
            found = sketches_of(hashes, sizes[full])
            words = np.zeros((len(sizes), 3), np.int64)
            words[full] = bit_words(found)
            node.append(set_hashes(hashes, sizes))
            n.append(sizes)
            bits.append(words)
            keys.append(band_keys(found).ravel())
            many.append(full * BANDS)
        flat = lambda parts, kind, *shape: np.concatenate([np.zeros((0, *shape), kind), *parts])
        edges = np.concatenate([[0], np.cumsum(flat(many, np.int64))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(flat(keys, np.int64)))
        b = flat(bits, np.int64, 3)
        columns = [pa.array(flat(node, np.int64)), pa.array(flat(n, np.int64).astype(np.int32)), *(pa.array(np.ascontiguousarray(b[:, k])) for k in range(3)), lists]
        return pa.StructArray.from_arrays(columns, [x.split(":")[0] for x in SKETCH])

    return of(text)


def members(text, shingle: int) -> F.Column:
    """The set of a text's shingles, sorted 64-bit hashes as bytes."""

    @F.arrow_udf("binary")
    def of(texts):
        import pyarrow as pa

        out = []
        for raw, at in _blocks(texts):
            hashes, sizes = shingle_hashes(raw, at, shingle)
            data, ends = hashes.tobytes(), np.cumsum(sizes)
            out += [data[8 * (b - n) : 8 * b] for b, n in zip(ends.tolist(), sizes.tolist())]
        return pa.array(out, pa.binary())

    return of(text)


def likely(f: str, g: str) -> F.Column:
    """Whether two texts may be alike by their sizes and bits."""
    differing = sum((F.bit_count(F.col(f"{f}.b{k}").bitwiseXOR(F.col(f"{g}.b{k}"))) for k in range(1, 3)), F.bit_count(F.col(f"{f}.b0").bitwiseXOR(F.col(f"{g}.b0"))))
    low, high = ALIKE
    return (F.least(f"{f}.n", f"{g}.n") * high >= F.greatest(f"{f}.n", f"{g}.n") * low) & (differing <= ALIKE_BITS)


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """`pairs` (a, b) with a_members and b_members of `sets` (node, members)."""
    left, right = (sets.select(F.col("node").alias(x), F.col("members").alias(f"{x}_members")) for x in "ab")
    return pairs.join(left, "a").join(right, "b")


def index_of(prints: DataFrame) -> DataFrame:
    """(key, node) of the keys that two nodes or more of `prints` have."""
    index = prints.select(F.explode("keys").alias("key"), "node")
    return shared.staged(index.join(index.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "key").select("key", "node"), "index")


def sets_of(rows: DataFrame, index: DataFrame, prints: DataFrame, shingle: int) -> DataFrame:
    """(node, members) of the nodes of `index`, from one text of each: only these are cut again. The join is alike at every size."""
    some = shared.staged(prints.join(index.select("node").distinct(), "node", "left_semi").select("node", F.col("one.doc_id").alias("id"), F.col("one.hash").alias("text_hash")), "wanted")
    texts = rows.select(F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_hash"), "text")
    texts = texts.join(some.hint("merge"), (F.col("row_hash") == F.col("text_hash")) & F.col("row_id").eqNullSafe(F.col("id")))
    return shared.staged(texts.select("node", members(F.col("text"), shingle).alias("members")).dropDuplicates(["node"]), "sets")


def text_classes(prints: DataFrame, index: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, label) of `prints` (node, n, b0 to b2; distinct nodes) by their index and sets: label is the least node reachable."""
    found = simhash.hubs(index)
    wide = dict(alike=ALIKE, kind="<u8")
    apart = with_sets(found.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")), sets)
    apart = shared.staged(apart.select("a", "b", simhash.differences("a_members", "b_members", **wide).alias("d")), "apart")
    first = simhash.components(apart.where("d.alike").select("a", "b"))
    named = shared.staged(prints.select("node").join(first, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "named")
    open_ = index.join(named, "node")
    ends = open_.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    open_ = shared.staged(open_.join(ends, "key").select("key", "node", "label", "lo"), "open")
    none = [F.coalesce(F.col("d").getField(x), F.lit(0)).alias(x) for x in ("diff", "extra", *simhash._WORDS)]
    facts = prints.select("node", "n", "b0", "b1", "b2").join(open_.select("node").distinct(), "node", "left_semi").join(found, "node").join(apart.select(F.col("a").alias("node"), "d"), "node", "left")
    facts = facts.select("node", F.struct("n", "b0", "b1", "b2", "hub", *none).alias("f"))
    both = shared.staged(open_.join(facts, "node"), "members")
    others = both.where("label <> lo").select("key", F.col("node").alias("b"), F.col("f").alias("g"), F.col("label").alias("label2"))
    one_side = (F.col("label") == F.col("lo")) | (F.col("label") < F.col("label2"))
    across = both.join(others, "key").where((F.col("label") != F.col("label2")) & one_side & likely("f", "g") & simhash.may_be_alike("f", "g", ALIKE))
    pairs = shared.staged(across.select(F.col("node").alias("a"), "b").distinct(), "pairs")
    links = with_sets(pairs, sets).where(simhash.sets_alike("a_members", "b_members", **wide)).select("a", "b")
    links = links.join(named.toDF("a", "label"), "a").join(named.toDF("b", "label2"), "b")
    second = simhash.components(shared.staged(links.select(F.col("label").alias("a"), F.col("label2").alias("b")).distinct(), "links"))
    return named.join(second.toDF("label", "least"), "label", "left").select("node", F.coalesce("least", "label").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links of alike sets, itself included) and kept, for each row."""
    spark = docs.sparkSession
    shared.prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_bytes().alias("text"))
    marked = shared.staged(rows.select("doc_id", F.xxhash64("text").alias("hash"), sketched(F.col("text"), shingle).alias("s")).select("doc_id", "hash", "s.*"), "sketches")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "hash")
    prints = marked.where("n > 0").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "b0", "b1", "b2", "keys")), F.min(order).alias("one"))
    prints = shared.staged(prints, "prints")
    index = index_of(prints)
    named = text_classes(prints, index, sets_of(rows, index, prints, shingle))
    least = marked.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(named, "node")
    table = least.join(least.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id")
    found = marked.select("doc_id", "n", "node").join(shared.staged(table, "groups"), "node", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
