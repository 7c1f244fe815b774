"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits, each the majority of that bit in the XXH64 hashes of a text's word shingles. Two fingerprints
link at `distance` or fewer differing bits. Cut into `distance // 2 + 1` segments, two linked ones differ in at most one
bit of some segment; so each segment is indexed once for each of its bits, that bit taken out, and linked fingerprints
share a key. Keys are equality-joined and every candidate is verified. With many fingerprints keys take two or three of more
segments, with at most one differing bit in them together, so that buckets stay small.

Groups of copies: equal fingerprints are one row from the start. A first pass links each fingerprint only to the least of
its key's bucket; buckets whose members are then one component need no further look, and in the others only members of
different components are compared, one of each two of them on the left side. So a dense group of near copies
costs about its size, not its square, and no link between components is lost.

`keep_one` deduplicates by similarity of texts: those whose five-word shingles are alike to 0.8 (Jaccard). Both passes look up
the variants of a fingerprint of these shingles as above. As fingerprints of texts alike to just 0.8 may differ in ten bits, texts
also meet in bands of minima of hashes over the shingles (MinHash; BANDS of ROWS minima: 5 of 100,000 pairs of just 0.8 meet in
none, fewer above). For these a loose fingerprint of 128 bits sorts out the unlike, and what two texts differ from a central third
bounds what they have in common. Every link, by either index, is checked on the sets of shingles themselves, by 32-bit hashes.

Cases: null text counts as empty; a text without words has fingerprint zero and links like any other; fewer words than a
shingle give one shingle; repeated rows stay rows (keep_one() keeps one); a null doc_id has no part in naming components; an
empty table gives an empty result; other columns are not read, and keep_one() returns them whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BITS = 64


def fingerprint(text: bytes, shingle: int) -> int:
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    begins = np.concatenate([[0], ends[:-1] + 1])[: n - shingle + 1].tolist()
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(begins, ends[shingle - 1 :].tolist())), "<u8", len(begins))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text, shingle: int) -> F.Column:
    """Column of fingerprints as signed longs of a column of texts."""

    @F.arrow_udf("long")
    def of(texts):
        import pyarrow as pa

        raw, at = shared.buffer_of(texts)
        return pa.array(np.array([fingerprint(raw[at[i] : at[i + 1]].tobytes(), shingle) for i in range(len(texts))], np.uint64).view(np.int64))

    return of(text)


def segments(distance: int, chosen: int = 1) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments; of two fingerprints within `distance`, some `chosen` of them differ in at most one bit together."""
    n = distance * chosen // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return list(zip(edges, (b - a for a, b in zip(edges, edges[1:]))))


def chosen_for(n: int) -> int:
    """How many segments a key has: one up to 2^26 fingerprints, so that a key's bucket has 2^6; more beyond, as they make rarer keys but more of them."""
    return 1 if n <= 1 << 26 else 2 if n <= 1 << 30 else 3


def _without(part, bit):
    """`part` without one bit, a number or a column."""
    upper = F.call_function("shiftrightunsigned", part, F.lit(bit) + 1) if not isinstance(bit, int) else F.shiftrightunsigned(part, bit + 1)
    lower = part.bitwiseAND((1 << bit) - 1) if isinstance(bit, int) else part.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit) - 1)
    return (F.call_function("shiftleft", upper, bit) if not isinstance(bit, int) else F.shiftleft(upper, bit)) + lower


def variants(prints: DataFrame, distance: int, chosen: int = 1) -> DataFrame:
    """All columns and `key`: a row for each choice of segments and bit of them, of these segments of `fp` without that bit.

    Keys are numbered above 32 bits, by choice and bit.
    """
    lists, first = [], 0
    for some in combinations(segments(distance, chosen), chosen):
        part, size = F.lit(0).cast("long"), 0
        for low, width in some:
            bits = F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1)
            part, size = part + F.shiftleft(bits, size), size + width
        if chosen == 1:
            lists.append(F.array(*(F.lit(first + k << 32) + _without(part, k) for k in range(size))))
        else:  # as many expressions would be too much code
            number = lambda k, first=first: F.call_function("shiftleft", (F.lit(first) + k).cast("long"), F.lit(32))
            lists.append(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k, part=part: number(k) + _without(part, k)))
        first += size
    return prints.withColumn("key", F.explode(F.concat(*lists)))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node reachable over `links` (a, b), for each node with a link.

    Labels spread over links and jump to their labels' labels; each round is written to the shared folder.
    """
    edges = shared.staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
    labels = shared.staged(labels, "labels")
    while True:
        spread = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
        lower = spread.union(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        lower = lower.join(jump, "label", "left").select("node", F.coalesce(F.least("label", "next"), "label").alias("label"))
        lower = shared.staged(lower, "labels")
        if not lower.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count():
            return lower
        labels = lower


def near(a: str, b: str, distance: int) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


#: Members of a bucket that one task compares all its others with.
TILE = 1 << 14


def _across(members: DataFrame, others: DataFrame, key: list[str], distance: int, name: str) -> DataFrame:
    """(a, b): names of near members of a bucket that are in different components. Members of the least label meet all others; of two others, that of the lesser label stands on the left."""
    others = others.where("label <> lo").select(*key, F.col("fp").alias("fp2"), F.col("label").alias("label2"), F.col(name).alias("name2"))
    one_side = (F.col("label") == F.col("lo")) | (F.col("label") < F.col("label2"))
    found = members.join(others, key).where((F.col("label") != F.col("label2")) & one_side & near("fp", "fp2", distance))
    return found.select(F.col(name).alias("a"), F.col("name2").alias("b"))


def crossing(named: DataFrame, distance: int, chosen: int = 1, name: str = "label") -> DataFrame:
    """(a, b): names of the members of `named` (fp, label, and `name`) that are near and in different components, a row or more for each two.

    What a bucket's members have in common is found beside them by a window, so that no row is made for members that merely share a
    key. A bucket with more than TILE others is parted by a hash of these, and each part meets all members in a task of its own: the
    same pairs are compared, and no bucket is one task's work.
    """
    bucket, parts = Window.partitionBy("key"), int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = variants(named.repartition(parts, "fp"), distance, chosen)
    members = members.withColumns({"lo": F.min("label").over(bucket), "hi": F.max("label").over(bucket)}).where("lo < hi").drop("hi")
    members = members.withColumn("tiles", F.ceil(F.count_if(F.col("label") != F.col("lo")).over(bucket) / TILE).cast("int"))
    large = shared.staged(members.where("tiles > 1"), "large")
    spread = large.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    parted = large.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    small = members.where("tiles = 1")
    return _across(small, small, ["key"], distance, name).union(_across(spread, parted, ["key", "tile"], distance, name))


def classes(prints: DataFrame, distance: int, chosen: int = 1) -> DataFrame:
    """(fp, label) of distinct fingerprints `prints` (fp): label is the least fingerprint reachable."""
    bucket = Window.partitionBy("key")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spokes = variants(prints.repartition(parts, "fp"), distance, chosen).withColumn("hub", F.min("fp").over(bucket))
    spokes = spokes.where((F.col("fp") != F.col("hub")) & near("fp", "hub", distance))
    first = components(spokes.select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct())
    named = prints.join(first, prints.fp == first.node, "left").select("fp", F.coalesce("label", "fp").alias("label"))
    named = shared.staged(named, "named")
    second = components(shared.staged(crossing(named, distance, chosen).distinct(), "links"))
    return named.join(second, named.label == second.node, "left").select("fp", F.coalesce(second.label, named.label).alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 4, chosen: int | None = None) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the least doc_id reachable over links of fingerprints, for each row.

    `chosen`: segments in a key, by the number of rows if not given; the links are the same.
    """
    shared.prepare(docs.sparkSession)
    marked = shared.staged(docs.select(F.col("doc_id").cast("long"), fingerprints(shared.text_bytes(), shingle).alias("fp")), "fingerprints")
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = classes(prints.select("fp"), distance, chosen_for(marked.count()) if chosen is None else chosen)
    least = prints.join(named, "fp")
    smallest = least.groupBy("label").agg(F.min("least").alias("component_id"))
    table = shared.staged(least.join(smallest, "label").select("fp", "component_id"), "classes")
    return marked.join(table, "fp").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


#: Bands of minima over the shingles, and minima in each: pairs alike to s meet with a chance of 1 - (1 - s^ROWS)^BANDS.
BANDS, ROWS = 25, 5
#: Bits of 128 in which fingerprints of shingles may differ for a pair to be checked on its sets: at a similarity of 0.8, 19.4 with a
#: deviation of 4.1 are expected, so this is over five deviations above it.
ALIKE_BITS = 42
#: Bits of a map of the shingles in which a text and its hub differ.
MAP = 1024
#: Least similarity of two sets of shingles, as a ratio; the numbers of their shingles have no lower ratio.
ALIKE = (4, 5)

_RNG = np.random.default_rng(7)
_FLIPS, _TIMES = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) for _ in range(2))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of its ROWS minima and its number."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), 1 << 11):
        mixed = (high[None, i : i + (1 << 11)] ^ _FLIPS[:, None]) * (_TIMES | np.uint32(1))[:, None]
        least = np.minimum(least, mixed.min(axis=1))
    rows, keys = least.reshape(BANDS, ROWS).astype(np.uint64), np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = shared._mixed(keys * np.uint64(shared._BASE) + rows[:, k])
    return keys.view(np.int64)


def sketch(text: bytes, shingle: int = 5) -> tuple[int, int, int, int, np.ndarray, bytes]:
    """A hash of the set of shingles, its size, the two halves of its fingerprint, keys of its bands, and its members as sorted 32-bit hashes.

    Two shingles of a pair of texts of 500 share such a hash in 6 of 100,000 pairs, which then count one shingle more in common. Zeros and no keys without words. The fingerprint has 128 bits, each as more than half of the shingles' XXH3 have it.
    """
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    words = text.lower().split()
    if not words:
        return 0, 0, 0, 0, np.zeros(0, np.int64), b""
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    begins = np.concatenate([[0], ends[:-1] + 1])[: max(1, n - shingle + 1)].tolist()
    shingles = list({joined[a:b]: None for a, b in zip(begins, ends[min(shingle, n) - 1 :].tolist())})
    ones, hashes = np.zeros(128, np.int64), []
    for i in range(0, len(shingles), 1 << 14):
        block = np.frombuffer(b"".join(map(xxh3_128_digest, shingles[i : i + (1 << 14)])), np.uint8).reshape(-1, 16)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        hashes.append(block.view("<u8")[:, 0])
    g0, g1 = np.packbits(ones * 2 > len(shingles), bitorder="little").view("<i8").tolist()
    members = np.sort(np.concatenate(hashes))
    node, short = xxh3_64_intdigest(members.tobytes()), np.unique((members >> np.uint64(32)).astype(np.uint32))
    return node - (node >> 63 << 64), len(short), g0, g1, band_keys(members), short.tobytes()


def sketches(text, shingle: int) -> F.Column:
    @F.arrow_udf("struct<node:long,n:int,g0:long,g1:long,keys:array<long>,members:binary>")
    def of(texts):
        import pyarrow as pa

        raw, at = shared.buffer_of(texts)
        found = [sketch(raw[at[i] : at[i + 1]].tobytes(), shingle) for i in range(len(texts))]
        node, n, g0, g1, keys, members = map(list, zip(*found)) if found else ([] for _ in range(6))
        edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
        columns = [pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(g0, pa.int64()), pa.array(g1, pa.int64()), lists, pa.array(members, pa.binary())]
        return pa.StructArray.from_arrays(columns, ["node", "n", "g0", "g1", "keys", "members"])

    return of(text)


def differing(g0, g1, h0, h1) -> F.Column:
    return F.bit_count(F.col(g0).bitwiseXOR(F.col(h0))) + F.bit_count(F.col(g1).bitwiseXOR(F.col(h1)))


def likely(g0, g1, n, h0, h1, m) -> F.Column:
    return (F.least(n, m) * ALIKE[1] >= F.greatest(n, m) * ALIKE[0]) & (differing(g0, g1, h0, h1) <= ALIKE_BITS)


def _pairs_of(lefts, rights, kind: str):
    """Both sets of each row as sorted integers of a kind."""
    (a, at), (b, bt) = shared.buffer_of(lefts), shared.buffer_of(rights)
    for i in range(len(lefts)):
        yield np.frombuffer(a[at[i] : at[i + 1]].tobytes(), kind), np.frombuffer(b[bt[i] : bt[i + 1]].tobytes(), kind)


def sets_alike(left, right, alike: tuple[int, int] = ALIKE, kind: str = "<u4") -> F.Column:
    @F.arrow_udf("boolean")
    def of(lefts, rights):
        import pyarrow as pa

        out = []
        for x, y in _pairs_of(lefts, rights, kind):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both * alike[1] >= (len(x) + len(y) - both) * alike[0])
        return pa.array(out, pa.bool_())

    return of(left, right)


_WORDS = [f"w{k}" for k in range(MAP // 64)]


def differences(left, right, alike: tuple[int, int] = ALIKE, kind: str = "<u4") -> F.Column:
    """Of two sets: whether they are alike, in how many members they differ, a map of these by hash, and how many share a bit of it."""

    @F.arrow_udf(f"struct<alike:boolean,diff:int,extra:int,{','.join(f'{w}:long' for w in _WORDS)}>")
    def of(lefts, rights):
        import pyarrow as pa

        are, diff, maps = [], [], np.zeros((len(lefts), MAP), bool)
        for i, (x, y) in enumerate(_pairs_of(lefts, rights, kind)):
            other = np.setxor1d(x, y, assume_unique=True)
            both = (len(x) + len(y) - len(other)) // 2
            are.append(both * alike[1] >= (len(x) + len(y) - both) * alike[0])
            diff.append(len(other))
            other = other if kind == "<u4" else (other >> np.uint64(32)).astype(np.uint32)
            maps[i, (other * np.uint32(2654435761)) >> np.uint32(33 - MAP.bit_length())] = True
        words = np.packbits(maps, axis=1, bitorder="little").view("<i8").reshape(len(lefts), len(_WORDS))
        extra = np.array(diff, np.int32) - maps.sum(axis=1, dtype=np.int32)
        columns = [pa.array(are, pa.bool_()), pa.array(diff, pa.int32()), pa.array(extra, pa.int32()), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(len(_WORDS)))]
        return pa.StructArray.from_arrays(columns, ["alike", "diff", "extra", *_WORDS])

    return of(left, right)


def may_be_alike(a: str, b: str, alike: tuple[int, int] = ALIKE) -> F.Column:
    """False where two texts of one hub can't be alike: they differ in what both differ from the hub but for what these have in common.

    That is at most the bits which both maps have, and the members of one that share a bit. Texts of different hubs may be alike.
    """
    common = F.least(F.col(f"{a}.extra"), F.col(f"{b}.extra"))
    for w in _WORDS:
        common = common + F.bit_count(F.col(f"{a}.{w}").bitwiseAND(F.col(f"{b}.{w}")))
    least = F.col(f"{a}.diff") + F.col(f"{b}.diff") - 2 * common
    low, high = alike  # of n members in both together, alike sets differ in (high - low) / (high + low) n or fewer
    return (F.col(f"{a}.hub") != F.col(f"{b}.hub")) | (least * (high + low) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (high - low))


def with_sets(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """`pairs` (a, b) with a_members and b_members of `sets` (node, members). Only the sets of nodes in pairs are kept and joined."""
    some = shared.staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{name}-nodes")
    sets = shared.staged(sets.join(some, "node", "left_semi").dropDuplicates(["node"]), f"{name}-sets")
    left, right = (sets.select(F.col("node").alias(x), F.col("members").alias(f"{x}_members")) for x in "ab")
    return pairs.join(left, "a").join(right, "b")


def hubs(index: DataFrame) -> DataFrame:
    """(node, hub) of the nodes of `index` (key, node), whose keys have two nodes or more: the hub is the most central text near a node.

    A node's score is the number of others under its keys. A hub is the node of the highest score under the node's keys, or
    that one's hub, twice over; so the texts of a group of copies have the same hub, wherever their keys differ.
    """
    counts = index.groupBy("key").agg((F.count("*") - 1).alias("others"))
    scores = index.join(counts, "key").groupBy("node").agg(F.sum("others").alias("score"))
    scored = shared.staged(index.join(scores, "node"), "scored")
    best = scored.groupBy("key").agg(F.max(F.struct("score", "node")).alias("best"))
    found = shared.staged(scored.join(best, "key").groupBy("node").agg(F.max("best").getField("node").alias("hub")), "hubs")
    for _ in range(2):
        further = found.select(F.col("node").alias("hub"), F.col("hub").alias("next"))
        found = shared.staged(found.join(further, "hub").select("node", F.col("next").alias("hub")), "hubs")
    return found


def near_least(prints: DataFrame, distance: int, chosen: int = 1) -> DataFrame:
    """(a, b): each node of `prints` (node, fp), and of the least members of its buckets that are near to it the least of all."""
    bucket, parts = Window.partitionBy("key"), int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = variants(prints.repartition(parts, "fp"), distance, chosen).withColumn("least", F.min(F.struct("fp", "node")).over(bucket))
    found = found.withColumn("fp2", F.col("least.fp")).where((F.col("node") != F.col("least.node")) & near("fp", "fp2", distance))
    return found.groupBy(F.col("node").alias("a")).agg(F.min("least").getField("node").alias("b"))


#: Bits in which fingerprints of keep_one() may differ to be found by their variants.
DISTANCE = 4


def text_classes(marked: DataFrame) -> DataFrame:
    """(node, label) of the distinct sets of `marked` (node, n, g0, g1, keys, members): label is the least node reachable.

    Sets meet in variants of their fingerprint g0, and in keys of bands. The first pass checks each set against the least near
    one of its fingerprint's buckets, and against the hub of its bands. The second pass compares the members of a bucket or key
    that are in different components: by fingerprints those that are near, and by bands those that a bound leaves: of two with one
    hub, what each differs from it leaves nearly none but true links (2,234 pairs of 1,598,055 on a table with a group of 4,000
    copies, 1,645 of them links). What is left is checked on the sets. So a group of copies costs about its size in rows made, and
    no link between components is lost.
    """
    sets = marked.select("node", "members")
    prints = shared.staged(marked.select("node", "n", "g0", "g1", "keys").dropDuplicates(["node"]), "prints")
    index = prints.select(F.explode("keys").alias("key"), "node")
    index = shared.staged(index.join(index.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "key").select("key", "node"), "index")
    found, chosen = hubs(index), chosen_for(prints.count())
    by_print = near_least(prints.select("node", F.col("g0").alias("fp")), DISTANCE, chosen).withColumn("hub", F.lit(False))
    by_bands = found.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"), F.lit(True).alias("hub"))
    near_ = shared.staged(by_print.union(by_bands).groupBy("a", "b").agg(F.bool_or("hub").alias("hub")), "near")
    apart = with_sets(near_, sets, "hub")
    apart = shared.staged(apart.select("a", "b", "hub", differences("a_members", "b_members").alias("d")), "apart")
    first = components(apart.where("d.alike").select("a", "b"))
    apart = apart.where("hub")
    named = shared.staged(prints.select("node").join(first, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "named")
    open_ = index.join(named, "node")
    ends = open_.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    open_ = shared.staged(open_.join(ends, "key").select("key", "node", "label", "lo"), "open")
    none = [F.coalesce(F.col("d").getField(x), F.lit(0)).alias(x) for x in ("diff", "extra", *_WORDS)]
    facts = prints.select("node", "n", "g0", "g1").join(open_.select("node").distinct(), "node", "left_semi").join(found, "node").join(apart.select(F.col("a").alias("node"), "d"), "node", "left")
    facts = facts.select("node", F.struct("n", "g0", "g1", "hub", *none).alias("f"))
    members = shared.staged(open_.join(facts, "node"), "members")
    others = members.where("label <> lo").select("key", F.col("node").alias("b"), F.col("f").alias("g"), F.col("label").alias("label2"))
    one_side = (F.col("label") == F.col("lo")) | (F.col("label") < F.col("label2"))
    near_ = likely("f.g0", "f.g1", F.col("f.n"), "g.g0", "g.g1", F.col("g.n")) & may_be_alike("f", "g")
    across = members.join(others, "key").where((F.col("label") != F.col("label2")) & one_side & near_)
    near_ = crossing(prints.select("node", F.col("g0").alias("fp")).join(named, "node"), DISTANCE, chosen, "node")
    both = near_.union(across.select(F.col("node").alias("a"), "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = shared.staged(both.distinct(), "pairs")
    links = with_sets(pairs, sets, "pair").where(sets_alike("a_members", "b_members")).select("a", "b")
    links = links.join(named.toDF("a", "label"), "a").join(named.toDF("b", "label2"), "b")
    second = components(shared.staged(links.select(F.col("label").alias("a"), F.col("label2").alias("b")).distinct(), "links"))
    return named.join(second.toDF("label", "least"), "label", "left").select("node", F.coalesce("least", "label").alias("label"))


def grouped_texts(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, a hash of the text and node for each row, and (node, label) of text_classes()."""
    shared.prepare(docs.sparkSession)
    marked = docs.select(F.col("doc_id").cast("long"), F.xxhash64(shared.text_bytes()).alias("hash"), sketches(shared.text_bytes(), shingle).alias("s"))
    marked = shared.staged(marked.select("doc_id", "hash", "s.*"), "sketches")
    return marked.select("doc_id", "hash", "node"), shared.staged(text_classes(marked.drop("doc_id", "hash")), "classes")


def similar_texts(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id and component_id, the least doc_id of the row's group of texts alike to 0.8 or more in their shingles, for each row."""
    rows, named = grouped_texts(docs, shingle)
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least")).join(named, "node")
    table = least.join(least.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id")
    return rows.join(shared.staged(table, "groups"), "node").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of `docs` of each group of similar_texts(), with all columns as they are.

    It is the one of least (doc_id, hash of the text), null ids last. So a group without an id keeps a row too, and of different
    texts under one id each group keeps its own; of rows equal in both, any one.
    """
    rows, named = grouped_texts(docs, shingle)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "hash")
    kept = rows.join(named, "node").groupBy("label").agg(F.min(order).alias("kept")).select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.hash").alias("kept_hash"))
    marked = docs.select(F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(shared.text_bytes()).alias("hash"))
    found = marked.join(kept, F.col("kept_id").eqNullSafe(F.col("id")) & (F.col("kept_hash") == F.col("hash")), "left_semi")
    return found.dropDuplicates(["id", "hash"]).select("document.*")
