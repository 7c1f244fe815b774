"""Hard negatives, aligned tokenizers and near copies against plain Python, on whole tables and on fixtures with odd rows."""

import collections
import hashlib
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyagree.llm import alignment, hard_negatives, minhash, queries, shared, simhash

from test_operators import ROWS, SCHEMA, lowered

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, label int, embedding array<float>, n_chars long, ids string, positives int"


# -- hard negatives


def mined(rows, every, positives, negatives, share=(50, 95, 100)):
    """All rows against all, in integers. rows: (id, label, vector), whose labels are as given."""
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= hard_negatives.LARGEST for x in v):
            continue
        if i not in best or (label, v) < best[i]:
            best[i] = (label, v)
    width = max((len(v) for _, v in best.values()), default=0)
    ints = {i: np.array([math.floor(256 * np.float64(np.float32(x))) for x in v] + [0] * (width - len(v)), object) for i, (_, v) in best.items()}
    out = set()
    for a in best:
        if a % every:
            continue
        scores = sorted(((int((ints[a] * ints[i]).sum()), i) for i in best if i != a), key=lambda x: (-x[0], x[1]))
        for p, i in [x for x in scores if best[x[1]][0] == best[a][0]][:positives]:
            window = [x for x in scores if best[x[1]][0] != best[a][0] and share[0] * p <= share[2] * x[0] <= share[1] * p]
            out |= {(a, i, rank, j, p, s) for rank, (s, j) in enumerate(window[:negatives], 1)}
    return out


def found(df):
    return {tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


def mine(rows, **more):
    return found(hard_negatives.mine(hard_negatives.usable(rows, "vec_id", "label", "embedding"), **more))


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
def test_hard_negatives_of_a_whole_table(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, list(r.embedding)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = queries.QUERIES["op11_hard_negatives"](spark, DATA)
    assert found(got) == mined(rows, 50, 5, 3) and got.count() > 50


def test_hard_negatives_of_odd_rows(spark):
    """Nulls, NaN, infinities, short and long vectors, repeats, ties, and one vector that a third of the rows have; blocks of a few rows."""
    rnd = random.Random(19)
    hot = [rnd.uniform(-1, 1) for _ in range(5)]
    rows = [(i, rnd.randint(0, 2), hot if i % 3 == 0 else [rnd.choice([0.0, 0.5, rnd.uniform(-1, 1)]) for _ in range(5)]) for i in range(300)]
    rows += [(300, None, hot), (301, 1, None), (302, 1, [None] * 5), (303, 1, [math.nan] * 5), (304, 1, [math.inf, 0.0, 0.0, 0.0, 0.0]), (None, 1, hot), (305, 1, []), (310, 1, [0.9, 0.9]), (311, 0, [1e9] * 5), (312, 2, [3000.0, -3000.0, 1.0, 1.0, 1.0]), (320, 1, [50000.0] * 5)]
    rows += [rows[3], rows[4], (5, 0, hot), (5, 2, [0.1] * 5), (-10, 1, hot)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(4)
    want = mined(rows, 10, 4, 2)
    assert mine(df, every=10, most_positives=4, most_negatives=2) == want and len(want) > 50
    assert mine(df, every=10, most_positives=4, most_negatives=2, sizes=(40, 3)) == want
    assert mine(df.where("vec_id < 0"), every=10) == set()
    assert mine(spark.createDataFrame([], VECTORS)) == set()


def test_bounds_hold_whatever_the_codebooks_are(spark):
    rnd = np.random.default_rng(3)
    rows, anchors = rnd.integers(-400, 400, (200, 10)), rnd.integers(-400, 400, (20, 10))
    for books in (hard_negatives.fit(rows), hard_negatives.fit(rows[:3] * 5), np.zeros((hard_negatives.PARTS, hard_negatives.CENTROIDS, 1), np.float32)):
        codes, residuals = hard_negatives.encode(rows, books)
        a = hard_negatives.Anchors(np.arange(20), np.zeros(20), anchors.astype(np.float64), books)
        low, high = a.bounds(codes, residuals)
        true = rows @ anchors.T
        assert (low <= true).all() and (high >= true).all()
    close = hard_negatives.fit(rows)
    codes, residuals = hard_negatives.encode(rows, close)
    low, high = hard_negatives.Anchors(np.arange(20), np.zeros(20), anchors.astype(np.float64), close).bounds(codes, residuals)
    assert (high - low).mean() < 0.2 * np.abs(true).mean() * 10  # they tell something


# -- aligned tokenizers


def byte_of():
    return {c: b for b, c in __import__("polyagree.llm.tokenizing", fromlist=["x"]).byte_characters().items()}


def aligned(rows):
    """One text at a time, pairs by their byte ranges."""
    import public_tokenizers as P
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_side, b_side, shown = Tokenizer.from_file(P.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), byte_of()
    a_side.encode_special_tokens = True
    texts = []
    for doc_id, t in rows:
        links, groups, a, b = [], [], [], []
        if t:
            a, b = a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)
            sides = [[bytes(shown[c] for c in a_side.id_to_token(x)) for x in a], [bytes([int(b_side.id_to_piece(x)[3:5], 16)]) if b_side.is_byte(x) else b_side.id_to_piece(x).replace("▁", " ").encode() for x in b]]
            if any(b"".join(s) != (" " + t).encode() for s in sides):
                a, b = [], []
        if a:
            ends = [np.cumsum([len(x) for x in s]).tolist() for s in sides]
            starts = [[0, *e[:-1]] for e in ends]
            links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if abs(i - j) < 60 + abs(len(a) - len(b)) and max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j])]
            for e in sorted(set(ends[0]) & set(ends[1])):
                n = [sum(x <= e for x in ends[k]) for k in (0, 1)]
                done = [sum(len(g[k]) for g in groups) for k in (0, 1)]
                groups.append((a[done[0] : n[0]], b[done[1] : n[1]]))
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        texts.append((doc_id, len(a), len(b), groups, links, hashlib.sha256(written.encode()).hexdigest() if a else ""))
    counts = collections.Counter(p for t in texts for p in set(t[4]))
    best = collections.Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    table = {(x, y, n) for (x, y), n in counts.items() if n == best[x]}
    return collections.Counter((i, n, m, len(g), len(l), sum(counts[p] == best[p[0]] for p in l), sum(counts[p] for p in l), h) for i, n, m, g, l, h in texts), table


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PARTS = [" ", "  ", "\n", "\t", "a", "Bc", "é", "'s", "don't", "12", "½", "x.", ", ", ".\n", " ", "　", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "中文", "ъ", "́", "\r\n", " the", "“", "_", "\x01", "\x00", "😀", "aaaaaaaa", "▁"]


def test_alignment_of_odd_texts(spark):
    import public_tokenizers as P

    rnd = random.Random(23)
    rows = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12)))) for i in range(700)] + [(1, None), (None, "x y"), (1, " "), (2, ""), (3, " ".join(rnd.choice(["the", "reading", "straße"]) for _ in range(900)))]
    rows += [rows[5], rows[5]]
    want, table = aligned(rows)
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, payload string, stripe int").repartition(3)
    assert collections.Counter(map(tuple, alignment.align(df, *paths).select(COLUMNS).collect())) == want
    assert {tuple(r) for r in alignment.best_pairs(df, *paths).collect()} == table
    for chunk, each in (((300, 50), 100), ((1, 7), 1), ((10**6, 50), 40)):  # many chunks, and stripes in several parts
        assert collections.Counter(map(tuple, alignment.align(df, *paths, chunk=chunk, each=each).select(COLUMNS).collect())) == want
    assert alignment.align(df.limit(0), *paths).count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
def test_alignment_of_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text is None or len(r.text) < 4000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    import public_tokenizers as P

    got = alignment.align(df, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    assert collections.Counter(map(tuple, got.select(COLUMNS).collect())) == aligned(rows)[0]
    assert queries.QUERIES["op12_alignment"](spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


# -- near copies

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall(lowered(text or ""))
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows):
    """All pairs: (doc_id, size, component, kept)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 20 * min(len(s), len(sets[j])) >= 17 * max(len(s), len(sets[j])):
                both = len(s & sets[j])
                if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                    parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return collections.Counter((d, len(s), least.get(top(i)), d is not None and d == least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near(df):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
def test_near_copies_of_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.QUERIES["op13_minhash"](spark, DATA).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == linked(rows)


def test_near_copies_of_odd_rows(spark):
    assert near(spark.createDataFrame(ROWS, SCHEMA).repartition(3)) == linked([(r[0], r[1]) for r in ROWS])
    assert near(spark.createDataFrame([], SCHEMA)) == collections.Counter()


def test_a_group_of_near_copies_at_the_bound(spark):
    """Copies of long and short texts with so many words changed that some pairs are just alike and others just not."""
    rnd, rows = random.Random(29), []
    for n in (7, 8, 12, 40, 200):
        base = [f"w{rnd.randint(0, 10**6)}" for _ in range(n + 4)]
        for _ in range(40):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, n // 40))):
                words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 10**6)}"
            if rnd.random() < 0.4:
                words = words[: len(words) - rnd.randint(0, 1 + n // 6)]
            rows.append((len(rows), " ".join(words).upper() if rnd.random() < 0.2 else "\n".join(words)))
    assert near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == linked(rows)


def test_sketches_agree_as_sets_are_alike():
    """Every coordinate fills, however few the members; agreement is near the similarity, and nearer than by independent minima."""
    rnd = np.random.default_rng(5)
    for n in (1, 2, 7, 60, 3000):
        both = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
        assert (minhash.sketches_of(np.sort(both), np.array([n])) != ~np.uint64(0)).all()
    errors = []
    for _ in range(60):
        common, one, two = (rnd.integers(0, 1 << 63, n, dtype=np.uint64) for n in (17, 2, 1))
        a, b = np.sort(np.append(common, one)), np.sort(np.append(common, two))
        s = minhash.sketches_of(np.concatenate([a, b]), np.array([len(a), len(b)]))
        errors.append((s[0] == s[1]).mean() - 17 / 20)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.5 * math.sqrt(0.85 * 0.15 / minhash.SIZE)
    assert (minhash.sketches_of(np.concatenate([a, a]), np.array([len(a)] * 2))[0] == minhash.sketches_of(a, np.array([len(a)]))[0]).all()


# -- buckets of near fingerprints


@pytest.mark.parametrize("tile", [3, 64, 1 << 14])
def test_large_buckets_are_parted_with_the_same_links(spark, monkeypatch, tile):
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    loose = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))) for _ in range(500)} | {rng.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1}
    prints = [x - (x >> 63 << 64) for x in loose]
    root = {x: x for x in prints}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, x in enumerate(prints):
        for y in prints[:i]:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= 4:
                a, b = sorted((top(x), top(y)))
                root[b] = a
    shared.prepare(spark)
    monkeypatch.setattr(simhash, "TILE", tile)
    got = {r.fp: r.label for r in simhash.classes(spark.createDataFrame([(x,) for x in prints], "fp long"), 4).collect()}
    assert got == {x: top(x) for x in prints} and 20 < len(set(got.values())) < 700


def test_fingerprints_find_near_copies_that_no_band_does(spark):
    """The pipeline's near copies: without keys of bands, texts of near fingerprints are found by the variants of these, and checked on their sets."""
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for _ in range(5):
            other = list(words)
            for i in rng.sample(range(400), rng.randrange(3)):
                other[i] = "x" + other[i]
            texts.append(" ".join(other))
    made = {s[0]: s for s in (simhash.sketch(t.encode()) for t in texts)}
    sets, root = {k: set(np.frombuffer(s[5], "<u4").tolist()) for k, s in made.items()}, {k: k for k in made}

    def alike(a, b):
        return len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and ((made[a][2] ^ made[b][2]) & (1 << 64) - 1).bit_count() <= simhash.DISTANCE

    while (after := {a: min(root[b] for b in made if a == b or alike(a, b)) for a in made}) != root:
        root = after
    shared.prepare(spark)
    rows = spark.createDataFrame([(k, s[1], s[2], s[3], [], bytearray(s[5])) for k, s in made.items()], "node long, n int, g0 long, g1 long, keys array<long>, members binary")
    got = {r.node: r.label for r in simhash.text_classes(shared.staged(rows, "test-marked")).collect()}
    assert got == root and 12 <= len(set(got.values())) < len(got)
