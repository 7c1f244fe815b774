"""Each operator on a small table with nulls, empty and long texts, ties, repeated rows, and clashing extra columns; and on an empty one."""

import collections
import hashlib
import io
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyagree.llm import langid, licenses, lm, media, mixing, packing, quality_fm, quality_rules, queries, shared, simhash, token_store, tokenizing
from polyagree.llm.tokenizing import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, label int, fp long, size long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def made():
    rnd = random.Random(3)
    vocabulary = {lang: ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(80)] for lang, letters in {"en": "abcdefgh", "de": "mnopqßüä", "fr": "rstuvéèç"}.items()}
    texts = []
    for i in range(90):
        lang = ["en", "de", "fr"][i % 3]
        texts.append((" ".join(rnd.choice(vocabulary[lang]) for _ in range(rnd.randint(5, 60))).capitalize() + ".", lang))
    texts += [(texts[0][0], "en"), (texts[0][0] + "\n" + texts[3][0], "en"), (None, "en"), ("", None), ("  \n\t ", "de"), ("Line one here.\nLine one here.\n\n  Released under the MIT License, and the mit license.", "en")]
    texts += [("a b c d e f a b c d e f a b c d e", "en"), ("### *** $$$ &&& ||| ### *** $$$ &&& |||", "en"), ("<|endoftext|> İK straße   　中文 x\u0000y", None), ("12 34 !!", "en")]
    texts += [(" ".join(rnd.choice(vocabulary["en"]) for _ in range(30000)), "en")]
    rows = [(i, t, lang, [None, "src0", "src0", "src1", "src2"][i % 5], i, i, "k", 1, 5, 7) for i, (t, lang) in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "without an id at all", "en", "src1", 1, 1, None, None, None, None)]
    return rows


ROWS = made()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(rows, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in rows)


def lowered(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def ids_of(text, end):
    return tokenizer_.encode(text or "", add_special_tokens=False).ids + [end]


tokenizer_ = tokenizer()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


PARTS = [" ", "  ", "\n", "\n\n", " \n", "\t", "\t\t", "a", "Bc", "é", "'s", "'", "'re", "'ll", "l", "e", "don't", "12", "½", "²", "x.", ", ", ". ", ".\n", "...", "\u00a0", "\u3000", "<|endoftext|>", "中文", "ъ", "́", "١", "\r\n", "\x1c", "\x85", " the", "!!", "&&&", "“", "—", "×", "»", "İ", "_", "\x01", "😀", "aaaaaaaaaaaa", "x" * 50]


def test_encoder_equals_the_library(monkeypatch):
    encoder, rnd = Encoder(queries.tokenizer_path()), random.Random(1)

    def same(texts):
        raw = [t.encode() for t in texts]
        ids, n = encoder.encode_buffer(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
        for text, got in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
            assert got.tolist() == tokenizer_.encode(text, add_special_tokens=False).ids, repr(text)

    same(["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 9))) for _ in range(20000)])
    for t in ("plain text, it's only ASCII", "x", "\n a", "tab\tand  two ", "'s 'tis o'll"):
        same([t])
    monkeypatch.setattr(tokenizing, "BLOCK", 300)
    monkeypatch.setattr(tokenizing, "PARTED", 500)
    same([" ".join(rnd.choice(["the", "reading", "straße", "a", "x.", "»a", "12", "don't", "“q”"]) for _ in range(3000)) for _ in range(5)])
    monkeypatch.setattr(tokenizing, "REMEMBERED", 50)  # forgets all the time
    same(["".join(rnd.choice(PARTS) for _ in range(40)) for _ in range(300)])


def test_encoder_bears_hashes_that_collide(monkeypatch):
    encoder, texts = Encoder(queries.tokenizer_path()), ["one two three", "four five", "one five"]
    monkeypatch.setattr(Encoder, "_hashes", lambda self, raw, starts, ends: (ends - starts).astype(np.uint64))
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(encoder.encode(t.encode()), np.uint16).tolist() == tokenizer_.encode(t, add_special_tokens=False).ids


def test_token_store(spark, docs, empty):
    path = token_store.write(docs, shared.new_folder(spark, "t"), queries.tokenizer_path(), 2)
    got = token_store.read_back(spark, path, 2).collect()
    want = [(r[0], len(ids_of(r[1], 2)), crc(ids_of(r[1], 2))) for r in ROWS]
    assert by_row(got, "doc_id", "n_tokens", "ids_crc32") == collections.Counter(want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    back = token_store.reconstruct(spark, path, 2).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in back) == collections.Counter((r[0], tuple(ids_of(r[1], 2))) for r in ROWS)
    chunks = token_store.read_chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert token_store.manifest(spark, path).agg(F.sum("documents")).first()[0] == len(ROWS)
    path = token_store.write(empty, shared.new_folder(spark, "t"), queries.tokenizer_path(), 2)
    assert token_store.read_back(spark, path, 2).count() == 0


def test_a_damaged_token_store_is_not_read(spark):
    rnd = random.Random(13)
    texts = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randint(0, 99)) for _ in range(2000))) for i in range(6)]
    path = token_store.write(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), shared.new_folder(spark, "t"), queries.tokenizer_path(), 2)
    recipes, manifest = token_store.read_recipes(spark, path), spark.read.parquet(f"{path}/manifest")
    objects = spark.read.parquet(f"{path}/objects")
    assert manifest.agg(F.sum("documents"), F.sum("tokens")).first() == (6, recipes.agg(F.sum("n_tokens")).first()[0])
    lost, one = token_store.read_chunks(spark, path).first().digest, F.col("doc_id") == 3

    def read(objects=objects, recipes=recipes, manifest=manifest):
        other = shared.new_folder(spark, "t")
        objects.write.partitionBy("kind").parquet(f"{other}/objects")
        recipes.write.parquet(f"{other}/recipes")
        manifest.write.parquet(f"{other}/manifest")
        return token_store.read_back(spark, other, 2).select("doc_id", "start", "n_tokens", "ids_crc32").collect()

    assert len(read()) == 6
    for damage, says in (
        ({"objects": objects.where(F.col("digest") != F.lit(bytes(lost)))}, "a chunk is missing"),
        ({"recipes": recipes.withColumn("chunks", F.when(one, F.reverse("chunks")).otherwise(F.col("chunks")))}, "does not have its root"),
        ({"recipes": recipes.withColumn("n_tokens", F.col("n_tokens") + one.cast("long"))}, "not as long as|manifest|not its n_tokens"),
        ({"recipes": recipes.where(~one)}, "manifest"),
        ({"manifest": manifest.withColumn("root", F.lit(b"0" * 16))}, "manifest"),
    ):
        with pytest.raises(Exception, match=says):
            read(**damage)


def test_chunks_follow_content():
    gear, rnd = token_store._gear(1000), np.random.default_rng(0)
    a = rnd.integers(0, 1000, 20000)
    b = np.concatenate([rnd.integers(0, 1000, 777), a])
    cut = lambda x: token_store.cuts(token_store.rolling(x, gear), np.array([0, len(x)]))[0]
    pieces = lambda x: {x[i:j].tobytes() for i, j in zip([0, *cut(x)], cut(x))}
    assert len(pieces(a) & pieces(b)) > 0.8 * len(pieces(a))
    assert max(np.diff([0, *cut(np.zeros(50000, int))])) <= token_store.MOST


def test_packing(docs, empty):
    got = packing.pack_digests(docs, queries.tokenizer_path(), 0, 1024).collect()
    ids = {(r.doc_id, r.start, r.sequence_id, r.offset): bytes(r.ids) for r in packing.pack(docs, queries.tokenizer_path(), 0, 1024).collect()}
    assert all(zlib.crc32(np.frombuffer(ids[r.doc_id, r.start, r.sequence_id, r.offset], "<u2").astype("<u4").tobytes()) == r.ids_crc32 for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert sum(r.length for r in got) == sum(len(ids_of(r[1], 0)) for r in ROWS)
    want = {r[0]: ids_of(r[1], 0) for r in ROWS}
    for r in got:
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length])
    assert packing.pack(empty, queries.tokenizer_path(), 0).count() == 0


def test_closest_fill_is_closest():
    rnd = random.Random(2)
    for _ in range(200):
        lengths = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))]
        used = packing.closest_fill(collections.Counter(lengths), 40)
        assert all(n <= lengths.count(k) for k, n in used.items()) and max(lengths) in used
        sums = {max(lengths)}
        rest = sorted(lengths)[:-1]
        for x in rest:
            sums |= {s + x for s in sums if s + x <= 40}
        assert sum(k * n for k, n in used.items()) == max(sums)


def brute_components(rows, shingle, distance):
    prints = [(r[0], simhash.fingerprint((r[1] or "").encode(), shingle)) for r in rows]
    label = list(range(len(prints)))
    for _ in prints:
        before = list(label)
        for i, (_, a) in enumerate(prints):
            label[i] = min(label[j] for j, (_, b) in enumerate(prints) if (a ^ b).bit_count() <= distance)
        if label == before:
            break
    least = {}
    for (doc, _), k in zip(prints, label):
        if doc is not None:
            least[k] = min(doc, least.get(k, doc))
    return collections.Counter((doc, p - (1 << 64) if p >> 63 else p, least.get(k)) for (doc, p), k in zip(prints, label))


def test_simhash(spark, docs, empty):
    rnd = random.Random(4)
    near = [" ".join(rnd.choice("abcdefgh") + str(i) for i in range(300)) for _ in range(1)]
    rows = [*ROWS, *((1000 + i, " ".join(["x" if j == i else w for j, w in enumerate(near[0].split())]), "en", None, 1, 1, None, 1, 1, 1) for i in range(40))]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), 4, 4).collect()
    assert by_row(got, "doc_id", "fp", "component_id") == brute_components(rows, 4, 4)
    assert by_row(simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 4, 4, chosen=2).collect(), "doc_id", "component_id") == by_row(got, "doc_id", "component_id")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == kept.select("doc_id").distinct().count()
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_similar_texts(spark):
    """Groups of copies with a few words changed stay together, whatever two of the words changed; others stay apart."""
    rnd, rows, group = random.Random(9), [], {}
    words = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    for g in range(30):
        base = [rnd.choice(words) + rnd.choice(words) for _ in range(rnd.choice([120, 400, 1500]))]
        for k in range(6):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), len(copy) // 100 if k else 0):
                copy[at] = rnd.choice(words)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "two"), (906, "x " * 200000), (None, "one")]
    found = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(found) == len(rows)
    least = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    for doc, g in group.items():
        assert least[doc] == 6 * g
    assert [least[i] for i in range(900, 907)] == [900, 900, 900, 903, 903, 905, 906]


def test_shortened_and_extended_copies_meet(spark):
    """Of texts of all lengths and their copies cut or carried on at the end, those alike to 0.8 to 0.9 are linked, and none below 0.8."""
    rnd, rows, sets = random.Random(12), [], []
    words = [a + b for a in "abcdefghijklmnop" for b in "qrstuvwxyz"]
    for k in range(400):
        n = rnd.choice([rnd.randint(25, 60), rnd.randint(60, 150), rnd.randint(150, 1000), rnd.randint(1000, 3000)])
        base = [rnd.choice(words) + rnd.choice(words) for _ in range(n)]
        alike = rnd.choice([0.74, 0.77, 0.81, 0.82, 0.86, 0.9])
        shorter = base[: 4 + round(alike * (n - 4))]
        for part in (base, shorter) if k % 2 else (shorter, base):
            sets.append({tuple(part[i : i + 5]) for i in range(len(part) - 4)})
            rows.append((len(rows), " ".join(part)))
    found = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    least = {r.doc_id: r.component_id for r in found}
    for i in range(0, len(rows), 2):
        both = len(sets[i] & sets[i + 1])
        assert (least[i + 1] == i) == (5 * both >= 4 * len(sets[i] | sets[i + 1])), (len(sets[i]), len(sets[i + 1]), both)


def test_each_group_keeps_one_row_whatever_its_ids(spark):
    """Groups of rows without an id keep a row, and so does each of different texts under one id."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(None, a), (None, a), (None, b), (1, b), (2, c), (2, d), (2, d), (None, None), (None, ""), (3, e), (0, e + " z")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert collections.Counter((r.doc_id, r.text or "") for r in kept) == collections.Counter([(None, a), (1, b), (2, c), (2, d), (None, ""), (0, e + " z")])


def test_a_large_group_of_copies_loses_no_link(spark):
    """Copies of a short text with none to eight words changed: components equal those of all pairs alike to 0.8, and few pairs are made."""
    rnd = random.Random(21)
    words = [a + b for a in "abcdefghijklmnop" for b in "qrstuvwxyz"]
    rows, bases = [], [[rnd.choice(words) + rnd.choice(words) for _ in range(n)] for n in (70, 150)]
    for base in bases:
        for _ in range(150):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), rnd.randint(0, 8)):
                copy[at] = rnd.choice(words) + rnd.choice(words)
            rows.append((len(rows), " ".join(copy)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    label = list(range(len(rows)))
    near = [[j for j, b in enumerate(sets) if 9 * len(a & b) >= 4 * (len(a) + len(b))] for a in sets]
    while (after := [min(label[j] for j in near[i]) for i in range(len(rows))]) != label:
        label = after
    found = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(label))


def test_names_of_other_columns_do_not_matter(spark, docs):
    names = ["document", "p", "score", "id", "hash", "kept_id", "key", "size", "times", "label", "source_", "epochs", "__score", "__lang", "__hash", "text_hash", "w"]
    rows = docs.where("doc_id < 40").select("doc_id", "text", "lang", "source", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    want = set(rows.columns)
    for out in (quality_fm.accepted(rows, quality_fm.train(rows, labels), 0.0), langid.accepted(rows, langid.train(rows)), simhash.keep_one(rows), mixing.mixed_documents(rows)):
        got = out.collect()
        assert set(out.columns) == want and got and all(r[n] == i for r in got for i, n in enumerate(names))
    for out in (mixing.mix(rows), simhash.near_duplicates(rows), quality_rules.judge(rows), licenses.scan(rows), media.store(rows)):
        assert out.count() == rows.count()


def test_hash_sample_is_bounded_and_reruns_agree(spark):
    ids = spark.range(20000).select((F.col("id") % 3000).alias("doc_id"))
    one, two = (sorted(r.doc_id for r in shared.hash_sample(ids.repartition(n), 1000, 6).collect()) for n in (3, 7))
    assert one == two and 500 < len(one) <= 2000
    hot = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"))
    assert len({tuple(sorted(r.doc_id for r in shared.hash_sample(hot.repartition(n), 100, 6).collect())) for n in (2, 5)}) == 1


@pytest.mark.parametrize("chosen", [1, 2, 3])
def test_linked_fingerprints_share_a_variant(spark, chosen):
    rnd, rows = random.Random(5), []
    for i in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(1, 4)):
            b ^= 1 << bit
        rows += [(i, x - (1 << 64) if x >> 63 else x) for x in (a, b)]
    keys = simhash.variants(spark.createDataFrame(rows, "i long, fp long").repartition(8), 4, chosen)
    assert keys.groupBy("i", "key").count().where("count > 1").select("i").distinct().count() == 300


def base_rules(text):
    words = WORD.findall(text or "")
    spots = collections.defaultdict(list)
    for i in range(len(words) - 4):
        spots[tuple(words[i : i + 5])].append(i)
    repeated = {i + k for s in spots.values() if len(s) > 1 for i in s for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed


def test_quality_rules(docs, empty):
    got = quality_rules.judge(docs).collect()
    want = collections.Counter((r[0], *base_rules(r[1])) for r in ROWS)
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert all(not (r.kept and r.base_failed) for r in got)
    assert quality_rules.judge(empty).count() == 0


def test_a_bad_host_loses_its_documents(spark):
    good, bad = " ".join(f"w{i}" for i in range(20)), "too short"
    rows = [(i, good if i % 10 else bad, "good") for i in range(60)] + [(100 + i, bad if i % 10 else good, "bad") for i in range(60)] + [(300, bad, "once")]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1] and not got[0] and not got[100] and not got[110] and not got[300]


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert by_row(got, "doc_id", "size") == collections.Counter((r[0], len(WORD.findall(r[1] or ""))) for r in ROWS)
    assert by_row(mixing.mix(docs).collect(), "doc_id", "taken") == by_row(got, "doc_id", "taken")
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and sum(r["size"] for r in own) == own[0].source_size
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix(empty).count() == 0
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns and rows.count() == sum(-(-r.taken // r["size"]) for r in got if r["size"])


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight, left, full = {s: weights[i % 3] for i, s in enumerate(names)}, float(sum(sizes.values())), {}
    while True:
        rest = [s for s in names if s not in full]
        share = {s: (left - sum(full.values())) * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > most * sizes[s]]
        if not above:
            return full | share
        full |= {s: float(most * sizes[s]) for s in above}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, None: 100}, {"a": 1, "b": 99, "c": 100}, {"a": 0, "b": 5}, {"é": 1, "z": 2, "A": 3, "a": 400, None: 7}, {"a": 0}, {f"s{i}": i * i for i in range(9)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    assert {r.source: r.target for r in mixing.targets(rows).collect()} == pytest.approx(brute_targets(sizes))


def brute_weight(text):
    words, lines = WORD.findall(text or ""), (text or "").split("\n")
    clean = 1 - sum(c in "#*$%&|<>" for c in text or "") / max(1, len(text or ""))
    mean = sum(map(len, words)) / max(1, len(words))
    return max(0.05, clean * len(set(lines)) / len(lines) * (0.5 + 0.5 * len(set(words)) / max(1, len(words))) * min(1, mean / 3, 10 / max(mean, 1)))


def test_mixing_equals_a_sort_by_key(spark, docs):
    """The key of each row, its source's target, and what is taken, from a plain sort of each source."""
    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choice(["one", "two", "three", "#", "four"]) for _ in range(rnd.randint(0, 30))), rnd.choice("aaaaabbc") if i % 50 else None) for i in range(3000)]
    rows += [rows[0], rows[1], (None, "no id", "a"), (5000, None, "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(frame).collect()
    u = {r.doc_id: ((r.h % (1 << 64) >> 11) + 0.5) / (1 << 53) for r in frame.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("h")).collect()}
    want_key = collections.Counter((d, round(-math.log(u[d]) / brute_weight(t), 6)) for d, t, _ in rows)
    assert collections.Counter((r.doc_id, round(r.key, 6)) for r in got) == want_key
    sizes = collections.Counter()
    for r in got:
        sizes[r.source] += r["size"]
    aims = brute_targets(sizes)
    for source in sizes:
        own = sorted((r for r in got if r.source == source and r["size"]), key=lambda r: (r.key, r.doc_id is not None, r.doc_id or 0))
        epochs = min(int(aims[source] // sizes[source]), 3)
        left = min(round(aims[source] - epochs * sizes[source]), sizes[source]) if epochs < 3 else 0
        for i, r in enumerate(own):
            n = min(r["size"], left)
            twin = i and own[i - 1].doc_id == r.doc_id
            left -= n
            assert r.target == pytest.approx(aims[source]) and (r.taken == epochs * r["size"] + n or twin), (source, r)


def test_langid(docs, empty):
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    want = {r[0]: r[2] for r in ROWS[:90]}
    assert np.mean([r.lang_pred == want[r.doc_id] for r in got if r.doc_id in want]) > 0.95
    odd = {r.doc_id: r for r in got}
    assert odd[92].lang_pred == odd[93].lang_pred == odd[99].lang_pred == "und" and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert langid.accepted(docs, model).columns == docs.columns


def brute_subwords(text):
    """Each run of two to four bytes of a text, with a white space at its ends alone, and not two of them."""
    raw = bytes(32 if b in shared.SPACES else b + 32 if 65 <= b <= 90 else b for b in text.encode())
    for size in langid.SIZES:
        for i in range(len(raw) - size + 1):
            part = raw[i : i + size]
            if 32 not in part[1:-1] and part != b"  ":
                code = int.from_bytes(part, "little")
                yield ((code * 2654435761 + (size * 0x9E3779B1 & 0xFFFFFFFF)) & 0xFFFFFFFF) >> (33 - langid.ROWS.bit_length())


def test_langid_equals_a_plain_mean(docs):
    """Language and score of each text from a mean over its subwords, one at a time."""
    model = langid.train(docs)
    got = collections.Counter((r.doc_id, r.lang_pred, round(r.score, 4)) for r in langid.identify(docs, model).collect())
    want = collections.Counter()
    for r in ROWS:
        text, found = r[1] or "", list(brute_subwords(r[1] or ""))
        z = (model.table[found].mean(axis=0) if found else 0) + model.bias
        p = np.exp((z - z.max()) / model.temperature)
        p /= p.sum()
        letters = any(c.isalpha() for c in text)
        want[(r[0], model.languages[int(p.argmax())] if letters else "und", round(float(p.max()), 4) if letters else 0.0)] += 1
    assert got == want


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_langid_rejects_what_it_has_not_learnt(spark):
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(known)
    rows = ["Это совсем другой язык, которого здесь нет", "这是另一种语言", "Αυτή είναι μια άλλη γλώσσα", "zzxq qqzx vvkk", "12 34 56", "", None]
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    assert langid.accepted(odd, model).count() == 0
    assert langid.accepted(known, model).count() >= 0.97 * known.where("text is not null").count()


def test_langid_reads_whole_texts():
    langid_block, raw = langid.BLOCK, np.frombuffer(b"abc def ghi " * 500, np.uint8)
    model = langid.Model(["a", "b"], np.random.default_rng(0).normal(size=(langid.ROWS, 2)), np.zeros(2), 1.0, 0.0)
    whole = model.scores(raw, np.array([0, len(raw)]))
    langid.BLOCK = 1000
    try:
        assert np.allclose(model.scores(raw, np.array([0, len(raw)])), whole)
    finally:
        langid.BLOCK = langid_block


def test_lm(docs, empty):
    learn = docs.where("doc_id % 7 <> 2")
    model, counts = lm.train(learn)
    got = lm.score(docs, model, counts).collect()
    seen, texts = collections.Counter(), 0
    for r in ROWS:
        if r[0] is not None and r[0] % 7 != 2:
            seen.update(lowered(r[1] or "").encode().split())
            texts += 1
    n, v = sum(seen.values()) + texts, len(seen) + 1
    want = collections.Counter()
    for r in ROWS:
        words = lowered(r[1] or "").encode().split()
        base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words) + math.log10((texts + 1) / (n + v + 1))
        want[(r[0], len(words) + 1, sum(seen[w] > 0 for w in words) + 1, n, round(base, 6))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.score(empty, model, counts).count() == 0
    model, counts = lm.train(empty)
    assert lm.score(docs, model, counts).count() == len(ROWS)


def test_lm_network_learns_from_all_training_texts(spark):
    """Texts outside the sample that the network starts with alone have an order of words; the network knows it."""
    rnd, words = random.Random(8), [f"w{i}" for i in range(12)]
    ids = spark.createDataFrame([(i, "") for i in range(6000)], "doc_id long, text string")
    first = {r.doc_id for r in shared.hash_sample(ids, lm.SAMPLE, 6).collect()}
    assert len(first) < 3000
    turning = [(words * 35)[i : i + 400] for i in range(12)]
    rows = [(i, " ".join(rnd.choices(words, k=400) if i in first else rnd.choice(turning))) for i in range(6000)]
    model, counts = lm.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert model.seen == model.table.tokens == 6000 * 401
    got = lm.score(spark.createDataFrame([(1, " ".join(turning[0])), (2, " ".join(turning[5]))], "doc_id long, text string"), model, counts).collect()
    assert all(r.score > 0.8 * r.base_score for r in got)


def test_lm_start_is_thinned_by_ids_not_by_first_words(spark):
    """Of texts with more words than the start takes, those that open with either word are taken alike, by the hash of the id."""
    rows = [(i, ["first ", "other "][i % 2] + "word " * 2999) for i in range(1000)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    raw = b"first other"
    first, other = shared.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, 6]), np.array([5, 11])).tolist()
    got = lm.starting_texts(texts.select("doc_id", shared.text_bytes().alias("text")))
    assert len(got) == lm.SAMPLE_WORDS // 3000
    opening = collections.Counter(int(x[0]) for x in got)
    assert set(opening) == {first, other} and min(opening.values()) > 0.4 * len(got)
    order = texts.select("doc_id").orderBy(F.xxhash64(F.lit(6), "doc_id")).limit(len(got)).collect()
    assert [int(x[0]) for x in got] == [[first, other][r.doc_id % 2] for r in order]


def test_lm_gradients_through_time():
    """What training adds to each weight is the slope of the loss over a window."""
    rng = np.random.default_rng(2)
    counts = np.sort(rng.integers(1, 50, 60))[::-1].copy()
    table = lm.Table(rng.integers(0, 1 << 62, 60).astype(np.uint64), counts, 10, int(counts.sum()) + 40, 90)
    network = lm.Network(table)
    ids = rng.integers(0, 62, (6, 4)).astype(np.int32)

    def loss():
        h, total = np.zeros((4, lm.HIDDEN), np.float32), 0.0
        for row in ids:
            total -= network.loss(table, h, row).sum()
            h = network.step(h, table.input[row])[0] * (table.of[row] != table.end)[:, None]
        return total

    learner = lm.Learner(network, table, 4, 0.0, 1)
    learner._update(ids, np.zeros((4, lm.HIDDEN), np.float32))
    for k, at in (("u", (3, 5)), ("u", (2, 40)), ("x", (table.input[ids[0, 0]], 20)), ("wc", (1, 0))):
        slope, before = learner.m1[k][at] / 0.1 * 4 * lm.WINDOW, network.p[k][at]
        network.p[k][at] = before + 1e-2
        up = loss()
        network.p[k][at] = before - 1e-2
        down = loss()
        network.p[k][at] = before
        assert slope == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-2)


def test_lm_probabilities_sum_to_one_and_gradients_hold():
    rng = np.random.default_rng(1)
    counts = np.sort(rng.integers(1, 50, 1500))[::-1].copy()
    table = lm.Table(rng.integers(0, 1 << 62, 1500).astype(np.uint64), counts, 10, int(counts.sum()) + 40, 1600)
    network = lm.Network(table)
    h = rng.normal(size=(1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(1502)
    assert np.exp(network.loss(table, np.repeat(h, 1502, axis=0), every)).sum() == pytest.approx(1, abs=1e-3)
    ids = rng.integers(0, 1502, 5)
    back = {k: np.zeros_like(x) for k, x in network.p.items()}
    states = np.repeat(h, 5, axis=0)
    _, flow = network.loss(table, states, ids, back)
    e = np.zeros_like(states)
    e[0, 3] = 1e-2
    change = (network.loss(table, states + e, ids).sum() - network.loss(table, states - e, ids).sum()) / 2e-2
    assert -flow[0, 3] == pytest.approx(change, rel=0.05, abs=1e-2)
    texts = [rng.integers(0, 1501, n) for n in (70, 3, 0, 33)]
    together = network.score(table, np.concatenate(texts).astype(np.int32), np.array([70, 3, 0, 33]))
    alone = [network.score(table, t.astype(np.int32), np.array([len(t)]))[0] for t in texts]
    assert np.allclose(together, alone, rtol=1e-4)


def test_media(docs, empty):
    got = media.describe(media.store(docs)).collect()
    for r in got:
        text = {x[0]: x[1] or "" for x in ROWS}[r.doc_id].encode()
        payload = text + b" " * (-len(text) % 192 if text else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = b"P6\n64 %d\n255\n" % (len(payload) // 192) + payload
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        tile = np.load(io.BytesIO(r.tile))
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).mean(axis=2)
        fine = np.repeat(np.repeat(image, media.TILE[0], axis=0), media.TILE[1], axis=1) if len(image) < 400 else None
        if fine is not None:  # each cell of the tile is the mean of as many cells of the enlarged image
            mean = fine.reshape(media.TILE[0], len(image), media.TILE[1], 64).mean(axis=(1, 3))
            assert np.abs(tile - mean).max() <= 0.51
            bits = [int(a < b) for row in mean.round(6) for a, b in zip(row, row[1:])]
            assert sum(x != y for x, y in zip(bits, map(int, f"{int(r.feature, 16):064b}"))) <= 2  # ties to rounding
    assert len(got) == len(ROWS) and media.describe(media.store(empty)).count() == 0


def test_tiles_are_stored(spark, docs):
    tiles = media.store_tiles(media.store(docs))
    path = tiles.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    rows = spark.read.parquet(path).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        tile = np.load(io.BytesIO(r.tile))
        assert tile.shape == media.TILE and tile.dtype == np.uint8 and len(r.feature) == 16


def test_images():
    assert media.decode(b"P2\n# note\n2 1\n255\n0 255\n")[:, :, 0].tolist() == [[0, 255]]
    assert media.decode(b"P1\n2 2\n10\n01")[:, :, 0].tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0")[:, :, 0].tolist() == [[0, 255, 0]]
    image = np.random.default_rng(0).integers(0, 256, (6, 4, 3)).astype(np.uint8)
    assert (media.decode(media.encode_ppm(image)) == image).all()
    import struct

    rows = b"".join(line[:, ::-1].tobytes() for line in image[::-1])
    assert (media.decode(b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 4, 6, 1, 24, 0, 0, 0, 0, 0, 0) + rows) == image).all()
    assert np.allclose(media.area_resize(image, 3, 2), image.mean(axis=2).reshape(3, 2, 2, 2).mean(axis=(1, 3)))
    with pytest.raises(ValueError):
        media.decode(b"no image")


def test_licenses(docs, empty):
    got = licenses.scan(docs).collect()
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = collections.Counter()
    for r in ROWS:
        words = word.findall(lowered(r[1] or ""))
        places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        want[(r[0], len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places})))] += 1
    assert by_row(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    found = next(r for r in got if r.doc_id == 95)
    assert found.labels == "mit,mit-notice" and found.score == 1.0 and found.n_base == 2
    assert licenses.scan(empty).count() == 0


def test_licenses_bear_small_changes(spark):
    notice = licenses.TEMPLATES["mit-notice"][1].split()
    rows = [(1, "x y z " + " ".join(notice[:9] + ["really"] + notice[9:]) + " end"), (2, " ".join(reversed(notice))), (3, " ".join(notice[:6]))]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit-notice", 2: "", 3: ""}


def test_each_template_gives_its_own_label_only(spark):
    texts = [(label, t) for label, ts in licenses.TEMPLATES.items() for t in ts]
    rows = [(i, "Some words before. " + t.capitalize() + ", and after.") for i, (_, t) in enumerate(texts)]
    rows += [(100, "licensed under the mit license"), (101, "licensed under a creative commons attribution noderivatives 4 0 international license"), (102, "the mit license"), (103, None)]
    got = {r.doc_id: sorted({x.label for x in r.spans or []}) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, t) in enumerate(texts):
        assert got[i] == [label]
    assert got[100] == got[101] == got[102] == got[103] == []


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_licence_spans_equal_word_edits(spark):
    """Templates with words changed, dropped and added, five words or more apart: a hit where the edit distance allows it, with its cover."""
    rnd, rows, want = random.Random(17), [], {}
    pool = [(f"{label}/{i}", t.split()) for label, ts in licenses.TEMPLATES.items() if label != "mit-notice" for i, t in enumerate(ts)]
    for n in range(200):
        name, words = rnd.choice(pool)
        changed, places = list(words), list(range(4, len(words) - 4, 6))
        for at in sorted(rnd.sample(places, rnd.randint(0, min(4, len(places)))), reverse=True):
            changed[at : at + 1] = rnd.choice([[], ["zzz"], [changed[at], "zzz"]])
        edits = word_edits(words, changed)
        if edits * licenses.EDIT_WORDS <= len(words):
            want[n] = (name, round(1 - edits / len(words), 9), 3, 2 + len(changed))
        rows.append((n, "x y z " + " ".join(changed) + " end"))
    got = {r.doc_id: (r.template, round(r.cover, 9), r["first"], r["last"]) for r in licenses.hits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 50 < len(want) < 180


def test_quality_fm(spark, docs, empty):
    labels = spark.createDataFrame([(r[0], 0 if r[1] and ("#" in r[1] or r[0] % 3 == 1) else 1) for r in ROWS[:101]] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality_fm.train(docs, labels)
    got = quality_fm.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    want = {r[0]: r[0] % 3 != 1 for r in ROWS[:90]}
    assert np.mean([(r.score > 0.5) == want[r.doc_id] for r in got if r.doc_id in want]) > 0.9
    assert quality_fm.accepted(docs, model).columns == docs.columns
    assert quality_fm.score(empty, quality_fm.train(empty, labels)).count() == 0


def test_quality_scores_equal_all_pairs(spark, docs):
    """The score of a text from its features and each pair of them; features of a text do not depend on its batch."""
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in ROWS[:90]], "doc_id long, quality int")
    model = quality_fm.train(docs, labels)
    got = {r.doc_id: r.score for r in quality_fm.score(docs, model).collect()}
    for r in [*ROWS[:10], *ROWS[90:99]]:
        raw = np.frombuffer((r[1] or "").encode(), np.uint8)
        cols, x = next(((c, v) for _, _, (_, c, v) in quality_fm.features(raw, np.array([0, len(raw)]))))
        z = model.w0 + model.w[cols] @ x
        z += sum(float(model.v[cols[i]] @ model.v[cols[j]]) * x[i] * x[j] for i in range(len(cols)) for j in range(i))
        assert got[r[0]] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_pairs_by_the_sum_of_squares():
    rng = np.random.default_rng(0)
    model = quality_fm.Model(0.3, rng.normal(size=quality_fm.FEATURES), rng.normal(size=(quality_fm.FEATURES, 3)))
    cols, x = np.array([1, 5, 9, 4100]), rng.normal(size=4)
    pairs = sum(model.v[a] @ model.v[b] * x[i] * x[j] for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j)
    assert model.margin(1, np.zeros(4, int), cols, x)[0] == pytest.approx(0.3 + model.w[cols] @ x + pairs)


def test_word_hashes_do_not_depend_on_the_batch():
    words = [b"a", b"bb", b"word" * 300, "été".encode(), b"x"] * 80
    raw = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = shared.word_spans(raw, np.array([0, len(raw)]))
    alone = [int(shared.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words[:5]]
    assert shared.word_hashes(raw, starts, ends).tolist() == alone * 80
