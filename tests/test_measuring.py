"""Quantiles, bitmaps, differences, orders and masks on fixtures, against plain Python."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyagree.functions import fixed as V
from polyagree.functions import masking
from polyagree.functions import text as X
from polyagree.operators import bitmaps, differences, ordering, quantiles

QS = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}


@pytest.mark.parametrize("values", [
    [float(i * 7919 % 3001) for i in range(3000)],
    [5.0] * 2500 + [1.0, 9.0],
    [1.0] * 1000 + [2.0] * 1000,
    [10.0 ** (i % 300 - 150) for i in range(900)] + [-1e300, 0.0],
    [random.Random(1).gauss(0, 1) ** 5 for _ in range(2000)],
])
def test_quantiles_of_one_large_group(spark, values):
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    got = quantiles.quantiles(rows, [], "v", QS, most=50, parts=8).collect()
    assert len(got) == 1
    for name, q in QS.items():
        want = float(np.quantile(values, q))
        assert got[0][name] == pytest.approx(want, rel=1e-12, abs=1e-12), name


def test_quantiles_of_groups(spark):
    rnd = random.Random(2)
    data = [(g, h, float(rnd.randint(0, n))) for g, h, n in (("x", 1, 3), ("x", None, 1000), (None, 1, 10)) for _ in range(400)] + [("few", 1, 2.0), ("few", 1, 4.0), ("none", 1, None)]
    got = quantiles.quantiles(spark.createDataFrame(data, "g string, h int, v double"), ["g", "h"], "v", QS, most=100, parts=4)
    found = {(r.g, r.h): r for r in got.collect()}
    assert set(found) == {("x", 1), ("x", None), (None, 1), ("few", 1)}
    for (g, h), r in found.items():
        assert [r[n] for n in QS] == pytest.approx([float(np.quantile([v for a, b, v in data if (a, b) == (g, h)], q)) for q in QS.values()])
    assert quantiles.quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", QS).count() == 0


def test_coverage_by_bitmaps(spark):
    rnd = random.Random(4)
    members = [(rnd.randint(0, 60), s) for s in "abcd" for _ in range(25)] + [(None, "a"), (3, None)]
    has = {s: {i for i, t in members if t == s and i is not None} for s in "abcd"}
    found = bitmaps.Coverage(spark.createDataFrame(members, "item int, source string"), "item", "source", spark.range(80).select(F.col("id").cast("int").alias("item")))
    depth = {r.n_sources: r["items"] for r in found.depth().collect()}
    assert depth == {k: n for k in range(5) if (n := sum(sum(i in x for x in has.values()) == k for i in range(80)))}
    assert {(r.a, r.b): (r["both"], r.either, r.share) for r in found.pairs().collect()} == {(a, b): (len(has[a] & has[b]), len(has[a] | has[b]), round(len(has[a] & has[b]) / len(has[a]), 6)) for a in has for b in has}
    assert {r.source: (r.covered, r.verified, r.expanded) for r in found.against("b").collect()} == {s: (len(x), len(x & has["b"]), len(x - has["b"])) for s, x in has.items() if s != "b"}
    others = {s: set().union(*(x for t, x in has.items() if t != s)) for s in has}
    assert {r.source: (r.covered, r.sole) for r in found.sole().collect()} == {s: (len(x), len(x - others[s])) for s, x in has.items()}
    empty = bitmaps.Coverage(spark.createDataFrame([], "item int, source string"), "item", "source")
    assert empty.depth().count() == empty.pairs().count() == empty.sole().count() == 0
    with pytest.raises(ValueError):
        found.against("zz")
    with pytest.raises(ValueError):
        bitmaps.Coverage(spark.range(63).select("id", F.col("id").alias("s")), "id", "s")


def kind(a, b, rtl):
    if a == b:
        return "identical"
    if not rtl and a.lower() == b.lower():
        return "capitalization"
    if a.strip().lower() == b.strip().lower():
        return "whitespace" if a.strip() == b.strip() or rtl else "both"
    return "content"


def summary(terms, rtl):
    terms = [t for t in terms if t is not None]
    if len(terms) <= 1:
        return "no_differences"
    found = {kind(a, b, rtl) for a, b in itertools.combinations(terms, 2)} - {"identical"}
    return ",".join(sorted(found)) or "all_identical"


def test_differences(spark):
    spellings = ["море", "Море", " море", "МОРЕ ", "בחר", "x", "X", None, "x\t"]
    cells, rnd = [], random.Random(6)
    for item in range(120):
        for service in range(rnd.randint(1, 5)):
            cells.append((item, service, rnd.choice(spellings), item % 2 == 0 if item % 5 else None))
    rows = spark.createDataFrame(cells, "item int, service int, term string, rtl boolean")
    by = {i: ([t for j, _, t, _ in cells if j == i], any(r for j, _, _, r in cells if j == i)) for i in range(120)}
    got = {r["item"]: r for r in differences.summarised(rows, ["item"], rtl=F.col("rtl")).collect()}
    assert {i: r.differences for i, r in got.items()} == {i: summary(t, r) for i, (t, r) in by.items()}
    assert {r.differences for r in got.values()} > {"no_differences", "all_identical", "content"} and any("both" in r.differences for r in got.values())
    pools = {"low": F.col("service") < 2, "high": F.col("service") >= 2, "all": F.lit(True)}
    pooled = {(r["item"], r.pool): r.differences for r in differences.agreement_by_pool(rows, ["item"], pools, rtl=F.col("rtl")).collect()}
    for (item, pool), said in pooled.items():
        inside = [(t, r) for j, s, t, r in cells if j == item and (pool == "all" or (s < 2) == (pool == "low"))]
        assert said == summary([t for t, _ in inside], any(r for _, r in inside))
    assert differences.summarised(rows.limit(0), ["item"]).count() == 0


def test_ranks_without_one_task(spark):
    rnd = random.Random(7)
    data = [(i, rnd.choice([None, 1.0, 2.0, 2.0, 3.5])) for i in range(500)]
    got = ordering.ranked(spark.createDataFrame(data, "k int, v double").repartition(5), F.desc("v"), F.asc("k")).collect()
    want = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 501))
    assert ordering.ranked(spark.createDataFrame([], "k int"), F.asc("k")).count() == 0
    tiers = spark.createDataFrame([("b",), ("a",), ("z",), (None,)], "t string").select("t", ordering.custom(F.col("t"), ["b", "a"]).alias("n"))
    assert {r.t: r.n for r in tiers.collect()} == {"b": 0, "a": 1, "z": 9, None: 9}


def gone(text, pattern):
    return re.sub(pattern, "", text, flags=re.IGNORECASE)


def collapsed(text):
    return re.sub(r" {2,}", " ", text).strip()


def plain_mask(text, m, name, code, term):
    """The layers one after another with re."""
    out = text or ""
    if m.metadata and out:
        for words in (V.VARIANT_TOKENS, V.SERVICE_TOKENS):
            out = gone(out, r"\b(?:" + "|".join(words) + r")\b")
        out = collapsed(out)
    if (m.source_words or m.source_phrase) and out:
        if m.source_phrase:
            out = gone(out, r"\bdigital\s+humanit(?:y|ies|ie)?\b")
        out = collapsed(gone(out, r"\b(?:" + "|".join(V.SOURCE_WORDS) + r")\b"))
    for phrase, short, spared in ((name, code, V.SPARED_WORDS), (term, None, ())):
        if out and phrase and (m.names if phrase is name and short is not None or phrase is name and spared else m.terms):
            out = gone(out, re.escape(phrase))
            for w in phrase.split():
                if len(w) > 3 and w.lower() not in spared:
                    out = gone(out, r"\b" + re.escape(w) + r"\b")
            if short and len(short) >= 2:
                out = gone(out, r"\b" + re.escape(short) + r"\b")
            out = collapsed(out)
    return out


def test_masks_by_row(spark):
    texts = ["The Judge (minimal — Claude) says digital humanities, DH and digital  Humanity.", "Burmese (Myanmar) language: in burmese my word, Burmesesque", "naïve été Été humanism", "a\\Eb C++ (x) c++", "", None, "  two   spaces  ", "qwen-mistral judges judge"]
    names = [("Burmese (Myanmar) language", "my"), ("été", "fr"), ("", "my"), (None, None), ("C++ (x)", "x"), ("a\\Eb", "zz")]
    terms = ["word", "Été humanism", "", None, "c++", "digital  Humanity"]
    rows = [(t, n, c, own) for t in texts for n, c in names for own in terms]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, n string, c string, o string")
    got = df.select("i", *(masking.masked(F.col("t"), m, F.col("n"), F.col("c"), F.col("o")).alias(k) for k, m in masking.PRESETS.items())).collect()
    for r in got:
        for k, m in masking.PRESETS.items():
            assert r[k] == plain_mask(rows[r.i][0], m, *rows[r.i][1:]), (k, rows[r.i])


def test_kinds_of_difference(spark):
    cases = [("a", "a"), ("a", "A"), ("a", " a"), ("a", "A　"), ("a", "b")]
    for rtl in (False, True):
        rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string").select("i", X.difference(F.col("a"), F.col("b"), F.lit(rtl)).alias("k"))
        assert [r.k for r in rows.orderBy("i").collect()] == [kind(a, b, rtl) for a, b in cases]
