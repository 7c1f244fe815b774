"""Column functions, features and rules on terms of many scripts; sources, sinks and reshaping on small fixtures."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from polyagree.functions import curation
from polyagree.functions import text as X
from polyagree.operators import agreement, disagreement, registry, review, search_terms, shaping
from polyagree.sources import files, html
from polyagree.streaming import logs


def each(spark, function, cases):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    return [r.x for r in rows.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


def check(spark, function, cases):
    assert dict(zip(cases, each(spark, function, cases))) == cases


def test_text_functions(spark):
    check(spark, X.folded, {"Ünïcode, Straße!": "unicode straße", "  Ａ b c ": "a b c", "Ёлка и ёж": "елка и еж", "été_1": "ete_1", None: "", "हिन्दी": X_hindi(), "PLAIN  text.": "plain text"})
    check(spark, X.comparable, {"«x»": "«x»", " “Straße”. ": "strasse", "(Ｆｕｌｌ)  width": "full) width", None: "", "nan": "", "¿Qué?": "qué"})
    check(spark, X.is_placeholder, {"unable to translate": True, "Not applicable": True, "Note: x": True, "unknown soldier": False, "no widely recognized translation": True, "translation": False, None: False, "isn't a direct translation": True})
    check(spark, X.is_empty_rationale, {"N/A": True, "No reason provided.": True, "not provided": False, None: True, " ": True, "because": False})
    check(spark, X.is_refusal, {"It does not have a direct equivalent": True, "I'm not aware of any": True, "A fine word": False, None: False, "typically left untranslated": True})
    check(spark, X.is_transliteration, {"a phonetic rendering of it": True, "transliterated": True, "phone": False})
    check(spark, X.is_placeholder_rationale, {"serves as a stand-in": True, "stopgap": True, "place": False})
    check(spark, X.dominant_script, {"word слово": "Cyrillic", "ab вг": "Latin", "вг ab": "Cyrillic", "12 !": "Unknown", "漢字かな": "CJK", "かな漢": "Japanese", None: "Unknown", "𞤀𞤁": "Adlam", "१२": "Unknown", "한국": "Korean"})
    check(spark, X.is_mixed, {"цифровые абвгд": False, "цифровые digital": True, "漢字かなカナ": False, "слово ab": False, "": False})
    check(spark, X.is_mixed, {"абвгдежзик xyzab": True, "абвгдежзикл xyzax": True, "абвгдежзиклмнопрстуфхц xyza": False, "абвгдежзик xyz": True, "абвгдежзик xyx": False, "абвгдежзик": False})
    check(spark, lambda t: X.script_mix(t)["secondary"][0]["distinct"], {"слово ab": 2, "слово aab": 2, "слово abc": 3})
    check(spark, X.is_mixed_at_all, {"слово ab": True, "слово": False, "": False})
    check(spark, X.has_foreign_rationale, {"это слово означает очень многое для всех": True, "word": False, "это слово": False, None: False})
    check(spark, lambda t: X.is_language_name(t, F.lit("Old Norse")), {"old norse": True, "in Old-Norse here": True, "norse": False, "norseman": False, None: False, "": False})
    check(spark, lambda t: X.leaks_source(t, "C++ (x) thing"), {"the c++ (x) THING": True, "C(T here": True, "plain": False, None: False})
    check(spark, X.short_family, {"Bantu languages": "Bantu", "Romance": "Romance", "Uralic Family": "Uralic"})
    check(spark, X.canonical_tag, {"SR_latn_rs": "sr-Latn-RS", "en": "en", "zh-hant": "zh-Hant"})
    check(spark, lambda t: X.edit_kind(t, F.lit("mot"), "open seas"), {'"mot".': "strip_punctuation", "open seas (mot)": "remove_source_wrapper", "/mot": "strip_punctuation", "mot (x)": "strip_trailing_parenthetical", "other": "other"})
    check(spark, lambda t: X.name_difference(t, F.lit("Nahuatl")), {"Nahuatl": "same", "nahuatl": "case", "Central Nahuatl": "qualifier", "Maya": "substantive"})
    check(spark, lambda t: X.bins(F.length(t), [0, 4, 6, 20], ["few", "some", "many"]), {"": None, "a": "few", "abcd": "few", "abcde": "some", "abcdefg": "many"})
    assert X.source_tokens("Open Open Seas") == ["open open seas", "open", "seas", "oos"]
    assert each(spark, lambda t: X.keywords(t, "absence"), ["no equivalent; it is borrowed", "overborrowed"]) == [["no equivalent", r"\bborrowed\b"], []]


def X_hindi():
    import re
    import unicodedata

    kept = "".join(c for c in unicodedata.normalize("NFKD", "हिन्दी") if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", kept).strip()


def test_error_kinds_and_signatures(spark):
    check(spark, X.error_kind, {None: "unknown", " ": "unknown", "Read operation timed out": "api_error", "hit token limit": "max_tokens", '{"translated_term": "x"': "parse_format", "I'm sorry, but no": "generic_refusal", "an undeciphered script": "extinct_ancient", "there is limited data": "knowledge_gap", "boom": "other", '{"translated_term": "' + "lalo" * 20 + '"}': "repetition_loop"})
    check(spark, X.error_status, {"quota exceeded": 429, "not supported": 400, "unable to translate": 400, "boom": 500})
    check(spark, lambda t: X.signature(t, "open seas"), {"code 1234 at 99": "code <num> at 99", "aaaaaaaaab": "a<repeat>b", "open seas → Welsh. x": "open seas → <language>. x", None: "<empty>", '```json {"translated_term": "abc"}': '{"translated_term": "<term>"}'})


def test_white_space_of_any_kind_is_blank(spark):
    check(spark, X.present, {"\t": False, "\n \r": False, "\u00a0": False, "\u3000": False, "nan\n": False, "\u2003None\x1f": False, "x": True, " x\u00a0": True, "": False})
    check(spark, X.is_short, {"\u00a0\u00a0\u00a0\u00a0": False, "\u3000ab\n": True, "abcd": False})
    check(spark, lambda t: X.is_extreme_length(t, 3), {"abc\u00a0\n": False, "abcd": True})
    check(spark, X.is_blank, {None: True, "\u00a0": True, "nan": False})
    check(spark, lambda t: X.first_present(t, F.lit(" y\u3000")), {"\u00a0": "y", "x ": "x"})


def test_messages_go_without_the_mark_of_the_parser(spark):
    mark = "Could not parse translation response: "
    check(spark, X.error_kind, {mark + '{"term": "x"}': "parse_format", mark + "  {'a'": "parse_format", mark + "I'm sorry, but no": "generic_refusal", mark + "boom": "other", "nan": "other", mark: "other", mark + '{"translated_term": "' + "lalo" * 20 + '"}': "repetition_loop", "\u00a0": "unknown"})
    check(spark, X.signature, {mark + '```json {"translated_term": "abc"}': '{"translated_term": "<term>"}', mark + "code 123": "code <num>", "\u3000": "<empty>"})


def test_language_names_of_two_words(spark):
    check(spark, lambda t: X.is_language_name(t, F.lit("Western Hindi")), {"Hindi": False, "western hindi": True, "the Western-Hindi word": True, "westernhindi": False})


NONE = "No rationale provided"
REPLIES = {
    '{"translated_term": "eau", "translation_rationale": "x"}': ("eau", "x", "parsed"),
    '```json\n{"translated_term": "eau", "translation_rationale": "x"}\n```': ("eau", "x", "parsed"),
    '```JSON {"translated_term": "eau"}```  ': ("eau", NONE, "parsed"),
    '```\n{"translated_term": "eau"}\n```': ("eau", NONE, "parsed"),
    '{"translated_target": "eau", "reason": "x"}': ("eau", "x", "parsed"),
    '{"translated_text": "eau", "translation_reason": "x"}': ("eau", "x", "parsed"),
    '{"translated_word": "eau", "translation_explanation": "x"}': ("eau", "x", "parsed"),
    '{"translation": "eau", "explanation": "x"}': ("eau", "x", "parsed"),
    '{"term": "eau", "rationale": "x"}': ("eau", "x", "parsed"),
    '{"term": "no", "translated_term": "eau", "rationale": "no", "translation_rationale": "x"}': ("eau", "x", "parsed"),
    '{"term": "no", "translated_term": null, "translation_rationale": "x"}': (None, "x", "refused"),
    '{"translated_term": "", "translation_rationale": "x"}': (None, "x", "refused"),
    '{"translation_rationale": "x"}': (None, "x", "refused"),
    '{"translated_term": " eau ", "translation_rationale": "it\'s"}': (" eau ", "it's", "parsed"),
    '{"translated_term": "l\\"eau", "translation_rationale": "a\\nb \\u00e9"}': ('l"eau', "a\nb é", "parsed"),
    '{"translated_term": "eau", "translation_rationale": "line one\nline two\tend"}': ("eau", "line one\nline two\tend", "parsed"),
    "{'translated_term': 'eau', 'translation_rationale': 'x'}": ("eau", "x", "parsed"),
    "{'translated_term': \"l'eau\", 'reason': 'x'}": ("l'eau", "x", "parsed"),
    "{'translated_term': 'l\\'eau'}": ("l'eau", NONE, "parsed"),
    "Sure: {'term': 'eau'} and more": ("eau", NONE, "parsed"),
    'Sure: {"term": "eau"} and more': ("eau", NONE, "parsed"),
    '{"translated_term": "eau", "translation_rationale": "x": bad}': ("eau", "x", "saved"),
    '{"translated_term": "eau", "translation_rationale": "goes on and': ("eau", NONE, "saved"),
    '{"translated_term": "l\\"eau", "translation_rat': ('l"eau', NONE, "saved"),
    'It is "translated_term": "eau", "translation_rationale": "x", as said': ("eau", "x", "saved"),
    '{"translated_term": "' + "a" * 301 + '", "translation_rationale": "cut': (None, NONE, "too_long"),
    '{"translated_term": "' + "a" * 301 + '"}': ("a" * 301, NONE, "parsed"),
    '{"translated_term": "", "translation_rationale": "cut': (None, NONE, "refused"),
    '{"translated_term": "cut of': (None, NONE, "unparsed"),
    "{'translated_term': None}": (None, NONE, "unparsed"),
    "I cannot do that": (None, NONE, "unparsed"),
    "\u00a0\n": (None, NONE, "empty"),
    "{'translated_term': 'eau', 'reason': '" + "long " * 120 + "'}": (None, NONE, "unparsed"),
    None: (None, NONE, "empty"),
}


def test_replies_are_read_or_saved(spark):
    got = each(spark, X.parsed_reply, REPLIES)
    assert {t: tuple(r) for t, r in zip(REPLIES, got)} == REPLIES


def test_roots_of_long_chains_cycles_and_lacking_parents(spark):
    edges = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(1000)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("lost", "nowhere"), ("below", "lost"), ("isolate", None), ("n3", None), ("me", "me"), (None, "n0")]
    got = {r.code: (r.root, r.depth) for r in registry.roots(spark.createDataFrame(edges, "code string, parent string")).collect()}
    want, parent = {}, {}
    for code, up in edges:
        if code:
            parent[code] = min(filter(None, (up, parent.get(code))), default=None)
    for code in parent:
        seen, at = [], code
        while at in parent and at not in seen and parent[at]:
            seen.append(at)
            at = parent[at]
        want[code] = (at, len(seen)) if at in parent and at not in seen else (code, None)
    assert got == want and got["n999"] == ("n0", 999) and got["d"] == ("d", None) and got["isolate"] == ("isolate", 0)
    assert registry.roots(spark.createDataFrame([], "code string, parent string")).count() == 0


TERMS = {
    1: [("a", "одно слово", "r"), ("b", "Одно слово", "r")],
    2: [("a", "море", "r"), ("b", "океан", "r")],
    3: [("a", "بحر", "r"), ("b", "محيط", "r"), ("w", "بحر كبير جدا", "r")],
    4: [("a", "digital мир", "r"), ("b", "совсем другое слово", "r")],
    5: [("a", "海洋科学研究", "no equivalent and not adopted"), ("b", "まったく別の言葉です", "r")],
    6: [("a", "море", "r"), ("b", "море!", "r")],
    7: [("a", "résumé", "r"), ("b", "resume", "r")],
    8: [("a", "совершенно иное слово", "r"), ("b", "ничего похожего тут нет", "r"), ("c", "третье значение вовсе", "r")],
    9: [("a", "ﬁn", "r"), ("b", "fin", "r")],
}


def test_rules_beyond_ascii(spark):
    """Terms of other scripts keep their words: they agree, differ by marks, are anchored or borrowed as Latin ones are."""
    rows = spark.createDataFrame([(k, s, t, w) for k, v in TERMS.items() for s, t, w in v], "item int, service string, term string, rationale string")
    found = disagreement.features(rows, ["item"], ["digital"], "w")
    f = {r["item"]: r for r in found.collect()}
    assert [f[k].n_norm for k in range(1, 10)] == [1, 2, 3, 2, 2, 1, 1, 3, 1]
    assert f[2].max_distance == 4 and f[3].scripts == ["Arabic"] and f[5].scripts == ["CJK", "Japanese"] and f[5].absence == 2 and f[2].absence == 0
    assert f[4].borrowed == "digital" and f[8].threshold == int(0.15 * sum(map(len, ("совершенно иное слово", "ничего похожего тут нет", "третье значение вовсе"))) / 3)
    got = {r["item"]: (r.rule, r.evidence) for r in disagreement.standard_chain().apply(found).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "all_agree", 2: "default", 3: "anchored", 4: "loanword", 5: "sparse", 6: "normalization", 7: "normalization", 8: "default", 9: "normalization"}
    assert got[3][1] == "anchored, 3 terms" and got[4][1] == "borrowed: digital" and got[7][1] == "1 normalised terms, at most 0 edits apart"


def test_review(spark):
    rows = spark.createDataFrame([(1, "a", "abc", "why"), (1, "b", "not translatable", None), (2, "a", "ünlü", "because"), (3, "a", "слово word вот она", "romanized")], "item int, service string, term string, rationale string")
    found = review.signals(rows, ["item"], "service", review.term_signals(F.col("term"), F.col("rationale"), "the thing"))
    got = {(r["item"], r.signal): r.services for r in found.collect()}
    assert got[(1, "has_short_translation")] == "a" and got[(1, "has_placeholder_term")] == "b" and got[(1, "has_missing_rationale")] == "b" and (2, "has_short_translation") not in got
    tiers = {r["item"]: (r.tier, r.hint) for r in review.summary(rows, found, ["item"]).collect()}
    assert tiers[1] == ("REVIEW_HIGH", "xall") and tiers[2] == ("CLEAN", "")
    decided = spark.createDataFrame([(2, "likely_error"), (3, "keep")], "item int, tier string")
    assert {r["item"]: r.likely_error for r in review.exclusions(decided, found, ["item"]).collect()}[2]
    variants = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "item int, variant string")
    assert {r["item"]: r.all_variants for r in review.promoted(variants, ["item"], "variant", ["x", "y"]).collect()} == {1: True, 2: False}
    cells = spark.createDataFrame([(1, "a", "Straße."), (1, "w", "strasse"), (2, "a", "x"), (2, "b", None), (2, "w", "y"), (3, "b", " ")], "item int, service string, term string")
    labels = {r["item"]: r.label for r in review.convergence(cells, ["item"]).collect()}
    assert labels == {1: "all available outputs agree", 2: "outputs diverge", 3: "no outputs"}
    assert {r.service: (r.compared, r.aligned) for r in review.alignment(cells, ["item"], "service", "w").collect()} == {"a": (2, 1)}
    scripts = spark.createDataFrame([(1, "a", "слово"), (1, "b", "слова"), (1, "c", "word"), (2, "a", "12")], "item int, service string, term string")
    assert {r.service: r.outlier for r in review.script_agreement(scripts, ["item"], "service").collect()} == {"a": False, "b": False, "c": True}


def test_search_terms(spark):
    rows = [("Море", "ru", "ltr", False), ("море", "be", "ltr", False), ("the thing", "en", "ltr", True), ("the thing x", "fr", "ltr", True), ("x\x01y", "fr", "ltr", True), ("out", "fr", "ltr", True), ("alone", "fr", "ltr", False), (None, "fr", "ltr", True), ("not translatable", "fr", "ltr", True), ("بحر", "ar", "rtl", True), ("بحر", "fa", "ltr", True)]
    terms = spark.createDataFrame(rows, "term string, language string, direction string, valid boolean")
    out = spark.createDataFrame([("OUT",)], "term string")
    assert {r.stage: r.n for r in search_terms.staged(terms, "the thing", out).groupBy("stage").agg(F.count("*").alias("n")).collect()} == {"kept": 5, "leak": 1, "unsafe": 1, "excluded": 1, "uncorroborated": 1, "blank": 1, "placeholder": 1}
    built = search_terms.build(terms, "the thing", out)
    got = {r.search_term: (r.natural_language, r.directionality_conflict) for r in built.collect()}
    assert got == {"море": ("be, ru", False), "the thing": ("en", False), "بحر": ("ar, fa", True)}
    for decision, want in (("split", [("ltr", "fa"), ("rtl", "ar")]), ("set-rtl", [("rtl", "ar, fa")])):
        decided = spark.createDataFrame([("بحر", decision)], "search_term string, decision string")
        assert sorted((r.directionality, r.natural_language) for r in search_terms.resolve_conflicts(built, decided).collect() if r.search_term == "بحر") == want


def test_search_terms_are_selected_repaired_and_counted_in_one_pass(spark):
    cells = [(1, "ru", t, "ltr", True) for t in ("море", "море", "море", "окно")] + [(2, "ru", "цифровые (digital)", "ltr", True), (3, "fr", "not translatable", "ltr", True), (4, "fr", "the thing", "ltr", True), (5, "fr", "a", "ltr", False), (5, "fr", "b", "ltr", True), (5, "fr", "c\x01", "ltr", True), (6, "ar", "بحر", "rtl", True), (7, "fr", "out", "ltr", True), (8, "fr", "\u3000", "ltr", True), (9, "ru", "слово word вот она", "ltr", True)]
    rows = spark.createDataFrame(cells, "item int, language string, term string, direction string, valid boolean")
    best = agreement.plurality(rows.withColumn("service", F.col("term")), ["item", "language"])
    classified = best.select("item", "language", "best_candidate", F.when(F.col("unique_candidates") == 1, "COMPLETE_CONSENSUS").when(F.col("unique_candidates") == 2, "MEASUREMENT_ARTEFACT").otherwise("TRANSMOGRIFICATION").alias("category"))
    built, counts = search_terms.built_and_counted(rows, classified, ["item", "language"], "the thing", spark.createDataFrame([("OUT",)], "term string"))
    assert {r.search_term for r in built.collect()} == {"море", "цифровые", "b", "بحر"}
    assert counts.get == {"uncurated": 2, "blank": 1, "placeholder": 0, "leak": 1, "unsafe": 1, "excluded": 1, "uncorroborated": 1, "kept": 4}


def test_long_terms_are_curated(spark):
    rows = spark.createDataFrame([(1, "слово " + "word " * 20000 + "вот она речь"), (2, "word " * 20000 + "слово вот она"), (3, "two words слово вот")], "i int, term string")
    got = {r.i: (r.term_action, r.term_curated) for r in curation.curated(rows, "term").collect()}
    assert got[1][0] in ("unchanged", "nulled", "stripped") and got[2] == ("unchanged", "word " * 20000 + "слово вот она") and got[3] == ("stripped", "слово вот")


def test_bounds_of_curation(spark):
    cases = {
        "term == слово": ("stripped", "слово"), "one = two": ("stripped", "two"), "//term//": ("stripped", "term"), "/a\nb/": ("stripped", "a\nb"), "x" * 100 + " = слово": ("stripped", "слово"),
        "x" * 101 + " = two": ("unchanged", "x" * 101 + " = two"), " /term/": ("unchanged", " /term/"), "///": ("stripped", "/"),
        "слово вот " * 5 + "(" + "romanised " * 15 + ")": ("stripped", ("слово вот " * 5).strip()), "слово вот " * 5 + "(" + "romanised " * 16 + ")": ("nulled", None), "слово вот (a (b) wordy)": ("nulled", None),
        "term here: слово вот": ("stripped", "слово вот"), "wordy:\nслово\nвот": ("stripped", "слово\nвот"), "words  and \t слово  вот": ("stripped", "слово вот"),
    }
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, term string")
    got = {r.term: (r.term_action, r.term_curated) for r in curation.curated(rows, "term").collect()}
    assert got == cases


def test_shaping(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], [1, 2], "x, y;z", "{'k': 'v', 'n': None}"), (2, ["c"], [3, 4], " ", '{"k": "it\'s"}')], "i int, p array<string>, q array<int>, t string, d string")
    assert sorted(map(tuple, shaping.parallel(rows, ["i"], ["p", "q"]).collect()), key=str) == [(1, "a", 1), (1, "b", 2), (2, "c", 3), (2, None, 4)]
    assert sorted((r.i, r.t) for r in shaping.delimited(rows, "t").collect()) == [(1, "x"), (1, "y"), (1, "z")]
    assert sorted((r.i, r.k) for r in shaping.from_dict(rows.select("i", "d"), "d", ["k"]).collect()) == [(1, "v"), (2, "it's")]
    assert {r.field: r["1"] for r in shaping.transposed(rows, "i", ["t", "d"]).collect()}["t"] == "x, y;z"
    check(spark, lambda t: shaping.last_dict(t, "k"), {"a {'k': 1} b {'k': 2} {'z': 3}": "{'k': 2}", "none": None})
    check(spark, shaping.list_or_one, {"['a', \"b\"]": ["a", "b"], "a b": ["a b"], "[]": []})
    tree = spark.createDataFrame([("root", ["a", "b"]), ("a", ["c"])], "node string, children array<string>")
    roots = {r.code: (r.root, r.depth) for r in registry.roots(shaping.parents(tree, "node", "children")).collect()}
    assert roots == {"root": ("root", 0), "a": ("root", 1), "b": ("root", 1), "c": ("root", 2)}
    a, b = spark.createDataFrame([(1, 2, "l")], "k int, j int, v string"), spark.createDataFrame([(1, 2, "r", 5)], "k int, j int, v string, w int")
    assert shaping.natural(a, b).count() == 0 and shaping.keeping_left(a, b, ["k"]).first().asDict() == {"k": 1, "j": 2, "v": "l", "w": 5}
    codes = spark.createDataFrame([("en",), ("eng",), ("xx",)], "c string")
    two, three = (spark.createDataFrame([r], "code string, name string") for r in (("en", "English 2"), ("eng", "English 3")))
    assert {r.c: r.name for r in shaping.by_length(codes, "c", {2: two, 3: three}, "name").collect()} == {"en": "English 2", "eng": "English 3", "xx": None}
    table = spark.createDataFrame([("n", "en", "eng"), ("m", None, "xx")], "name string, one string, two string")
    assert {r.c: r.name for r in shaping.first_match(codes, "c", table, ["one", "two"], "name").collect()} == {"en": "n", "eng": "n", "xx": "m"}
    assert {r.x: r.r for r in agreement.mean_ranks(spark.createDataFrame([(x,) for x in (5, 5, 1, 9, 9, 9, 2)], "x int"), "x", "r", 4).collect()} == {1: 1.0, 2: 2.0, 5: 3.5, 9: 6.0}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("code,name\nnan,Ünal�\n,x\n".encode())
    (tmp_path / "b.csv").write_bytes("code,name\nzz,Ünal\n".encode("latin-1"))
    assert [tuple(r) for r in files.read_csv_any(spark, str(tmp_path / "a.csv")).collect()] == [("nan", "Ünal�"), ("", "x")]
    assert [tuple(r) for r in files.read_csv_any(spark, str(tmp_path / "b.csv")).collect()] == [("zz", "Ünal")]
    assert files.columns_of(spark, str(tmp_path / "a.csv")) == ["code", "name"]
    assert files.preferred(spark, str(tmp_path / "none.csv"), str(tmp_path / "b.csv")).endswith("b.csv")
    with pytest.raises(FileNotFoundError):
        files.preferred(spark, str(tmp_path / "none.csv"))
    grid = tmp_path / "grid"
    grid.mkdir()
    (grid / "one_plain_out.csv").write_text("code,term\na,x\n")
    (grid / "two_judge_out.csv").write_text("code\nb\n")
    (grid / "other.csv").write_text("q\n1\n")
    got = files.read_grid(spark, str(grid), r"(\w+)_(plain|judge)_out\.csv", ["service", "variant"], ["code", "term"])
    assert sorted(map(tuple, got.collect())) == [("one", "plain", "a", "x"), ("two", "judge", "b", None)]
    assert files.read_grid(spark, str(grid), "nothing", [], ["code"]).count() == 0
    assert files.read_variant(spark, str(grid), "plain").first().file_name == "one_plain_out.csv"
    (tmp_path / "m.json").write_text(json.dumps({"main": {"en": {"x": "1"}, "de": {"x": "2", "y": "3"}}}))
    assert sorted(map(tuple, files.read_json_tree(spark, str(tmp_path / "m.json"), 2, ("main",)).collect())) == [("de", "x", "2"), ("de", "y", "3"), ("en", "x", "1")]
    (tmp_path / "flat.json").write_text('{"a": "1"}')
    assert [tuple(r) for r in files.read_json_map(spark, str(tmp_path / "flat.json")).collect()] == [("a", "1")]
    (tmp_path / "rows.json").write_text('[{"code": "a", "n": 1}, {"code": "b"}]')
    assert sorted(map(tuple, files.read_json_records(spark, str(tmp_path / "rows.json"), "code string, n int").collect())) == [("a", 1), ("b", None)]
    (tmp_path / "r.txt").write_text("File-Date: 1\n%%\nType: language\nDescription: one\n  two\n%%\nType: script\n")
    assert [tuple(r) for r in files.read_records(spark, str(tmp_path / "r.txt"), ["Type", "Description"]).collect()] == [("language", "one two"), ("script", None)]
    pages = spark.createDataFrame([(1, "<table><tr><th>A</th><th>B</th></tr><tr><td> x <b>y</b></td><td>z</td></tr><tr><td>junk</td></tr></table><table></table>"), (2, "none")], "page_id int, html string")
    assert [(r.row, r.cells) for r in html.first_table(pages, "page_id", junk="^junk$").collect()] == [(0, ["A", "B"]), (1, ["x y", "z"])]
    out = str(tmp_path / "out")
    files.append_evolving(spark.createDataFrame([(1, "a")], "k int, a string"), out)
    files.append_evolving(spark.createDataFrame([(2, 3)], "k int, b int"), out)
    log = files.read_evolving(spark, out)
    assert sorted((r.k, r.a, r.b) for r in log.collect()) == [(1, "a", None), (2, None, 3)]
    assert [r.k for r in logs.pending(spark.range(1, 4).select(F.col("id").cast("int").alias("k")), log, ["k"]).collect()] == [3]
    files.write_csv(log, str(tmp_path / "csv"), by=["k"])
    files.write_table(log, str(tmp_path / "t"), by=["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and files.read_csv(spark, str(tmp_path / "csv")).count() == 2
    assert files.write_with_backup(log, out, "1", dry_run=True) and files.write_with_backup(log.where("k = 2"), out, "1") == f"{out}.backup-1"
    assert spark.read.parquet(out).count() == 1 and spark.read.parquet(f"{out}.backup-1").count() == 2
    assert files.suffixed("flow", keywords=True, scripts=False) == "flow_no_keywords"
    both = files.preserve_failed(spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(1, "n")], "k int, v string"), "k")
    assert sorted(map(tuple, both.collect())) == [(1, "n"), (2, "o")]


def test_streams_of_windows(spark, tmp_path):
    schema = "k string, at timestamp"
    hours = [("a", 1), ("a", 2), ("a", 9), ("b", 1)]
    spark.createDataFrame([(k, datetime(2024, 1, 1, h)) for k, h in hours] + [("z", datetime(2024, 1, 9))], schema).coalesce(1).write.parquet(str(tmp_path / "log"))
    for name, make in (("slide", lambda s: logs.sliding_counts(s, "at", "1 hour", "4 hours", "2 hours", "k")), ("session", lambda s: logs.session_counts(s, "at", "1 hour", "3 hours", "k"))):
        query = make(logs.read_log(spark, str(tmp_path / "log"), schema)).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    sessions = spark.read.parquet(str(tmp_path / "session"))
    assert sorted((r.k, r.n) for r in sessions.collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert spark.read.parquet(str(tmp_path / "slide")).agg(F.sum("n")).first()[0] == 8
