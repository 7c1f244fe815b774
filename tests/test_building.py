"""Tables in HTML, steps of a registry with odd rows, and errors beside signals."""

import pytest

from polyagree.operators import errors, registry_build
from polyagree.sources import html

PAGES = {
    1: "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>",
    2: "<table><tr><td colspan=3>a<td rowspan=0>z<tr><td>b<tr></table>",
    3: "<table><tr><td>out<table><tr><td>in</table>side</td><td>x</td></tr></table>",
    4: "<table><tr><td colspan='many' rowspan='-1'>a &amp;&nbsp;b<br>c</td><td></td></table>",
    5: "<!-- <table><tr><td>no</table> --><p>none</p>",
    6: "<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c<td rowspan=9>d</table><table><td>no row",
    7: "<table><![if x]><tr><td>a<script>'<td>'</script><![endif]><td>b",
    8: None,
    9: "",
    10: "</td></table><td>astray<table></table><table><tr></tr><tr><th>\n x \t y</th></tr></table>",
}
WANTED = {
    1: [["a", "b"], ["a", "c"]],
    2: [["a", "a", "a", "z"], ["b", "", "", "z"], ["", "", "", "z"]],
    4: [["a & b c", ""]],
    6: [["a", "a", "b"], ["a", "a", "c", "d"]],
    7: [["a", "b"]],
}


def test_tables_are_laid_out(spark):
    pages = spark.createDataFrame(list(PAGES.items()), "page_id long, html string").withColumnRenamed("page_id", "row key")
    found = {}
    for r in html.tables(pages, "row key").collect():
        found.setdefault((r[0], r.table), {})[r.row] = r.cells
    found = {k: [v[i] for i in sorted(v)] for k, v in found.items()}
    assert {k[0]: v for k, v in found.items() if k[1] == 0 and k[0] in WANTED} == WANTED
    assert found[3, 0] == [["outside", "x"]] and found[3, 1] == [["in"]]
    assert found[6, 1] == [["no row"]] and found[10, 1] == [[], ["x y"]]
    assert not {k for k, _ in found} & {5, 8, 9} and (10, 0) not in found
    assert html.tables(pages.limit(0), "row key").count() == 0


def test_spans_are_bounded(spark):
    page = spark.createDataFrame([(1, "<table><tr><td colspan=99999999999999999999>a</table>")], "page_id int, html string")
    assert [len(r.cells) for r in html.tables(page, "page_id").collect()] == [1000]


def test_tables_of_codes(spark):
    page = """<table><tr><th>codes<th>short<th>name</tr><tr><td>alb (B)<br>sqi (T)<td>sq<td>Albanian; Shqip<tr><td>aar<td>aa<td>Afar<tr><td>ger<td><td>German
    <tr><td>afa<td><td>Afro-Asiatic Languages<tr><td>qaa-qtz<td><td>Reserved<tr><td>aar<td><td>again<tr><td>abc<td>x</table>"""
    rows = html.first_table(spark.createDataFrame([(1, page)], "page_id int, html string"), "page_id")
    got = {r.code: r[1:] for r in html.code_rows(rows, ["page_id", "row"], ["languages"], {"ger": "deu"}).select("code", "bibliographic", "short", "name", "primary_name", "is_group").collect()}
    assert got == {
        "sqi": ("alb", "sq", "Albanian; Shqip", "Albanian", False), "aar": ("", "aa", "Afar", "Afar", False),
        "ger": ("deu", "", "German", "German", False), "afa": ("", "", "Afro-Asiatic Languages", "Afro-Asiatic Languages", True),
    }
    page = "<table><tr><td>ar<td>Arabic<td> RTL <td>x<tr><td>Total<td>y<tr><td>9<td>no<tr><td>ar<td>again<td>ltr<tr><td>en<td>English<td>ltr<td></table>"
    rows = html.first_table(spark.createDataFrame([(1, page)], "page_id int, html string"), "page_id")
    got = html.directed_rows(rows, ["page_id", "row"], ["TOTAL"]).select("code", "name", "direction", "local_name").collect()
    assert sorted(map(tuple, got)) == [("ar", "Arabic", "rtl", "x"), ("en", "English", "ltr", "")]


@pytest.fixture(scope="module")
def lists(spark):
    main = spark.createDataFrame([("ar", "Arabic", "Arab", 1, True, True), ("ar", "Zz", "Latn", 1, True, True), ("xyz", "xyz", None, None, None, None), (None, "gone", "", 0, True, True), ("9", "bad", "", 0, True, True)], "code string, name string, script string, n_scripts int, modern boolean, is_official boolean")
    community = spark.createDataFrame([("ar", "Arabic", "ltr", "loc"), ("xyz", "Xy", "rtl", None), ("dv", "Dhivehi", "rtl", "d")], "code string, name string, direction string, local_name string")
    official = spark.createDataFrame([("ara", "arb", "ar", "Arabic", False), ("xyz", "", "", "Xyz", None), ("new", "", "", "New", False), ("old", "oldb", "ol", "Old", False), ("grp", "", "", "Group", True)], "code string, bibliographic string, short string, primary_name string, is_group boolean")
    return main, community, official


def test_sources_merge(lists):
    got = {r.code: r for r in registry_build.merged(*lists, ["Arab"], ["old"]).collect()}
    assert sorted(got) == ["ar", "dv", "new", "ol", "xyz"]
    assert (got["ar"].official, got["ar"].direction, got["ar"].name, got["ar"].sources) == ("ara", "rtl", "Arabic", "main|short|official|community")
    assert (got["xyz"].direction, got["xyz"].sources, got["xyz"].modern, got["xyz"].n_scripts) == ("rtl", "main|official|community", False, 0)
    assert (got["dv"].sources, got["dv"].short) == ("community_only|short", "dv") and got["ol"].sources == "official_only" and got["ol"].bibliographic == "oldb"
    assert all(x is not None for r in got.values() for x in r)


def test_empty_lists(lists):
    out = registry_build.merged(*(x.limit(0) for x in lists), ["Arab"])
    assert out.count() == 0
    assert {r.source: r.added for r in registry_build.build_up(out, "code", {"short": out.in_short}).collect()} == {"short": 0, None: 0}


def test_families(spark, lists):
    rows = registry_build.merged(*lists, ["Arab"])
    groups = spark.createDataFrame([("sem", "afa", "Semitic"), ("afa", None, "Afro-Asiatic"), ("c1", "c2", "Circle"), ("c2", "c1", "Round"), ("new", "lost", "New group")], "code string, parent string, name string")
    hand = spark.createDataFrame([("ara", "sem"), ("dv", "isolate"), (None, "sem")], "code string, family_code string")
    read = spark.createDataFrame([("xyz", "c1", "Told"), ("ol", "", "Assessed"), ("ar", "c1", "not used")], "code string, family_code string, family_name string")
    out = registry_build.with_families(rows, groups, hand, read)
    got = {r.code: (r.family_direct, r.family_code, r.family_name, r.subfamily_name) for r in out.collect()}
    assert got["ar"] == ("sem", "afa", "Afro-Asiatic", "Semitic") and got["dv"][1:3] == ("isolate", "Language isolate")
    assert got["xyz"] == ("c1", "c1", "Circle", "Circle") and got["ol"] == ("", "", "Assessed", "Assessed") and got["new"] == ("new", "new", "New group", "New group")
    other = spark.createDataFrame([("ara", "afro-asiatic languages"), ("xyz", "Else"), ("new", "Other")], "code string, family string")
    decided = spark.createDataFrame([("Circle", "Else", "Chosen")], "family_name string, family_other string, chosen string")
    found = registry_build.reconciled(out, other, decided)
    assert {r.code: r.family_name_reconciled for r in found.collect()} == {"ar": "Afro-Asiatic", "dv": "Language isolate", "xyz": "Chosen", "ol": "Assessed", "new": "New group"}
    assert [tuple(r) for r in registry_build.undecided(found, decided).collect()] == [("New group", "Other", 1)]
    named = registry_build.named_from(out, spark.createDataFrame([("xyz", "Named"), ("ar", "not used")], "code string, name string"), {"zz": "z"})
    assert {r.code: r.name for r in named.collect()}["xyz"] == "Named" and {r.code: r.name for r in named.collect()}["ar"] == "Arabic"


def test_services_take_the_first_candidate(spark, lists):
    rows = registry_build.identified(registry_build.merged(*lists, ["Arab"]), {}, {"iw": "ol"})
    support = spark.createDataFrame([("alpha", "arb"), ("alpha", "ara"), ("alpha", "IW"), ("beta", "iw"), ("beta", ""), (None, "dv")], "service string, code string")
    got = {r.code: (r.alpha_code, r.alpha_supported, r.beta_code) for r in registry_build.matched(rows, support, ["alpha", "beta"]).collect()}
    assert got == {"ar": ("ara", True, ""), "ol": ("IW", True, "iw"), "dv": ("", False, ""), "new": ("", False, ""), "xyz": ("", False, "")}


def test_carried_on(spark):
    before = spark.createDataFrame([("a", "x", "2023", "2024"), ("b", "y", "2023", "2024")], "code string, name string, first_seen string, last_seen string")
    now = spark.createDataFrame([("b", "new"), ("c", "z")], "code string, name string")
    assert sorted(map(tuple, registry_build.carried_on(before, now, "2025").collect())) == [("a", "x", "2023", "2024"), ("b", "new", "2023", "2025"), ("c", "z", "2025", "2025")]


def test_errors_beside_signals(spark):
    signals = spark.createDataFrame([("a", "s"), ("a", "s"), ("a", "t"), ("b", "s"), (None, "s"), ("c", "else")], "k string, signal string")
    found = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "x", 2), ("c", "x", 1), (None, "x", 1), ("d", None, None)], "k string, kind string, service int")
    got = {(r.signal, r.kind): r.n for r in errors.signals_by_kind(signals, found, ["k"], ["s", "t"], ["x", "y"]).collect()}
    assert got == {("s", "x"): 2, ("s", "y"): 1, ("t", "x"): 1, ("t", "y"): 1}
    assert sum(r.n for r in errors.signals_by_kind(signals.limit(0), found, ["k"], ["s"], ["x", "y"]).collect()) == 0
    both = errors.several_services(found, ["k"], "service", found.kind == "x", found.kind == "y").collect()
    assert [tuple(r) for r in both] == [("b", 2, "1,2", 0, "")]


def test_openings(spark):
    rows = spark.createDataFrame([("p", "I am  sorry"), ("p", "i am"), ("p", "I am\tglad"), ("p", "No"), ("q", ""), ("q", None)], "by string, m string")
    got = sorted(map(tuple, errors.openings(rows, ["by"], rows.m, words=2, top=2).collect()))
    assert got == [("p", 1, "I am", 2, 0.5, 0.5), ("p", 2, "No", 1, 0.25, 0.75), ("q", 1, "", 2, 1.0, 1.0)]


def test_nan_is_a_code(spark):
    """`nan` is the code of Min Nan Chinese, in lists of codes and among those a tag is made of."""
    main = spark.createDataFrame([("aa", "Afar", "Latn", 1, True, False), ("", "none", "", 0, True, False), (None, "none", "", 0, True, False)], "code string, name string, script string, n_scripts int, modern boolean, is_official boolean")
    community = spark.createDataFrame([("de", "German", "ltr", "Deutsch")], "code string, name string, direction string, local_name string")
    official = spark.createDataFrame([("nan", "nan", "", "Min Nan Chinese", False), ("aar", "aar", "aa", "Afar", False)], "code string, bibliographic string, short string, primary_name string, is_group boolean")
    rows = registry_build.merged(main, community, official, ["Arab"])
    got = {r.code: r for r in registry_build.identified(rows, {}, {}).collect()}
    assert set(got) == {"aa", "de", "nan"} and (got["nan"].name, got["nan"].official, got["nan"].sources) == ("Min Nan Chinese", "nan", "official_only")
    assert (got["nan"].tag, got["nan"].tag_source, got["nan"].candidates) == ("nan", "long", ["nan"])


def test_plain_pages_need_no_parser():
    """A page of plain markup is read as the parser reads it; any other page is left to the parser."""
    plain = "<html><!-- <table> --><table class=a><TR><th rowspan=\"2\">a<br>1</th><td colspan=2> x &amp; <b>y</b><td><table><tr><td>in</table></td></tr>\n</table>"
    for page in [plain, "<table><td a=1 colspan='3'>&lt&", "<p>none", "", "<table></td>x<tr><th\tcolspan>z</div>"]:
        parser = html._Tables()
        parser.feed(page)
        parser.close()
        assert html._plain_tables(page).tables == parser.tables == html.read_tables(page)
    for page in ["<table><td>a<br/>b", "<!-- a-b --><table>", "<table><script>'<td>'</script>", "<table><td x='&amp;'>", "a < b", "<![if x]>", "<td colspan = 2>", "<title><table>"]:
        assert html._plain_tables(page) is None
