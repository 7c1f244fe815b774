"""Column functions on short multilingual texts. All run in the JVM but `folded` and `unescaped`, which Spark lacks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from polyagree.functions import fixed as V

#: Latin letters beyond ASCII that most texts have.
LATIN_LETTERS = "\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u024F"
#: What is of no script where scripts are compared.
NO_LETTERS = "\\p{Z}\\p{P}\\p{S}\\p{C}\\p{Nd}"
#: Where scripts are compared, Han and the Japanese ones are one.
#: Scripts that are looked for in any text beyond Latin letters; the others only where it has a letter of none of these.
COMMON_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Thai", "CJK", "Japanese", "Korean")
MERGED = {"CJK": ["CJK", "Japanese"], **{k: [k] for k in V.SCRIPTS if k not in ("CJK", "Japanese")}}


def let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def any_of(patterns) -> str:
    """One pattern, in any case and with Unicode's letters, of several."""
    return "(?iU)" + "|".join(f"(?:{p})" for p in ([patterns] if isinstance(patterns, str) else patterns))


def says(x: Column, patterns) -> Column:
    """Whether a text holds one of the patterns; a null one does not. Where it is known what pieces they hold, a pattern is tried only on texts with one."""
    found = x.rlike(any_of(patterns))
    if isinstance(patterns, str) and patterns in V.PIECES:
        low = F.lower(x)
        found = reduce(lambda a, b: a | b, [*(F.contains(low, F.lit(p)) for p in V.PIECES[patterns]), *(F.contains(x, F.lit(c)) for c in V.ODD_LETTERS)]) & found
    return F.coalesce(found, F.lit(False))


def present(x: Column) -> Column:
    """Neither null nor blank nor a missing value written out."""
    return x.isNotNull() & ~F.lower(stripped(x)).isin("", "nan", "none", "null")


def stripped(x: Column) -> Column:
    """Without white space of any kind at the edges."""
    return F.btrim(x, F.lit(V.WHITE))


def difference(a: Column, b: Column, rtl: Column | None = None) -> Column:
    """Why two texts differ: identical, capitalization, whitespace, both or content. Scripts written right to left have no case: what is alike but for case and edges is whitespace there."""
    ltr = F.lit(True) if rtl is None else ~rtl
    alike = F.lower(stripped(a)) == F.lower(stripped(b))
    return (
        F.when(a == b, "identical")
        .when(ltr & (F.lower(a) == F.lower(b)), "capitalization")
        .when(alike & ((stripped(a) == stripped(b)) | ~ltr), "whitespace")
        .when(alike, "both")
        .otherwise("content")
    )


def tier_of_differences(kinds: Column) -> Column:
    """From the array of kinds: all_identical, trivial_only or has_content."""
    return F.when(F.size(F.array_except(kinds, F.array(F.lit("identical")))) == 0, "all_identical").when(F.array_contains(kinds, "content"), "has_content").otherwise("trivial_only")


def ascii_normalised(x: Column) -> Column:
    """Lower case, no marks, single spaces: what `folded` gives for ASCII."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[^\\w\\s]", ""), "\\s+", " "))


def normal(x: Column, form: str = "NFKD", casefold: bool = False) -> Column:
    """Unicode normalisation of lower-cased text; NFKD also drops combining marks. Arrow, as Spark has no such function."""

    @F.arrow_udf("string")
    def of(texts):
        import unicodedata

        import pyarrow as pa

        class Marks(dict):
            """For str.translate: a mark goes, any other character stays; each is looked up once."""

            def __missing__(self, c):
                self[c] = None if unicodedata.combining(chr(c)) else c
                return self[c]

        marks = Marks()

        def one(t):
            if t is None:
                return ""
            t = unicodedata.normalize(form, t.casefold() if casefold else t.lower())
            return t.translate(marks) if form == "NFKD" and not t.isascii() else t

        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return of(x)


def folded(x: Column) -> Column:
    """Lower case, no marks of letters, nothing but words and single spaces. Text that is ASCII does not leave the JVM: Python gets null for it, as it is called for every row."""
    other = x.rlike("[^\\x00-\\x7F]")
    words_only = lambda t, flags: F.trim(F.regexp_replace(F.regexp_replace(t, flags + "[^\\w\\s]", ""), flags + "\\s+", " "))
    return F.when(other, words_only(normal(F.when(other, x)), "(?U)")).otherwise(words_only(F.lower(F.coalesce(x, F.lit(""))), ""))


def unescaped(x: Column) -> Column:
    @F.arrow_udf("string")
    def of(texts):
        import html

        import pyarrow as pa

        return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())

    return of(x)


def words(x: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(x, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def opening(x: Column, n: int = 8) -> Column:
    return F.array_join(F.slice(words(x), 1, n), " ")


def is_placeholder(x: Column) -> Column:
    return says(x, V.PLACEHOLDER_TERMS)


def is_empty_rationale(x: Column) -> Column:
    return ~present(x) | F.lower(F.rtrim(stripped(x), F.lit("."))).isin(*V.EMPTY_RATIONALES)


def is_refusal(x: Column) -> Column:
    return says(x, V.REFUSAL)


def is_transliteration(x: Column) -> Column:
    return says(x, V.TRANSLITERATION)


def is_placeholder_rationale(x: Column) -> Column:
    return says(x, V.PLACEHOLDER_RATIONALE)


def is_aware(x: Column) -> Column:
    return says(x, V.AWARE)


def keywords(x: Column, family: str) -> Column:
    """The keywords of a family of V.SIGNALS that a rationale holds, in their order. What a keyword says word for word is looked up first, and a pattern tried only where all of it stands."""

    def of(low: Column) -> Column:
        def held(k: str) -> Column:
            parts = [p for p in re.split(r"\\b|\.\*", k) if p]
            if not all(re.fullmatch("[a-z' -]+", p) for p in parts):
                return says(low, k)
            each = reduce(lambda a, b: a & b, (F.coalesce(F.contains(low, F.lit(p)), F.lit(False)) for p in parts))
            return each if parts == [k] else each & says(low, k)

        return F.array_compact(F.array(*(F.when(held(k), F.lit(k)) for k in V.SIGNALS[family])))

    return let(F.lower(x), of)


def comparable(x: Column, marks: str = V.EDGE_MARKS) -> Column:
    """For exact comparison: NFKC, case folded, single spaces, no marks at the edges; empty if there is no text."""
    plain = F.trim(F.regexp_replace(normal(x, "NFKC", True), "(?U)\\s+", " "))
    return F.when(present(x), F.btrim(plain, F.lit(marks))).otherwise("")


def is_language_name(x: Column, name: Column) -> Column:
    """The term is the language's name, or holds it as whole words."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "(?U)[^\\w]+", " "))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    t, n = plain(x), plain(name)
    return F.coalesce((t != "") & (n != "") & F.contains(padded(t), padded(n)), F.lit(False))


def has_foreign_rationale(x: Column, least: int = 20) -> Column:
    """Twenty letters or more, of which less than half are Latin."""
    letters = F.char_length(F.regexp_replace(x, "[^\\p{L}]", ""))
    latin = F.char_length(F.regexp_replace(x, "[^\\p{IsLatin}]", ""))
    return F.coalesce((letters >= least) & (2 * latin < letters), F.lit(False))


def slug(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit(" "), F.lit("_"))


def edit_kind(before: Column, after: Column, source: str) -> Column:
    """What a correction did; the first that holds."""
    a, b = stripped(before), stripped(after)
    return (
        F.when(b == F.regexp_replace(a, "(?U)^[\\s\\W]+|[\\s\\W]+$", ""), "strip_punctuation")
        .when(F.contains(a, F.lit(source)) & ~F.contains(b, F.lit(source)), "remove_source_wrapper")
        .when(F.startswith(a, F.lit("/")) & (b == F.substr(a, F.lit(2))), "remove_leading_slash")
        .when(a.rlike("\\(.+\\)$") & (b == F.trim(F.regexp_replace(a, "\\s*\\(.+\\)$", ""))), "strip_trailing_parenthetical")
        .otherwise("other")
    )


def name_difference(a: Column, b: Column) -> Column:
    """How two names of one thing differ: same, case, qualifier (one holds the other) or substantive."""
    x, y = F.lower(stripped(a)), F.lower(stripped(b))
    return F.when(a == b, "same").when(x == y, "case").when(F.contains(x, y) | F.contains(y, x), "qualifier").otherwise("substantive")


def short_family(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), "(?i)\\s+(languages?|family)$", "")


def canonical_tag(x: Column) -> Column:
    """A language tag with hyphens: language lower, script with a capital, region upper."""
    parts = F.split(F.replace(F.trim(x), F.lit("_"), F.lit("-")), "-")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).when(F.length(p) == 4, F.initcap(p)).when(F.length(p) == 2, F.upper(p)).otherwise(F.lower(p))), "-")


def bins(x: Column, edges: list, labels: list[str]) -> Column:
    """The label of the bin, closed to the right, that a number lies in; null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed([*zip(edges, edges[1:], labels)]):
        out = F.when((x > low) & (x <= high), label).otherwise(out)
    return out


def most_repeated(tokens: Column) -> Column:
    """How often the commonest of the tokens comes: the longest run of them in order."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, t: Column) -> Column:
        run = F.when(a["last"] == t, a["run"] + 1).otherwise(1)
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(F.sort_array(tokens), start, step, lambda a: a["best"])


def loop_facts(x: Column) -> Column:
    """Struct of n (words) and loop (is_repetition_loop()). Words are split once, and put in order only where some word may come four times and make up 30 %."""

    def of(w: Column) -> Column:
        n = F.size(w)
        again = n - F.size(F.array_distinct(w))  # a word that comes k times leaves k - 1 at least
        loops = F.when((n < 4) | let(again, lambda k: (k < 3) | (k + 1 < 0.3 * n)), False).otherwise(let(most_repeated(w), lambda top: (top >= 4) & (top >= 0.3 * n)))
        return F.struct(n.alias("n"), loops.alias("loop"))

    return let(words(F.lower(x)), of)


def is_repetition_loop(x: Column) -> Column:
    """Four tokens or more, of which one comes four times or more and makes up 30 %."""
    return loop_facts(x)["loop"]


def is_extreme_length(x: Column, most: int = 100) -> Column:
    return F.coalesce(F.char_length(stripped(x)) > most, F.lit(False))


def is_short(x: Column) -> Column:
    return F.coalesce(F.char_length(stripped(x)).between(1, 3), F.lit(False))


def has_escape(x: Column) -> Column:
    return F.coalesce(x.rlike("\\\\u[0-9a-fA-F]{4}"), F.lit(False))


def is_search_unsafe(x: Column) -> Column:
    return F.coalesce(x.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"), F.lit(False))


def source_tokens(source: str) -> list[str]:
    """The term in lower case, its words, and its initials if it has two words or more; each once."""
    parts = source.lower().split()
    return list(dict.fromkeys([" ".join(parts), *parts, *(["".join(w[0] for w in parts)] if len(parts) > 1 else [])]))


def leaks_source(x: Column, source: str) -> Column:
    """The source term stands in the text, in any case, or its initials as a word of capitals."""
    initials = "".join(w[0].upper() for w in source.split())
    found = F.contains(F.lower(x), F.lit(source.lower()))
    return F.coalesce(found | x.rlike(f"\\b\\Q{initials}\\E\\b") if len(initials) > 1 else found, F.lit(False))


def is_real_translation(x: Column, source: str) -> Column:
    """There is a term, and it is neither the source's, nor holds it, nor a placeholder."""
    return present(x) & ~F.coalesce(F.lower(stripped(x)) == source.lower(), F.lit(False)) & ~leaks_source(x, source) & ~is_placeholder(x)


def _class(names) -> str:
    return "".join(f"\\p{{Is{n}}}" for n in names)


def script_entries(x: Column, merged: bool = False) -> Column:
    """Array of (script, n, distinct, first) of the scripts of a text: letters, different ones, and the first one's place.

    Spaces, marks, symbols, controls and digits do not count. What is of no script known is `Other`, unless `merged`, when Han
    and the Japanese scripts are one. Which scripts there are is looked up among the different letters, which are few; a whole text is
    read only for those that it has. Rare scripts are looked for only where a letter is of no common one.
    """
    groups = MERGED if merged else {k: [k] for k in V.SCRIPTS}
    java = {k: _class(n for m in v for n in V.SCRIPTS[m]) for k, v in groups.items()}
    every = "".join(java.values())
    none = F.lit(None).cast("struct<script:string,n:int,distinct:int,first:int>")

    def of(kept: Column) -> Column:
        def entries(each: Column) -> Column:
            def entry(name: str, others: str, own: str) -> Column:
                size = lambda chars: F.char_length(F.regexp_replace(chars, f"[{others}]", ""))
                made = F.struct(F.lit(name).alias("script"), size(kept).alias("n"), size(each).alias("distinct"), F.regexp_instr(kept, F.lit(f"[{own}]")).alias("first"))
                return F.when(each.rlike(f"[{own}]"), made)

            def beyond(rare: Column) -> Column:
                other = none if merged else F.when(rare, entry("Other", every, f"^{every}"))
                return F.array(other, *(entry(k, f"^{c}", c) if k in COMMON_SCRIPTS else F.when(rare, entry(k, f"^{c}", c)) for k, c in java.items() if k != "Latin"))

            common = "".join(java[k] for k in COMMON_SCRIPTS if k in java)
            found = F.when(each.rlike("\\P{IsLatin}"), let(each.rlike(f"[^{common}]"), beyond)).otherwise(F.array(none))
            return F.array_compact(F.concat(F.array(entry("Latin", f"^{java['Latin']}", java["Latin"])), found))

        return let(F.array_join(F.array_distinct(F.split(kept, "")), ""), entries)

    return let(F.regexp_replace(F.coalesce(x, F.lit("")), f"[{NO_LETTERS}]", ""), of)


def script_counts(x: Column) -> Column:
    """Map of scripts to numbers of letters, those that occur; Chinese and Japanese ones are one."""
    return F.map_from_entries(F.transform(script_entries(x, merged=True), lambda e: F.struct(e["script"], e["n"])))


def _main(entries: Column) -> Column:
    return F.array_max(F.transform(entries, lambda e: F.struct(e["n"].alias("n"), (-e["first"]).alias("place"), e["script"].alias("script"))))["script"]


def dominant_script(x: Column, merged: bool = False) -> Column:
    """The script of most letters, of equals the one seen first; Unknown without a letter. Text of ASCII and Latin letters alone is not counted."""
    simple = F.when(x.rlike(f"[A-Za-z{LATIN_LETTERS}]"), "Latin").otherwise("Unknown")
    return F.when(x.rlike(f"[^\\x00-\\x7F{LATIN_LETTERS}]"), F.coalesce(_main(script_entries(x, merged)), F.lit("Unknown"))).otherwise(simple)


def script_mix(x: Column) -> Column:
    """Struct of dominant, secondary (script, n, distinct, share), any (a second script of a tenth) and mixed.

    Mixed: a second script of a tenth of the letters with five different ones, or of a fifth with three.
    """

    def of(entries: Column) -> Column:
        total = F.aggregate(entries, F.lit(0), lambda a, e: a + e["n"])
        main = F.coalesce(_main(entries), F.lit("Unknown"))
        share = lambda e: e["n"] / F.greatest(total, F.lit(1))
        second = F.transform(F.filter(entries, lambda e: e["script"] != main), lambda e: F.struct(e["script"].alias("script"), e["n"].alias("n"), e["distinct"].alias("distinct"), F.round(share(e), 6).alias("share")))
        wide = F.filter(second, lambda e: e["n"] >= V.MIXED_SHARE * total)
        mixed = F.exists(wide, lambda e: (e["distinct"] >= V.MANY_LETTERS) | ((e["distinct"] >= V.SOME_LETTERS) & (e["n"] >= V.LARGE_SHARE * total)))
        return F.struct(main.alias("dominant"), second.alias("secondary"), (F.size(wide) > 0).alias("any"), mixed.alias("mixed"))

    return let(script_entries(x, merged=True), of)


def mix(x: Column) -> Column:
    """script_mix() of text with letters of more than one script, else null. One pattern tells most texts of one script."""
    alone = "|".join(f"[{_class(n for m in v for n in V.SCRIPTS[m])}{NO_LETTERS}]*+\\z" for k, v in MERGED.items() if k in COMMON_SCRIPTS)
    return F.when(x.rlike(f"[^\\x00-\\x7F{LATIN_LETTERS}]") & ~x.rlike(f"\\A(?:{alone})"), script_mix(x))


def is_mixed(x: Column) -> Column:
    """Mixed as in script_mix(); text of one script is not looked at further."""
    return F.coalesce(mix(x)["mixed"], F.lit(False))


def has_any_mixing(x: Column) -> Column:
    """`any` of script_mix(); text of one script is not looked at further."""
    return F.coalesce(mix(x)["any"], F.lit(False))


def is_mixed_at_all(x: Column, share: float = V.MIXED_SHARE) -> Column:
    """The letters that are not of the main script make up a tenth or more together."""

    def of(entries: Column) -> Column:
        total = F.aggregate(entries, F.lit(0), lambda a, e: a + e["n"])
        most = F.coalesce(F.array_max(F.transform(entries, lambda e: e["n"])), F.lit(0))
        return (total > 0) & (total - most >= share * total)

    return let(script_entries(x, merged=True), of)


def is_repeated_output(x: Column) -> Column:
    """An error message that wraps a term which goes on in a circle: few different characters, or a short piece five times or more."""
    term = F.regexp_replace(F.regexp_extract(x, V.REPEATED_TERM, 1), '["} \\n\\r\\t]+$', "")

    def of(t: Column) -> Column:
        size = F.char_length(t)
        longest = F.least(F.floor(size / 4), F.lit(11)).cast("int")
        times = lambda piece: (size - F.char_length(F.replace(t, piece, F.lit("")))) / F.greatest(F.char_length(piece), F.lit(1))
        pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.transform(F.sequence(F.lit(2), F.greatest(longest, F.lit(2))), lambda n: F.substring(t, i, n))))
        few = F.size(F.array_distinct(F.split(t, ""))) < 0.15 * size
        return (size >= 20) & (few | F.exists(pieces, lambda p: (p != "") & (times(p) >= 5)))

    return F.coalesce(let(term, of), F.lit(False))


def message(x: Column) -> Column:
    """An error message without the mark of a reply that was not parsed."""
    return stripped(F.replace(x, F.lit(V.PARSE_PREFIX), F.lit("")))


def is_blank(x: Column) -> Column:
    return F.coalesce(stripped(x) == "", F.lit(True))


def error_kind(x: Column) -> Column:
    """The kind of an error message: unknown if blank, a term in a circle, a reply that was not parsed, or by the first keyword found."""
    text = message(x)
    out = F.when(is_blank(x), "unknown").when(is_repeated_output(x), "repetition_loop").when(F.startswith(text, F.lit("{")) | F.contains(text, F.lit('"translated_term"')), "parse_format")
    for kind, keys in V.ERROR_KINDS.items():
        out = out.when(says(text, [f"\\Q{k}\\E" for k in keys]), kind)
    return out.otherwise("other")


def error_layer(kind: Column) -> Column:
    return F.create_map(*(F.lit(v) for pair in V.ERROR_LAYERS.items() for v in pair))[kind]


def error_status(x: Column) -> Column:
    """A status for a failed request: 429 for quotas, 400 for what was not supported, refused or not parsed, else 500."""
    kind = error_kind(x)
    return F.when(says(x, ["quota", "rate limit", "429"]), 429).when(says(x, ["unsupported", "not supported"]) | kind.isin("generic_refusal", "knowledge_gap", "parse_format"), 400).otherwise(500)


def signature(x: Column, source: str = "the source term", most: int = 180) -> Column:
    """An error message without what changes from one to the next: fences, terms, rationales, languages, numbers, long runs."""
    text = message(x)
    for pattern, by in V.SIGNATURE_STEPS:
        text = F.regexp_replace(text, pattern.replace("%s", source), by.replace("%s", source))
    return F.when(is_blank(x), "<empty>").otherwise(F.substring(F.trim(text), 1, most))


def parsed_reply(x: Column) -> Column:
    """Struct of term, rationale and status of a model's answer.

    An object in JSON, fenced or bare, whose strings may have line ends and tabs in them; else, in a short answer, its first object with
    single quotes; else the term's field wherever it stands, as in an answer that was cut off, and the rationale's. The proper key of a
    field goes before its near misses. status: empty, parsed, refused (no term in an object, or an empty one), saved (a field of what is
    no object), too_long (saved, and longer than a term is), unparsed. The term is as it was given, and null unless parsed or saved.
    """
    bare = F.regexp_replace(stripped(F.regexp_replace(stripped(x), "(?i)^```(?:json)?\\s*", "")), "```\\s*$", "")
    first = F.regexp_extract(x, "(?s)\\{[^{}]*\\}", 0)
    read = lambda text, quotes: F.from_json(text, "map<string,string>", {"allowUnquotedControlChars": "true", "allowSingleQuotes": quotes, "allowBackslashEscapingAnyCharacter": quotes})
    made = F.coalesce(F.when(F.startswith(bare, F.lit("{")) & bare.rlike("\\}\\s*$"), read(bare, "false")), F.when((F.char_length(x) < V.SHORT_REPLY) & (first != ""), read(first, "true")))
    string = '"([^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+)"'
    found = lambda keys: F.regexp_extract(x, f"(?s)['\"](?:{'|'.join(keys)})['\"]\\s*:\\s*{string}", 1)

    def key_of(map_: Column, keys: list[str]) -> Column:
        out = F.lit(None).cast("string")
        for k in reversed(keys):
            out = F.when(F.map_contains_key(map_, k), map_[k]).otherwise(out)
        return out

    def of(m: Column) -> Column:
        saved = F.replace(F.replace(found(V.TERM_KEYS), F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))
        there = x.rlike(f"(?s)['\"](?:{'|'.join(V.TERM_KEYS)})['\"]\\s*:\\s*{string}")
        term = F.when(m.isNotNull(), key_of(m, V.TERM_KEYS)).when(there, saved)
        why = F.when(m.isNotNull(), key_of(m, V.RATIONALE_KEYS)).otherwise(F.nullif(F.replace(found(V.RATIONALE_KEYS[:1]), F.lit('\\"'), F.lit('"')), F.lit("")))
        status = (
            F.when(is_blank(x), "empty").when(m.isNull() & ~there, "unparsed").when(term.isNull() | (term == ""), "refused")
            .when(m.isNotNull(), "parsed").when(F.char_length(term) > V.LONG_TERM, "too_long").otherwise("saved")
        )
        return F.struct(F.when(status.isin("parsed", "saved"), term).alias("term"), F.coalesce(why, F.lit(V.NO_RATIONALE)).alias("rationale"), status.alias("status"))

    return let(made, of)


def first_present(*columns: Column) -> Column:
    return F.coalesce(*(F.when(present(c), stripped(c)) for c in columns), F.lit("Other"))


def lenient_time(x: Column) -> Column:
    """A time written as text; null where it is none."""
    return F.try_to_timestamp(x)


def is_suspicious(term: Column, languages: Column) -> Column:
    """A search term in ASCII alone that only one language gives."""
    return F.coalesce(term.rlike("^[\\x00-\\x7F]+$") & (languages == 1), F.lit(False))


def is_short_search(term: Column, least: int = 4) -> Column:
    """A search term of fewer code points than are worth a search; an empty one is none."""
    return F.coalesce(F.char_length(term).between(1, least - 1), F.lit(False))
