"""Masks of rationales: what would tell a classifier the answer is taken out, in layers, by the row's own name, code and term as well.

All in the JVM: the patterns of all rows are one expression each, those of a row are made from its columns and taken out one after another.
Layers go in this order: names of variants and services; the source term, its phrase before its words; the language's name, its long words, its code; the
row's term and its long words.

Cases: a null or empty text is empty; a null or empty name, code or term masks nothing, and without a name the code does not either; what stands in a
name or term is taken as it is, signs too; single spaces are left where something was taken out.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyagree.functions import fixed as V
from polyagree.functions.text import stripped


@dataclass(frozen=True)
class Masks:
    """Which layers are masked."""

    metadata: bool = True
    source_words: bool = True
    source_phrase: bool = False
    names: bool = True
    terms: bool = False


PRESETS = {
    "NONE": Masks(False, False, False, False, False),
    "NAMES_ONLY": Masks(True, False, False, False, False),
    "STANDARD": Masks(),
    "AGGRESSIVE": Masks(True, True, True, True, True),
}


def _single(x: Column) -> Column:
    return stripped(F.regexp_replace(x, " {2,}", " "))


def _quoted(x: Column) -> Column:
    """A pattern that stands for exactly this text."""
    return F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _fixed(words) -> str:
    return "(?iU)\\b(?:" + "|".join(words) + ")\\b"


def _without_fixed(x: Column, words, before: Column) -> Column:
    """Without words in any case; the pattern is tried only where one of them, or a letter that it takes for one of ASCII, stood `before` other words were taken out, which bring none together."""
    low = F.lower(before)
    some = reduce(lambda a, b: a | b, [*(F.contains(low, F.lit(w)) for w in words), *(F.contains(before, F.lit(c)) for c in V.ODD_LETTERS)])
    return F.when(some, F.regexp_replace(x, _fixed(words), "")).otherwise(x)


def _without(x: Column, what: Column, whole: bool) -> Column:
    edge = "\\b" if whole else ""
    return F.regexp_replace(x, F.concat(F.lit(f"(?iU){edge}"), _quoted(what), F.lit(edge)), F.lit(""))


def _phrase_and_words(x: Column, phrase: Column, spared: tuple[str, ...] = ()) -> Column:
    """Without a phrase, and then without each of its words of more than three characters."""
    words = F.filter(F.split(stripped(phrase), "(?U)\\s+"), lambda w: (F.char_length(w) > 3) & (~F.lower(w).isin(*spared) if spared else F.lit(True)))
    return F.aggregate(words, _without(x, phrase, False), lambda text, w: _without(text, w, True))


def metadata(x: Column) -> Column:
    """Without the names of variants, then of services, as the judge is shown them."""
    return _single(_without_fixed(_without_fixed(x, V.VARIANT_TOKENS, x), V.SERVICE_TOKENS, x))


def source_term(x: Column, phrase: bool) -> Column:
    return _single(_without_fixed(F.regexp_replace(x, V.SOURCE_PHRASE, "") if phrase else x, V.SOURCE_WORDS, x))


def language_name(x: Column, name: Column, code: Column) -> Column:
    out = _phrase_and_words(x, name, V.SPARED_WORDS)
    out = F.when(F.char_length(code) >= 2, _without(out, code, True)).otherwise(out)
    return F.when(F.coalesce(name, F.lit("")) != "", _single(out)).otherwise(x)


def own_term(x: Column, term: Column) -> Column:
    return F.when(F.coalesce(term, F.lit("")) != "", _single(_phrase_and_words(x, term))).otherwise(x)


def _layers(masks: Masks, name: Column, code: Column, term: Column) -> list[tuple]:
    """The layers of `masks` in their order, each with what tells it from others."""
    out = []
    if masks.metadata:
        out.append(("metadata", metadata))
    if masks.source_words or masks.source_phrase:
        out.append((f"source{masks.source_phrase}", lambda x: source_term(x, masks.source_phrase)))
    if masks.names:
        out.append(("names", lambda x: language_name(x, name, code)))
    if masks.terms:
        out.append(("terms", lambda x: own_term(x, term)))
    return out


def masked(x: Column, masks: Masks, name: Column, code: Column, term: Column) -> Column:
    """A text under the layers of `masks`."""
    return reduce(lambda out, layer: layer[1](out), _layers(masks, name, code, term), F.coalesce(x, F.lit("")))


def masked_by(rows: DataFrame, x: Column, presets: Mapping[str, Masks], name: Column, code: Column, term: Column) -> DataFrame:
    """`rows` with a column masked_<preset> for each, its text under the preset's layers. Layers that presets begin with alike are taken out once."""
    kept, made, level = rows.columns, {k: () for k in presets}, {(): F.coalesce(x, F.lit(""))}
    layers = {k: _layers(m, name, code, term) for k, m in presets.items()}
    for depth in range(max(map(len, layers.values()), default=0) + 1):
        new = {}
        for k, todo in layers.items():
            if depth and len(todo) >= depth:
                path = (*made[k], todo[depth - 1][0])
                new[path], made[k] = todo[depth - 1][1](level[made[k]]), path
        level |= new
        at = {path: f"__masked_{depth}_{i}" for i, path in enumerate(new or level)} if depth == 0 or new else {}
        rows = rows.withColumns({at[path]: level[path] for path in at})
        level |= {path: F.col(n) for path, n in at.items()}
    return rows.select(*kept, *(level[made[k]].alias(f"masked_{k}") for k in presets))
