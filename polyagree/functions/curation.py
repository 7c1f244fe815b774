"""Repair of terms that mix scripts: placeholders and noise go, echoed source terms and romanisations are taken off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyagree.functions import fixed as V
from polyagree.functions import text as X

# How far a sign may stand from the start, and how long a remark in parentheses may be.
SPACE = f"[{V.WHITE}]*"
EQUATION = f"(?s)^([^=]{{1,100}}){SPACE}=+{SPACE}(.+)$"
COLON = f"(?s)^([^:]{{1,100}}):{SPACE}(.+)$"
WRAPPED = "(?s)^/+(.+?)/+$"
PARENTHESES = f"{SPACE}\\([^()]{{1,150}}\\)"
AFTER_SLASH = f"{SPACE}/{SPACE}[^\\n]+$"
#: Leading words of Latin letters and no others; marks and digits beside letters are let through. Possessive, so that a long text takes no stack.
LATIN_WORDS = "^\\s*+(?:(?=\\S*\\p{IsLatin})[\\p{IsLatin}[^\\p{L}\\s]]++\\s++)++"


def _part(x: Column, pattern: str, group: int) -> Column:
    return F.nullif(X.stripped(F.regexp_extract(x, pattern, group)), F.lit(""))


def _scripts(x: Column) -> Column:
    return F.map_keys(X.script_counts(x))


def curated(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with `<column>_curated` and `<column>_action`: unchanged, stripped, nulled or placeholder.

    Null and blank terms are unchanged. In order: a placeholder is null; `latin = term` and `/term/` lose their signs, repeated ones too; a term of one
    script stays; else the first form that does not mix scripts stands in: without parentheses, without what follows a slash,
    after a colon whose left side has nothing of the main script, after leading Latin words. Failing these it is null.
    """
    x, tried = F.col(column), "__tried"
    no_parens = X.stripped(F.regexp_replace(x, PARENTHESES, ""))
    after_colon = F.when(~F.array_contains(_scripts(_part(x, COLON, 1)), X.dominant_script(x)), _part(x, COLON, 2))
    after_latin = F.when(x.rlike(LATIN_WORDS), F.array_join(X.words(F.regexp_replace(x, LATIN_WORDS, "")), " "))
    forms = F.array(no_parens, X.stripped(F.regexp_replace(no_parens, AFTER_SLASH, "")), after_colon, after_latin)
    right = _part(x, EQUATION, 2)
    echoed = F.coalesce(F.contains(x, F.lit("=")) & (F.array_join(_scripts(_part(x, EQUATION, 1)), ",") == "Latin") & ~X.is_mixed(right), F.lit(False))
    fine = lambda c: c.isNotNull() & (c != "") & ~X.is_mixed(c)
    action = (
        F.when(x.isNull() | (X.stripped(x) == ""), "unchanged").when(X.is_placeholder(x), "placeholder")
        .when(echoed | _part(x, WRAPPED, 1).isNotNull(), "stripped").when(~X.is_mixed(x), "unchanged")
        .when(F.col(tried).isNotNull(), "stripped").otherwise("nulled")
    )
    out = rows.withColumn(tried, F.when(X.is_mixed(x), F.get(F.filter(forms, fine), F.lit(0)))).withColumn(f"{column}_action", action)
    kept = F.when(F.col(f"{column}_action") == "unchanged", x).when(
        F.col(f"{column}_action") == "stripped", F.when(echoed, right).otherwise(F.coalesce(_part(x, WRAPPED, 1), F.col(tried)))
    )
    return out.withColumn(f"{column}_curated", kept).drop(tried)


def action_counts(rows: DataFrame, column: str, by: str) -> DataFrame:
    """How many terms of each `by` are unchanged, stripped, nulled and placeholders."""
    kinds = ["unchanged", "stripped", "nulled", "placeholder"]
    marked = curated(rows.where(X.present(F.col(column))), column)
    return marked.groupBy(by).agg(*(F.count_if(F.col(f"{column}_action") == k).alias(k) for k in kinds))
