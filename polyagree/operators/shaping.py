"""Reshaping: wide to long and back, lists and dicts to rows and columns, trees to parents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melted(rows: DataFrame, key: list[str], columns: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """A row for each of `columns` of each row."""
    return rows.unpivot(key, list(columns), name, value)


def wide(rows: DataFrame, key: list[str], across: Mapping[str, Sequence], values: Sequence[str]) -> DataFrame:
    """One row a key, a column `value_a_b` for each combination of the values of two columns; of several rows for one, the least counts.

    The combinations are given, so the plan is one aggregate and not a pass to find them.
    """
    (first, ones), (second, twos) = across.items()
    cell = lambda v, a, b: F.min(F.when((F.col(first) == a) & (F.col(second) == b), F.col(v))).alias(f"{v}_{a}_{b}".lower())
    return rows.groupBy(*key).agg(*(cell(v, a, b) for a in ones for b in twos for v in values))


def parallel(rows: DataFrame, key: list[str], lists: Sequence[str]) -> DataFrame:
    """A row for each place of several lists beside one another, null where one is shorter."""
    return rows.select(*key, F.explode(F.arrays_zip(*lists)).alias("x")).select(*key, *(F.col("x").getField(c).alias(c) for c in lists))


def delimited(rows: DataFrame, column: str, separator: str = "\\s*[,;]\\s*") -> DataFrame:
    """A row for each part of a delimited text that is not blank, parts without spaces at the ends."""
    parts = F.filter(F.transform(F.split(column, separator), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumn(column, F.explode(parts))


def joined_in_order(rows: DataFrame, key: list[str], value: str, order: str, separator: str = "; ") -> DataFrame:
    """Values of a key in their order, repeats included, as one text."""
    listed = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(*key).agg(F.array_join(listed.getField(value), separator).alias(value))


def from_dict(rows: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """A column of dicts written as text, in JSON or with single quotes, as a column for each key."""
    text = F.when(F.get_json_object(column, "$").isNotNull(), F.col(column)).otherwise(F.regexp_replace(F.regexp_replace(column, "\\bNone\\b", "null"), "'", '"'))
    parsed = F.from_json(text, "map<string,string>")
    return rows.withColumns({k: parsed[k] for k in keys})


def transposed(rows: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Columns as rows (`field`) and the values of `label`, which are few, as columns."""
    long = melted(rows.select(label, *(F.col(c).cast("string") for c in columns)), [label], columns, "field", "x")
    return long.groupBy("field").pivot(label).agg(F.min("x"))


def last_dict(text: Column, key: str) -> Column:
    """The last `{...}` without braces inside it in a text that has the key."""
    return F.try_element_at(F.filter(F.regexp_extract_all(text, F.lit("\\{[^{}]*\\}"), 0), lambda x: F.contains(x, F.lit(f'"{key}"')) | F.contains(x, F.lit(f"'{key}'"))), F.lit(-1))


def list_or_one(text: Column) -> Column:
    """A list written as text, or a single value, as an array."""
    inner = F.regexp_replace(F.trim(text), "^\\[|\\]$", "")
    return F.when(F.trim(text).rlike("^\\[.*\\]$"), F.transform(F.filter(F.split(inner, "\\s*,\\s*"), lambda x: x != ""), lambda x: F.regexp_replace(x, "^['\"]|['\"]$", ""))).otherwise(F.array(F.trim(text)))


def parents(members: DataFrame, node: str, children: str) -> DataFrame:
    """(code, parent) of a table of nodes with lists of children; what is nobody's child has no parent, and of several parents the least counts."""
    down = members.select(F.explode(children).alias("code"), F.col(node).alias("parent"))
    every = members.select(F.col(node).alias("code")).union(down.select("code")).distinct()
    return every.join(down.groupBy("code").agg(F.min("parent").alias("parent")), "code", "left")


def totals(rows: DataFrame, row: str, column: str, value: Column) -> DataFrame:
    """(row, column, n) with `Total` for the sums over rows, columns and all: one pass over a cube."""
    return rows.cube(row, column).agg(value.alias("n"), F.grouping_id().alias("__g")).select(
        F.when(F.col("__g").isin(2, 3), "Total").otherwise(F.col(row).cast("string")).alias(row), F.when(F.col("__g").isin(1, 3), "Total").otherwise(F.col(column).cast("string")).alias(column), "n"
    )


def outer_chain(frames: Sequence[DataFrame], key: list[str]) -> DataFrame:
    """Aggregates by one key joined in a row, rows of any kept, numbers that lack zero."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), frames).na.fill(0)


def left_chain(base: DataFrame, frames: Sequence[DataFrame], key: list[str]) -> DataFrame:
    """`base` with the columns of aggregates by its key, zero where there is none."""
    return reduce(lambda a, b: a.join(b, key, "left"), frames, base).na.fill(0)


def natural(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Joined on all columns that both have."""
    return a.join(b, [c for c in a.columns if c in set(b.columns)], how)


def keeping_left(a: DataFrame, b: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    """Joined on the key; of other columns that both have, the left ones stay."""
    return a.join(b.select(*key, *(c for c in b.columns if c not in a.columns)), key, how)


def by_length(rows: DataFrame, code: str, tables: Mapping[int, DataFrame], value: str) -> DataFrame:
    """`rows` with `value`, looked up by the table (code, value) for codes of that length; null for others."""
    every = reduce(DataFrame.unionByName, (t.where(F.length("code") == n).select(F.col("code").alias(code), value) for n, t in tables.items()))
    return rows.join(every.dropDuplicates([code]), code, "left")


def first_match(rows: DataFrame, code: str, table: DataFrame, candidates: Sequence[str], value: str) -> DataFrame:
    """`rows` with the `value` of the row of `table` that has the code in one of the candidate columns, the first of them that has."""
    long = table.select(value, F.posexplode(F.array(*candidates)).alias("at", code)).where(F.col(code).isNotNull())
    return rows.join(long.groupBy(code).agg(F.min_by(value, F.struct("at", value)).alias(value)), code, "left")
