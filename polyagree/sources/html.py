"""Tables in HTML as a browser lays them out, and the tables of codes that registries take from them.

A page is read by one task and in one pass over its tags; pages are rows, so Spark parts them. Null pages, and pages without a table, have no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyagree.operators.registry import valid_key

#: Fixed values of the HTML standard: the most columns and rows that a cell spans.
WIDEST, HIGHEST = 1000, 65534


#: Plain markup: text, a tag whose attributes need no decoding, or a comment without hyphens. Spaces are those of HTML.
_ATTRIBUTE = """[\t\n\r\f ]+([a-zA-Z-]+)(?:=(?:"([^"&<>]*)"|'([^'&<>]*)'|([^\t\n\r\f "'<>=`/&]+)))?"""
_PLAIN = re.compile(f"([^<]+)|<([a-zA-Z][a-zA-Z0-9]*)((?:{re.sub(r'[(](?![?])', '(?:', _ATTRIBUTE)})*)[\t\n\r\f ]*>|</([a-zA-Z][a-zA-Z0-9]*)[\t\n\r\f ]*>|<!--(?![->])[^-]*-->")
_GIVEN = re.compile(_ATTRIBUTE)
#: Elements whose text is no markup.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}
_SEEN = {"table", "tr", "td", "th", "br", "p", "div", "li"}


def _span(value: str | None, most: int) -> int:
    """A span as browsers read it: one where it is no number; 0, of rows, is all that are left."""
    digits = (value or "").strip()
    return min(int(digits[:9]), most) if digits.isascii() and digits.isdigit() else 1


class _Tables(HTMLParser):
    """Tables in the order they start, each a list of rows of [text, columns, rows]; the text of a table within a cell is not the cell's."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[list]]] = []
        self.inside: list[tuple[list, list | None]] = []  # tables that are open, with their open cell
        self.unseen = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # as browsers do; the base class raises an error for kinds it does not know

    def _cell(self, cell: list | None) -> None:
        self.inside[-1] = (self.inside[-1][0], cell)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.unseen += 1
        elif tag == "table":
            self.tables.append([])
            self.inside.append((self.tables[-1], None))
        elif self.inside:
            rows, cell = self.inside[-1]
            if tag == "tr":
                rows.append([])
                self._cell(None)
            elif tag in ("td", "th"):
                if not rows:
                    rows.append([])
                given = dict(attrs)
                rows[-1].append(["", _span(given.get("colspan"), WIDEST) or 1, _span(given.get("rowspan"), HIGHEST) or HIGHEST])
                self._cell(rows[-1][-1])
            elif tag in ("br", "p", "div", "li") and cell:
                cell[0] += " "

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.unseen = max(0, self.unseen - 1)
        elif self.inside and tag == "table":
            self.inside.pop()
        elif self.inside and tag in ("td", "th", "tr"):
            self._cell(None)

    def handle_data(self, data: str) -> None:
        if self.inside and self.inside[-1][1] and not self.unseen:
            self.inside[-1][1][0] += data


def _plain_tables(page: str) -> _Tables | None:
    """The tables of a page of plain markup, several times as fast as by the parser; None for any other page."""
    out, at = _Tables(), 0
    for m in _PLAIN.finditer(page):
        if m.start() != at:
            return None
        at = m.end()
        text, start, given, end = m.groups()
        if text:
            if out.inside:
                out.handle_data(unescape(text) if "&" in text else text)
        elif start:
            tag = start.lower()
            if tag in _SEEN:
                out.handle_starttag(tag, [(a[0].lower(), a[1] or a[2] or a[3]) for a in _GIVEN.findall(given)] if given else [])
            elif tag in _RAW:
                return None
        elif end:
            out.handle_endtag(end.lower())
    return out if at == len(page) else None


def read_tables(page: str) -> list[list[list[list]]]:
    """The tables of a page, as in _Tables. Only pages of other than plain markup need the parser."""
    found = _plain_tables(page)
    if found is None:
        found = _Tables()
        found.feed(page)
        found.close()
    return found.tables


def laid_out(rows: Iterable[list[list]]) -> Iterator[list[str]]:
    """The rows of a table as texts; a cell stands in every place that it spans, and places that no cell takes are empty."""
    over: dict[int, tuple[int, str]] = {}  # column: how many more rows a cell from above takes, and its text
    for cells in rows:
        places = {c: text for c, (_, text) in over.items()}
        over = {c: (n - 1, text) for c, (n, text) in over.items() if n > 1}
        at = 0
        for text, wide, high in cells:
            while at in places:
                at += 1
            text = " ".join(text.split())
            for c in range(at, at + wide):
                places.setdefault(c, text)  # where a cell from above is in the way, that one stays
                if high > 1:
                    over.setdefault(c, (high - 1, text))
            at += wide
        yield [places.get(c, "") for c in range(max(places, default=-1) + 1)]


def tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table, row, cells): every row of every table of each page; tables by the order in which they start, so one within another comes after it."""

    def read(batches):
        import pyarrow as pa

        def written(of, found):
            columns = [of, *(pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.list_(pa.string()))))]
            return pa.RecordBatch.from_arrays(columns, names=[key, "table", "row", "cells"])

        for batch in batches:
            pages, found, size = [], [], 0
            for i, page in enumerate(batch.column(1)):
                if page.is_valid:
                    for t, rows in enumerate(read_tables(page.as_py())):
                        for r, cells in enumerate(laid_out(rows)):
                            pages.append(i)
                            found.append((t, r, cells))
                            size += sum(map(len, cells)) + 64
                            if size > 1 << 22:
                                yield written(batch.column(0).take(pa.array(pages)), found)
                                pages, found, size = [], [], 0
            if found:
                yield written(batch.column(0).take(pa.array(pages)), found)

    rows = pages.select(F.col(key), F.col(html))
    return rows.mapInArrow(read, f"`{key}` {rows.schema[0].dataType.simpleString()}, table int, row int, cells array<string>")


def first_table(pages: DataFrame, key: str, html: str = "html", junk: str | None = None) -> DataFrame:
    """(key, row, cells) of the first table of each page; rows that match `junk`, and empty ones, are dropped."""
    cells = tables(pages, key, html).where((F.col("table") == 0) & (F.array_join("cells", "") != "")).drop("table")
    return cells if junk is None else cells.where(~F.array_join("cells", " ").rlike(junk))


def _first(rows: DataFrame, code: str, order: Sequence[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in (code, *order)]
    return rows.groupBy(code).agg(*(F.min_by(c, F.struct(*order)).alias(c) for c in others))


def code_rows(rows: DataFrame, order: Sequence[str], groups: Sequence[str], bibliographic: Mapping[str, str] | None = None) -> DataFrame:
    """(code, bibliographic, short, name, primary_name, is_group) of rows of cells: a code of three letters or two of them marked (B) and (T), a short code, a name.

    Rows of fewer than three cells or without such a code are none. The name before a semicolon is the primary one; a name with a word of
    `groups` is a group's. `bibliographic` gives the other code of a code that stands alone. Of rows of one code the first by `order` counts.
    """
    first = F.trim(F.get("cells", F.lit(0)))
    both = "^([a-z]{3})\\s*\\(B\\)\\s*([a-z]{3})\\s*\\(T\\)$"
    code = F.when(first.rlike(both), F.regexp_extract(first, both, 2)).when(first.rlike("^[a-z]{3}$"), first)
    known = F.create_map(*(F.lit(x) for pair in bibliographic.items() for x in pair))[first] if bibliographic else F.lit(None).cast("string")
    name = F.trim(F.get("cells", F.lit(2)))
    group = F.lit(False)
    for word in groups:
        group = group | F.contains(F.lower(name), F.lit(word))
    found = rows.where(code.isNotNull() & (F.size("cells") >= 3)).select(
        *order, code.alias("code"), F.coalesce(F.nullif(F.regexp_extract(first, both, 1), F.lit("")), known, F.lit("")).alias("bibliographic"),
        F.trim(F.get("cells", F.lit(1))).alias("short"), name.alias("name"), F.trim(F.split_part(name, F.lit(";"), F.lit(1))).alias("primary_name"), group.alias("is_group"),
    )
    return _first(found, "code", order)


def directed_rows(rows: DataFrame, order: Sequence[str], junk: Sequence[str] = ()) -> DataFrame:
    """(code, name, direction, local_name) of rows of cells in that order of columns: code, name, direction, local name.

    Rows whose code is none, or is one of `junk` in any case, are left out. A direction that holds `rtl` is rtl, else one that holds `ltr`
    is ltr, else it is empty. Of rows of one code the first by `order` counts.
    """
    cell = lambda i: F.coalesce(F.trim(F.get("cells", F.lit(i))), F.lit(""))
    way = F.lower(cell(2))
    direction: Column = F.when(F.contains(way, F.lit("rtl")), "rtl").when(F.contains(way, F.lit("ltr")), "ltr").otherwise("")
    found = rows.select(*order, cell(0).alias("code"), cell(1).alias("name"), direction.alias("direction"), cell(3).alias("local_name"))
    found = found.where((valid_key(F.col("code")) == "valid") & ~F.lower("code").isin(*(x.lower() for x in junk)))
    return _first(found, "code", order)
