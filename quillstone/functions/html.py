"""HTML functions: stripping and links by built-in expressions; tables, sections and trees by a tolerant parser in Arrow UDFs."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.udf import arrow_udf

_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def strip_html(html: Column) -> Column:
    """Without scripts, styles and tags; common entities decoded; white space to one space, trimmed."""
    out = html
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, plain in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def hrefs(html: Column) -> Column:
    """All href values of anchors, as written."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"'#]+)(?:#[^\"']*)?[\"']"), F.lit(1))


@arrow_udf("array<string>")
def _resolve(base: pd.Series, found: pd.Series) -> pd.Series:
    def one(b, links):
        out = []
        for link in links if links is not None else []:
            link = link.strip()
            if link and not link.lower().startswith(("mailto:", "javascript:", "tel:", "data:")):
                try:
                    full = urljoin(b or "", link).split("#")[0]
                except ValueError:
                    continue
                if full not in out:
                    out.append(full)
        return out

    return pd.Series([one(b, x) for b, x in zip(base, found, strict=True)])


def links(base: Column, html: Column) -> Column:
    """Distinct absolute links of a page, in order; other schemes and fragments are left out."""
    return _resolve(base, hrefs(html))


def link_rows(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    return pages.select(F.col(url).alias("source"), F.posexplode(links(F.col(url), F.col(html))).alias("position", "target"))


class _Tables(HTMLParser):
    """Cells of all tables, with spans; nested tables count as text of the cell they are in."""

    def __init__(self):
        super().__init__()
        self.tables, self.depth, self.cell = [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th") and self.tables[-1]:
            given = dict(attrs)
            span = lambda k: max(1, int(given[k])) if (given.get(k) or "").isdigit() else 1
            self.cell = [tag == "th", min(span("rowspan"), 1000), min(span("colspan"), 100), []]
            self.tables[-1][-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth = max(0, self.depth - 1)
        if self.depth <= 1 and tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[3].append(data)


def table_grid(rows: list) -> list[list[tuple[bool, str]]]:
    """Every place of a table filled: a spanning cell repeats over the rows and columns it covers."""
    grid: list[dict[int, tuple[bool, str]]] = [{} for _ in rows]
    for r, row in enumerate(rows):
        c = 0
        for head, down, across, parts in row:
            while c in grid[r]:
                c += 1
            text = " ".join("".join(parts).split())
            for y in range(r, min(len(rows), r + down)):
                for x in range(c, c + across):
                    grid[y].setdefault(x, (head, text))
            c += across
    width = max((max(g) + 1 for g in grid if g), default=0)
    return [[g.get(x, (False, "")) for x in range(width)] for g in grid]


def table_lines(html: str) -> list[str]:
    """A line for each body row of each table: `header path: value` for every filled cell, joined by `; `."""
    parser = _Tables()
    parser.feed(html or "")
    out = []
    for rows in parser.tables:
        grid = table_grid(rows)
        heads = 0
        while heads < len(grid) and grid[heads] and all(h for h, _ in grid[heads]):
            heads += 1
        paths = []
        for x in range(len(grid[0]) if grid else 0):
            path = []
            for y in range(heads):
                if grid[y][x][1] and (not path or path[-1] != grid[y][x][1]):
                    path.append(grid[y][x][1])
            paths.append(" > ".join(path))
        for row in grid[heads:]:
            cells = [f"{p}: {v}" if p else v for p, (_, v) in zip(paths, row, strict=True) if v]
            if cells:
                out.append("; ".join(cells))
    return out


@arrow_udf("array<string>")
def table_texts(html: pd.Series) -> pd.Series:
    return html.map(table_lines)


class _Tree(HTMLParser):
    """Balanced slices by id, and the nested lists of a table of contents."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, wanted: str | None = None):
        super().__init__(convert_charrefs=True)
        self.wanted, self.depth, self.start, self.text = wanted, 0, None, []
        self.items, self.lists, self.open = [], 0, []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag not in self.VOID:
            self.depth += 1
            if self.start is None and self.wanted is not None and given.get("id") == self.wanted:
                self.start = self.depth
        if tag in ("ul", "ol"):
            if self.open:
                self.items[self.open[-1]]["has_children"] = True
            self.lists += 1
        elif tag == "li":
            self.items.append({"level": self.lists, "id": given.get("id"), "link": None, "heading": "", "has_children": False, "parent": self.open[-1] if self.open else None})
            self.open.append(len(self.items) - 1)
        elif tag == "a" and self.open and self.items[self.open[-1]]["link"] is None:
            self.items[self.open[-1]]["link"] = given.get("href")

    def handle_endtag(self, tag):
        if tag in self.VOID:
            return
        if self.start is not None and self.depth == self.start:
            self.start = -1
        self.depth = max(0, self.depth - 1)
        if tag in ("ul", "ol"):
            self.lists = max(0, self.lists - 1)
        elif tag == "li" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.start is not None and self.start > 0:
            self.text.append(data)
        if self.open and data.strip():
            item = self.items[self.open[-1]]
            if not item["has_children"]:
                item["heading"] = (item["heading"] + " " + " ".join(data.split())).strip()


def section_text(html: str, wanted: str) -> str | None:
    """Text of the element with an id, or null."""
    parser = _Tree(wanted)
    parser.feed(html or "")
    return " ".join(" ".join(parser.text).split()) if parser.start is not None else None


@arrow_udf("string")
def section_texts(html: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else section_text(h, w) for h, w in zip(html, wanted, strict=True)])


TOC = "array<struct<place:int,parent:int,level:int,id:string,link:string,heading:string,has_children:boolean>>"


@arrow_udf(TOC)
def contents_tree(html: pd.Series) -> pd.Series:
    """Items of nested lists: place, place of the parent item, level from 1, id, link, heading, whether there are children."""

    def one(h):
        parser = _Tree()
        parser.feed(h or "")
        return [{"place": k, "parent": i["parent"], "level": i["level"], "id": i["id"], "link": i["link"], "heading": i["heading"], "has_children": i["has_children"]} for k, i in enumerate(parser.items)]

    return html.map(one)
