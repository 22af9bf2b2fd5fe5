"""HTML table extraction (S7-S9) as a job over a stored ``pages`` table.

Parsing runs in ``mapInArrow`` with the standard library's ``html.parser``:
one page's HTML is one row, parsed inside a task, and every table comes out as
one row ``(page_id, table_no, is_wikitable, n_data, n_rows, header, head_no, head, body)``.
Choosing the table and mapping its header are DataFrame steps (window over
per-table row counts, ordered CASE over header text) that read no table's body.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Of a table: rows without and with its header rows, the text of all header cells, number and cells of the first header row,
# and the other rows.
TABLE_SCHEMA = ("page_id long, table_no int, is_wikitable boolean, n_data long, n_rows long, header string, head_no int, "
                "head array<string>, body array<struct<row_no: int, cells: array<string>>>")
_ARROW = pa.schema([("page_id", pa.int64()), ("table_no", pa.int32()), ("is_wikitable", pa.bool_()), ("n_data", pa.int64()), ("n_rows", pa.int64()),
                    ("header", pa.string()), ("head_no", pa.int32()), ("head", pa.list_(pa.string())),
                    ("body", pa.list_(pa.struct([("row_no", pa.int32()), ("cells", pa.list_(pa.string()))])))])
PAGES = 200  # parsed before their tables go on

# --- Fixed values ---------------------------------------------------------------
# Header fragments in the reference's dictionary order; the first contained in a
# lowercased header wins.
HEADER_FRAGMENTS = [("no.", "rank"), ("no", "rank"), ("#", "rank"), ("rank", "rank"), ("pos", "rank"),
                    ("title", "title"), ("song", "title"), ("single", "title"),
                    ("artist", "artist"), ("act", "artist"), ("performer", "artist")]
# Header keywords that mark a chart table.
CHART_KEYWORDS = ["title", "song", "single", "artist", "no.", "rank"]
MIN_ROWS = 50
# ---------------------------------------------------------------------------------


MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534  # the limits of the HTML standard


class _Table:
    """An open table: its open row and cell, and the cells that reach down from earlier rows."""

    def __init__(self, number: int, wiki: bool):
        self.number, self.wiki = number, wiki
        self.n_rows = 0
        self.row: list[tuple[str, int, int]] | None = None
        self.header = True
        self.cell: list[str] | None = None
        self.spans = (1, 1)
        self.hanging: dict[int, tuple[str, int]] = {}  # column -> text, rows left

    def end_cell(self) -> None:
        if self.cell is not None and self.row is not None:
            self.row.append((" ".join("".join(self.cell).split()), *self.spans))
        self.cell = None

    def end_row(self) -> tuple | None:
        """The row with its spans spread over the columns they cover."""
        self.end_cell()
        row, self.row = self.row, None
        if not row:
            return None
        out: list[str] = []
        below: dict[int, tuple[str, int]] = {}
        todo = list(reversed(row))
        while todo or any(c >= len(out) for c in self.hanging):
            at = len(out)
            if at in self.hanging:
                text, left = self.hanging[at]
                out.append(text)
                if left > 1:
                    below[at] = (text, left - 1)
            elif todo:
                text, wide, high = todo.pop()
                for _ in range(wide):
                    if high > 1:
                        below[len(out)] = (text, high - 1)
                    out.append(text)
            else:
                out.append("")
        self.hanging = below
        self.n_rows += 1
        return self.number, self.wiki, self.n_rows - 1, self.header, out


def _span(attrs: dict, name: str, most: int) -> int:
    value = (attrs.get(name) or "").strip()
    return min(max(int(value), 1), most) if value.isdecimal() else 1


class _Tables(HTMLParser):
    """Rows of all tables of a page. Each open table keeps its own row and cell, so a nested table leaves the outer row as it
    is; a new cell, row or the end of the table closes what is open, as the end tags are optional."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows = []          # (table_no, is_wikitable, row_no, is_header, cells)
        self._stack: list[_Table] = []
        self._n = 0

    def updatepos(self, i, j):
        return j  # nobody asks for line numbers

    def _end_row(self, table: _Table) -> None:
        row = table.end_row()
        if row:
            self.rows.append(row)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "table":
            self._stack.append(_Table(self._n, "wikitable" in (attrs.get("class") or "").split()))
            self._n += 1
            return
        if not self._stack:
            return
        table = self._stack[-1]
        if tag in ("tr", "thead", "tbody", "tfoot"):
            self._end_row(table)
            if tag == "tr":
                table.row, table.header = [], True
        elif tag in ("td", "th"):
            table.end_cell()
            if table.row is None:
                table.row, table.header = [], True
            table.cell = []
            table.spans = _span(attrs, "colspan", MAX_COLSPAN), _span(attrs, "rowspan", MAX_ROWSPAN)
            table.header &= tag == "th"
        elif tag == "br" and table.cell is not None:
            table.cell.append(" ")

    def handle_endtag(self, tag):
        if not self._stack:
            return
        table = self._stack[-1]
        if tag in ("td", "th"):
            table.end_cell()
        elif tag in ("tr", "thead", "tbody", "tfoot"):
            self._end_row(table)
        elif tag == "table":
            self._end_row(table)
            self._stack.pop()

    def handle_data(self, data):
        if self._stack and self._stack[-1].cell is not None:
            self._stack[-1].cell.append(data)

    def close(self):
        super().close()
        while self._stack:  # tables that the page never closes
            self._end_row(self._stack.pop())


# A plain tag: an end tag, or a start tag whose attributes have no value, or one without quotes' ends, references or slashes.
_ATTR = r"""[ \t\n\r\f]+([a-zA-Z][-a-zA-Z0-9_]*)(?:=(?:"([^"&]*)"|'([^'&]*)'|([^ \t\n\r\f"'`=<>/&]+)))?"""
_PLAIN_ATTR = re.compile(_ATTR)
_PLAIN_TAG = re.compile(r"<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?:" + re.sub(r"\((?!\?)", "(?:", _ATTR) + r")*))[ \t\n\r\f]*>")
# Elements whose content is no markup.
RAW_TEXT = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


def page_tables(html: str | None) -> list[tuple]:
    """Plain tags go straight to the handlers; anything else (comments, declarations, raw text, broken tags) is read by the
    standard parser, piece by piece, until it has nothing pending."""
    parser, html, at = _Tables(), html or "", 0
    while at < len(html):
        start = html.find("<", at)
        if start != at:
            end = start if start >= 0 else len(html)
            parser.handle_data(unescape(html[at:end]))
            at = end
            continue
        tag = _PLAIN_TAG.match(html, at)
        if tag and tag[1]:
            parser.handle_endtag(tag[1].lower())
            at = tag.end()
        elif tag and tag[2].lower() not in RAW_TEXT:
            attrs = [(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), None)) for m in _PLAIN_ATTR.finditer(tag[3])] if tag[3] else ()
            parser.handle_starttag(tag[2].lower(), attrs)
            at = tag.end()
        else:
            while at < len(html):
                next_ = html.find("<", at + 1)
                next_ = next_ if next_ >= 0 else len(html)
                parser.feed(html[at:next_])
                at = next_
                if not parser.rawdata and parser.cdata_elem is None:
                    break
    parser.close()
    return parser.rows


def _page_rows(page_id: int, html: str | None) -> list[tuple]:
    """The tables of a page that have a row, as rows of ``TABLE_SCHEMA``."""
    tables: dict[int, list] = {}
    for number, wiki, row_no, is_header, cells in page_tables(html):
        table = tables.setdefault(number, [wiki, [], []])
        table[2 - is_header].append((row_no, cells))
    out = []
    for number, (wiki, head, body) in tables.items():
        text = " ".join(c for _, cells in head for c in cells) if head else None
        first = head[0] if head else (None, None)
        out.append((page_id, number, wiki, len(body), len(head) + len(body), text, *first, [{"row_no": k, "cells": c} for k, c in body]))
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, PAGES):
            batch = whole.slice(at, PAGES)
            rows = [row for pid, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in _page_rows(int(pid), html)]
            columns = list(zip(*rows)) if rows else [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def page_table_rows(pages: DataFrame) -> DataFrame:
    """S7, parsing step: every table of every page, one row each (``TABLE_SCHEMA``)."""
    return pages.select("page_id", "html").mapInArrow(_parse, TABLE_SCHEMA)


def choose_tables(tables: DataFrame) -> DataFrame:
    """S7, choice: per page, the first table with >= 50 data rows whose header
    mentions a chart keyword; else the largest table; if that has < 50 rows, the
    largest wikitable (no minimum). Returns (page_id, table_no, hdr), ``hdr`` being its first header row."""
    stats = tables.groupBy("page_id", "table_no", "is_wikitable").agg(
        F.sum("n_data").alias("n_rows"), F.min(F.when(F.col("head_no").isNotNull(), F.struct("head_no", "head"))).alias("_head"), F.collect_list("header").alias("_text"))
    of_table = Window.partitionBy("page_id", "table_no")
    stats = (stats.withColumn("hdr", F.min("_head").over(of_table)["head"])
             .withColumn("header_text", F.lower(F.concat_ws(" ", F.flatten(F.collect_list("_text").over(of_table))))))
    kw = F.lit(False)
    for k in CHART_KEYWORDS:
        kw = kw | F.coalesce(F.col("header_text").contains(k), F.lit(False))
    s = stats.withColumn("chart_like", (F.col("n_rows") >= MIN_ROWS) & kw)
    by_page = Window.partitionBy("page_id")  # one page's tables: a small group
    first_chart = F.min(F.when(F.col("chart_like"), F.col("table_no"))).over(by_page)
    largest = F.max(F.struct("n_rows", (-F.col("table_no")).alias("neg"))).over(by_page)
    wiki_largest = F.max(F.when(F.col("is_wikitable"), F.struct("n_rows", (-F.col("table_no")).alias("neg")))).over(by_page)
    s = s.withColumn("_first", first_chart).withColumn("_lg", largest).withColumn("_wk", wiki_largest)
    pick = (F.when(F.col("_first").isNotNull(), F.col("_first"))
             .when(F.col("_lg.n_rows") >= MIN_ROWS, -F.col("_lg.neg"))
             .otherwise(-F.col("_wk.neg")))
    return s.withColumn("_pick", pick).filter(F.col("table_no") == F.col("_pick")).select("page_id", "table_no", "hdr")


def map_header(name, whole_word_first: bool = True):
    """Canonical column for a header cell. With ``whole_word_first`` (ours,
    D15) a header that is exactly a fragment, or contains it as a whole word,
    wins before loose containment ("Notes" is not "no")."""
    h = F.lower(F.trim(name))
    out = None
    if whole_word_first:
        for frag, canon in HEADER_FRAGMENTS:
            cond = (h == frag) | h.rlike(r"(^|[^a-z0-9])" + _re_escape(frag) + r"($|[^a-z0-9])")
            out = F.when(cond, canon) if out is None else out.when(cond, canon)
    for frag, canon in HEADER_FRAGMENTS:
        cond = F.instr(h, frag) > 0
        out = F.when(cond, canon) if out is None else out.when(cond, canon)
    return out


def _re_escape(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in s)


def chart_rows(pages: DataFrame, year_col: str | None = None, tables: DataFrame | None = None) -> DataFrame:
    """The chosen table of each page as (page_id, row_no, rank, title, artist), and ``year`` where ``year_col``
    names the pages' year; pages without rank, title and artist columns are skipped; ranks coerced and non-numeric ranks
    dropped. Pages are parsed once; ``tables`` are those of ``page_table_rows`` if they have been written already."""
    tables = materialize(page_table_rows(pages), "page_tables") if tables is None else tables
    chosen = choose_tables(tables).where(F.col("hdr").isNotNull())
    body = tables.select("page_id", "table_no", "body").join(chosen, ["page_id", "table_no"])
    cols = F.transform("hdr", lambda x: map_header(x))
    b = body.withColumn("canon", cols)
    b = b.where(F.forall(F.array(*[F.lit(c) for c in ("rank", "title", "artist")]), lambda c: F.array_contains("canon", c)))
    b = b.select("page_id", "canon", F.inline("body"))

    def pick(name):
        idx = F.array_position(F.col("canon"), name)
        return F.when(idx > 0, F.element_at("cells", idx.cast("int")))

    out = b.select("page_id", "row_no", pick("rank").alias("rank_raw"), pick("title").alias("title"), pick("artist").alias("artist"))
    out = out.withColumn("rank", F.col("rank_raw").try_cast("double").try_cast("int")).filter(F.col("rank").isNotNull())
    out = out.select("page_id", "row_no", "rank", "title", "artist")
    if year_col is None:
        return out
    return out.join(pages.select("page_id", F.col(year_col).cast("int").alias("year")), "page_id")
