"""Table rows and links of raw web pages, scanned next to the data in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import java, matches
from ..functions.urls import document_link, official_url
from ..operators.ranking import last_rows, top_per_group
from ..plans.lineage import computed_once

LINK = "struct<href:string,text:string,context:string>"
ROWS = f"table_id string, row int, n_cells int, cells array<struct<text:string,links:array<{LINK}>>>"
LINKS = "ordinal int, href string, text string, row_text string"
_LINK_TYPE = pa.struct([("href", pa.string()), ("text", pa.string()), ("context", pa.string())])
ROWS_SCHEMA = pa.schema([("table_id", pa.string()), ("row", pa.int32()), ("n_cells", pa.int32()),
                         ("cells", pa.list_(pa.struct([("text", pa.string()), ("links", pa.list_(_LINK_TYPE))])))])
LINKS_SCHEMA = pa.schema([("ordinal", pa.int32()), ("href", pa.string()), ("text", pa.string()), ("row_text", pa.string())])
# A batch of records is sent on after so many rows, or so much page text.
BATCH_ROWS, BATCH_CHARS = 4_096, 4_000_000


class _Scanner(HTMLParser):
    """Collects rows (direct cells only) and links; script and style text is left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.links: list[dict] = []
        self.open_rows: list[dict] = []
        self.tables: list[str] = []
        self.items: list[list[str]] = []
        self.link: dict | None = None
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "table":
            self.tables.append(a.get("id") or "")
        elif tag == "tr":
            if self.open_rows and not self.open_rows[-1]["nested"]:
                self._close_row()
            self.open_rows.append({"table_id": self.tables[-1] if self.tables else "", "cells": [], "nested": False, "open": False})
        elif tag in ("td", "th") and self.open_rows:
            row = self.open_rows[-1]
            row["cells"].append({"text": [], "links": [], "header": tag == "th"})
            row["open"] = True
        elif tag == "li":
            self.items.append([])
        elif tag == "a" and a.get("href") is not None:
            self.link = {"href": a["href"], "text": [], "row": self.open_rows[-1] if self.open_rows else None,
                         "item": self.items[-1] if self.items else None}
            self.links.append(self.link)
            for row in self.open_rows:
                if row["open"]:
                    row["cells"][-1]["links"].append(self.link)
        if tag == "table" and self.open_rows:
            self.open_rows[-1]["nested"] = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag == "a":
            self.link = None
        elif tag in ("td", "th") and self.open_rows:
            self.open_rows[-1]["open"] = False
        elif tag == "tr" and self.open_rows:
            self._close_row()
        elif tag == "li" and self.items:
            self.items.pop()
        elif tag == "table" and self.tables:
            self.tables.pop()
            if self.open_rows:
                self.open_rows[-1]["nested"] = False

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.link is not None:
            self.link["text"].append(data)
        for item in self.items:
            item.append(data)
        for row in self.open_rows:
            if row["open"]:
                row["cells"][-1]["text"].append(data)

    def _close_row(self) -> None:
        self.rows.append(self.open_rows.pop())

    def finish(self) -> None:
        self.close()
        while self.open_rows:
            self._close_row()


def _squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


# Tags in their plainest writing, which read alike by any rule of HTML; a page of other marks goes through the parser.
_PLAIN_TAG = re.compile(r'<(/?)([A-Za-z][A-Za-z0-9]*)((?: [A-Za-z][A-Za-z0-9-]*="[^"<>&]*(?:&amp;[^"<>&]*)*")*)>')
_PLAIN_VALUE = re.compile(r' ([A-Za-z][A-Za-z0-9-]*)="([^"]*)"')
# Elements whose content is not read as tags.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}


def _plain_parts(html: str) -> list[str] | None:
    """Text, slash, name and attributes in turn, with a last text; None if some mark is not a plain tag."""
    parts = _PLAIN_TAG.split(html)
    if any("<" in text for text in parts[::4]) or not _RAW.isdisjoint(name.lower() for name in set(parts[2::4])):
        return None
    if any(slash and more for slash, more in zip(parts[1::4], parts[3::4])):
        return None
    return parts


def _scan(html: str | None) -> _Scanner:
    s = _Scanner()
    parts = _plain_parts(html or "")
    if parts is None:
        s.feed(html or "")
    else:
        if parts[0]:
            s.handle_data(unescape(parts[0]))
        for slash, name, more, text in zip(parts[1::4], parts[2::4], parts[3::4], parts[4::4]):
            if slash:
                s.handle_endtag(name.lower())
            else:
                s.handle_starttag(name.lower(), [(k.lower(), unescape(v)) for k, v in _PLAIN_VALUE.findall(more)] if more else [])
            if text:
                s.handle_data(unescape(text))
    s.finish()
    return s


def _row_records(html: str | None) -> Iterator[dict]:
    for i, row in enumerate(_scan(html).rows):
        cells = [
            {
                "text": _squeeze(c["text"]),
                "links": [
                    {"href": x["href"], "text": _squeeze(x["text"]),
                     "context": _squeeze(x["item"]) if x["item"] is not None else _squeeze(c["text"])}
                    for x in c["links"]
                ],
            }
            for c in row["cells"]
            if not c["header"]
        ]
        yield {"table_id": row["table_id"], "row": i, "n_cells": len(cells), "cells": cells}


def _link_records(html: str | None) -> Iterator[dict]:
    for i, x in enumerate(_scan(html).links):
        row = x["row"]
        yield {
            "ordinal": i, "href": x["href"], "text": _squeeze(x["text"]),
            "row_text": _squeeze([t + " " for c in row["cells"] for t in c["text"]]) if row else None,
        }


def _mapped(pages: DataFrame, key: str, records, columns: str, schema: pa.Schema, carry: list[str] | None = None) -> DataFrame:
    """Records of each page after its key and carried columns, many pages to a batch of bounded rows and page text."""
    own = list(dict.fromkeys([key, *(carry or [])]))
    kinds = dict(pages.dtypes)

    def batch(page: pa.RecordBatch, places: list[int], found: list[dict]) -> pa.RecordBatch:
        at = pa.array(places, pa.int64())
        made = [pa.array([r[f.name] for r in found], f.type) for f in schema]
        return pa.RecordBatch.from_arrays([*[page.column(c).take(at) for c in own], *made], names=[*own, *schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in batches:
            places, found, read = [], [], 0
            for at, html in enumerate(page.column("html")):
                html = html.as_py()
                for r in records(html):
                    places.append(at)
                    found.append(r)
                read += len(html or "")
                if len(found) >= BATCH_ROWS or read >= BATCH_CHARS:
                    yield batch(page, places, found)
                    places, found, read = [], [], 0
            yield batch(page, places, found)

    kept = "".join(f"`{c}` {kinds[c]}, " for c in own)
    return pages.select(*own, "html").mapInArrow(run, f"{kept}{columns}")


def scan_rows(pages: DataFrame, key: str = "page_id", carry: list[str] | None = None) -> DataFrame:
    """One row per table row: (key, columns to carry, table_id, row, n_cells, cells)."""
    return _mapped(pages, key, _row_records, ROWS, ROWS_SCHEMA, carry)


def scan_links(pages: DataFrame, key: str = "page_id", carry: list[str] | None = None) -> DataFrame:
    """One row per link: (key, columns to carry, ordinal, href, text, row_text)."""
    return _mapped(pages, key, _link_records, LINKS, LINKS_SCHEMA, carry)


def linked_documents(pages: DataFrame, base: str = "url", key: str = "page_id", label_length: int = 240) -> DataFrame:
    """Official document links of each page; a repeated URL keeps its first place and its last label."""
    links = scan_links(pages, key, [base])
    url = official_url(F.col("href"), F.col(base))
    label = F.coalesce(F.nullif(F.left("row_text", F.lit(label_length)), F.lit("")), F.col("text"))
    work = computed_once(links, {"doc_url": url, "label": label}).filter(F.col("doc_url").isNotNull())
    wanted = (
        document_link(F.col("doc_url"))
        | (matches(F.col("label"), r"\.(?:pdf|xlsx?)\b") & matches(F.col("doc_url"), r"docDownoad|DirectLink_(?:1|9)\b"))
        | (matches(F.col("text"), r"download") & matches(F.col("label"), r"document|specification|\bboq\b|\.pdf|\.xls"))
    )
    return last_rows(work.filter(wanted).select(key, "doc_url", "label", "ordinal"), [key, "doc_url"], ["ordinal"])


def document_policy(links: DataFrame, key: str = "page_id", limit: int = 12) -> DataFrame:
    """Allowed document links, distinct by URL, first ``limit`` per page in order of first appearance."""
    url = official_url(F.col("url"))
    ok = links.withColumn("doc_url", url).filter(
        F.col("doc_url").isNotNull() & F.col("doc_url").rlike(java(r"\.(?:pdf|xlsx?)(?:$|\?)|/showbidDocument/"))
    )
    merged = ok.groupBy(key, "doc_url").agg(
        F.max_by("label", "ordinal").alias("label"), F.min("ordinal").alias("ordinal")
    )
    return top_per_group(merged, [key], [F.asc("ordinal")], limit, "position")
