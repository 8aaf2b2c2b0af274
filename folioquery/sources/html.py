"""HTML pages as layout-parser entries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioquery.operators.elements import ENTRY
from folioquery.operators.slices import bounds, size_of

# How tags map to entries.
HEADINGS = {f"h{i}": i for i in range(1, 7)}
BLOCKS = {*HEADINGS, "p", "li", "div", "article", "section", "blockquote", "pre", "dt", "dd"}
SKIPPED = {"head", "script", "style", "template"}
BOILERPLATE = {"nav", "footer", "aside"}


class TolerantParser(HTMLParser):
    """A parser no page can stop: unknown marked sections end at the next ``>``, and markup the page breaks off goes."""

    _MARKUP = re.compile(r"<[!?/A-Za-z]")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def close(self) -> None:
        if self._MARKUP.match(self.rawdata):
            self.rawdata = ""
        super().close()


class _Entries(TolerantParser):
    def __init__(self) -> None:
        super().__init__()
        self.entries: list[dict] = []
        self.words: list[str] = []
        self.level = 0
        self.skipped = 0
        self.noise = 0
        self.table: list[str] | None = None
        self.caption: list[str] | None = None
        self.captions: list[str] = []

    def _add(self, kind: str, **fields) -> None:
        self.entries.append({"type": "discarded" if self.noise else kind, "page_idx": 0, **fields})

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self._add("text", text=text, text_level=self.level or None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skipped += 1
        elif self.table is not None:
            if tag == "caption":
                self.caption = []
            else:
                self.table.append(f"<{tag}>")
        elif tag == "table":
            self.flush()
            self.table, self.captions = ["<table>"], []
        elif tag == "img":
            self.flush()
            a = dict(attrs)
            self._add("image", image_caption=[a["alt"]] if a.get("alt") else [],
                      img_path=a.get("src") or "")
        elif tag == "br":
            self.words.append(" ")
        elif tag in BOILERPLATE:
            self.flush()
            self.noise += 1
        elif tag in BLOCKS:
            self.flush()
            self.level = HEADINGS.get(tag, 0)

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipped = max(self.skipped - 1, 0)
        elif self.table is not None:
            if tag == "caption" and self.caption is not None:
                self.captions.append(" ".join("".join(self.caption).split()))
                self.caption = None
            elif tag == "table":
                body = "".join([*self.table, "</table>"])
                self.table = None
                self._add("table", table_body=body, table_caption=self.captions)
            else:
                self.table.append(f"</{tag}>")
        elif tag in BOILERPLATE:
            self.flush()
            self.noise = max(self.noise - 1, 0)
        elif tag in BLOCKS:
            self.flush()
            self.level = 0

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        if self.caption is not None:
            self.caption.append(data)
        elif self.table is not None:
            self.table.append(data)
        else:
            self.words.append(data)


def page_entries(html: str) -> list[dict]:
    parser = _Entries()
    parser.feed(html)
    parser.close()
    parser.flush()
    blank = {"text": None, "text_level": None, "table_caption": None, "table_body": None,
             "image_caption": None, "img_path": None}
    return [{**blank, **e} for e in parser.entries]


def html_entries(html: Column) -> Column:
    """Entries of each page, parsed in slices of Arrow batches."""

    @F.pandas_udf(f"array<{ENTRY}>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            for part in bounds([size_of(h) for h in pages]):
                yield pd.Series([page_entries(h or "") for h in pages.iloc[part]], dtype=object)

    return parse(html)
