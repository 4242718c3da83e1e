"""Page fields from HTML: title, descriptions, paragraphs, visible text, article, metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import text

PIECE_BYTES = 1 << 20  # html that is parsed at once
HIDDEN = {"script", "style", "noscript", "svg"}
BOILERPLATE = {"nav", "footer", "header", "aside", "form"}
_SPACE = re.compile(r"\s+")


class PageParser(HTMLParser):
    """Collects a page's fields in one pass; broken markup is read as far as it goes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden = self.boiler = 0
        self.in_title = self.in_paragraph = self.in_comment = False
        self.title, self.visible, self.article, self.comment = [], [], [], []
        self.paragraphs: list[list[str]] = []
        self.meta: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BOILERPLATE:
            self.boiler += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "p":
            self.in_paragraph = True
            self.paragraphs.append([])
        elif tag == "meta":
            name = (a.get("property") or a.get("name") or "").lower()
            if name and a.get("content") and name not in self.meta:
                self.meta[name] = a["content"]
        elif "commtext" in (a.get("class") or "").split() and not self.comment:
            self.in_comment = True

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BOILERPLATE:
            self.boiler = max(0, self.boiler - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "p":
            self.in_paragraph = False
        elif tag in ("span", "div", "td"):
            self.in_comment = False

    def handle_data(self, data):
        if self.hidden:
            return
        if self.in_title:
            self.title.append(data)
            return
        self.visible.append(data)
        if not self.boiler:
            self.article.append(data)
        if self.in_paragraph:
            self.paragraphs[-1].append(data)
        if self.in_comment:
            self.comment.append(data)


def _join(parts: list[str]) -> str:
    return _SPACE.sub(" ", " ".join(parts)).strip()


def parse(html: str) -> dict:
    p = PageParser()
    p.feed(html)
    p.close()
    paragraphs = [t for t in map(_join, p.paragraphs) if t]
    article, visible = _join(p.article), _join(p.visible)
    return {
        "title": _join(p.title), "description": p.meta.get("description", ""), "og_description": p.meta.get("og:description", ""), "first_paragraph": paragraphs[0] if paragraphs else "",
        "comment": _join(p.comment), "visible": visible, "article": (article if len(article) >= CONFIG.usable_chars else visible)[: CONFIG.article_chars],
        "published": p.meta.get("article:published_time") or p.meta.get("date", ""), "author": p.meta.get("author", ""),
    }


FIELDS = ("title", "description", "og_description", "first_paragraph", "comment", "visible", "article", "published", "author")


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about PIECE_BYTES of a column, as parsed pages are held in
    several forms; a longer row is a piece."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
        part = np.cumsum(size) // PIECE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(size)]
        for start, end in zip(cuts, cuts[1:]):
            yield b.slice(start, end - start)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _pieces(batches, 2):
        rows = [parse(x or "") for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[f] for r in rows], pa.string()) for f in FIELDS)], ["id", "url", *FIELDS])


def parse_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Fields of each page, and a chosen description: on encyclopedias the first paragraph without
    its notes, on forums the first comment, else the page's own, the social one, the first paragraph."""
    raw = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = raw.mapInArrow(_parse, "id long, url string, " + ", ".join(f"{f} string" for f in FIELDS))
    host = F.coalesce(text.url_host("url"), F.lit(""))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    notes = F.rtrim(F.regexp_replace(F.regexp_replace("first_paragraph", r"\[\d+\]", ""), r"\s+\.\s*$", ""))
    chosen = F.coalesce(
        F.when(host.rlike(r"(^|\.)wikipedia\.org$"), F.nullif(notes, F.lit(""))), F.when(host == "news.ycombinator.com", some("comment")), some("description"), some("og_description"), some("first_paragraph"), F.lit("")
    )
    return out.withColumn("chosen_description", chosen).withColumn("article", F.when(text.usable_article("article"), text.sanitize_verdicts("article")).otherwise("")).withColumnRenamed("id", id_col)
