"""Sections of HTML and Markdown documents: heading path, text, and offsets in the document's own plain text.

Sections stand one after another with two characters between them; empty ones are left out, longer ones are cut at a
line end or a space (MAX_SECTION characters). Markup is read a page at a time inside tasks; nothing is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SECTION = 4000
#: Elements whose content is no text of the page.
SKIP = ("script", "style", "nav", "header", "footer", "aside", "form", "template", "noscript", "svg")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_SPACE = re.compile(r"\s+")
SECTION = "ordinal int, heading_path array<string>, excerpt string, start bigint, end bigint"


class _Reader(HTMLParser):
    """Collects (heading path, text) in page order; text inside main or article wins over the rest where there is any."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[int, str]] = []
        self.heading: int | None = None
        self.words: list[str] = []
        self.skipping: list[str] = []
        self.inside = 0
        self.found: list[tuple[list[str], str, bool]] = []

    def _close(self) -> None:
        text = _SPACE.sub(" ", "".join(self.words)).strip()
        self.words = []
        if self.heading is not None:
            if text:
                self.path = [x for x in self.path if x[0] < self.heading] + [(self.heading, text)]
        elif text:
            self.found.append(([t for _, t in self.path], text, self.inside > 0))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.append(tag)
        elif tag in SKIP:
            self.skipping.append(tag)
        elif tag in _HEADINGS:
            self._close()
            self.heading = int(tag[1])
        elif tag in ("main", "article"):
            self._close()
            self.inside += 1
        elif tag in ("p", "div", "li", "br", "tr", "td", "section"):
            self.words.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.pop()
        elif tag in _HEADINGS:
            self._close()
            self.heading = None
        elif tag in ("main", "article"):
            self._close()
            self.inside = max(0, self.inside - 1)

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.words.append(data)

    def sections(self) -> Iterator[tuple[list[str], str]]:
        self._close()
        main = any(x[2] for x in self.found)
        yield from ((p, t) for p, t, inside in self.found if inside or not main)


def read_html(page: str) -> Iterator[tuple[list[str], str]]:
    r = _Reader()
    r.feed(re.sub(r"<title\b.*?</title\s*>", "", page, flags=re.S | re.I))
    r.close()
    yield from r.sections()


def read_markdown(text: str) -> Iterator[tuple[list[str], str]]:
    """Sections by # headings; lines of fenced code are text, not headings."""
    path: list[tuple[int, str]] = []
    lines: list[str] = []
    fence = ""
    for line in [*text.split("\n"), "# "]:
        m = None if fence else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        mark = re.match(r"(```+|~~~+)", line)
        if mark:
            fence = "" if fence and line.startswith(fence) else fence or mark[1]
        if m:
            body = _SPACE.sub(" ", " ".join(lines)).strip()
            if body:
                yield [t for _, t in path], body
            lines = []
            path = [x for x in path if x[0] < len(m[1])] + [(len(m[1]), m[2])]
        else:
            lines.append(line)
    body = _SPACE.sub(" ", " ".join(lines)).strip()
    if body:  # a fence that never closes
        yield [t for _, t in path], body


def split_section(text: str, limit: int = MAX_SECTION) -> Iterator[str]:
    """Pieces of at most limit characters that end at a line end or a space where there is one in the second half."""
    while len(text) > limit:
        cut = max(text.rfind("\n", limit // 2, limit), text.rfind(" ", limit // 2, limit))
        cut = cut if cut > 0 else limit
        yield text[:cut].rstrip()
        text = text[cut:].lstrip()
    if text:
        yield text


def _sections(df: DataFrame, ident: str, text: str, read) -> DataFrame:
    kind = df.schema[ident].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for key, x in zip(b.column(0).to_pylist(), b.column(1)):
                at = 0
                pieces = ((p, piece) for p, t in read(x.as_py() or "") for piece in split_section(t))
                for k, (path, piece) in enumerate(pieces):
                    rows.append((key, k, path, piece, at, at + len(piece)))
                    at += len(piece) + 2
            cols = list(zip(*rows)) or [()] * 6
            types = (b.schema.field(0).type, pa.int32(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=[ident, "ordinal", "heading_path", "excerpt", "start", "end"])

    return df.select(ident, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{ident}` {kind}, {SECTION}")


def sections(pages: DataFrame, ident: str, html: str) -> DataFrame:
    return _sections(pages, ident, html, read_html)


def markdown_sections(docs: DataFrame, ident: str, text: str) -> DataFrame:
    return _sections(docs, ident, text, read_markdown)


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links(from_page, target path) to pages(path): the first that exists of target, target.md and target/README.md."""
    names = F.array(F.col("target"), F.concat("target", F.lit(".md")), F.concat("target", F.lit("/README.md")))
    tries = links.select("*", F.posexplode(names).alias("_rank", "_try"))
    hit = tries.join(pages.select(F.col("path").alias("_path")), F.col("_try") == F.col("_path"))
    best = hit.groupBy("from_page", "target").agg(F.min_by("_path", "_rank").alias("to_page"))
    return links.join(best, ["from_page", "target"], "left")
