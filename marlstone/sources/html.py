"""Blocks of text from HTML pages, in order."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

#: Elements whose text is no content; those that a head may hold; those that begin and end a block; those whose end closes what is open in them.
_SKIP = {"script", "style", "nav", "head", "footer", "template", "title", "noscript"}
_IN_HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
_BLOCK = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "div", "article", "section", "tr", "ul", "ol", "table", "br", "pre", "blockquote", "body", "html", "main"}
_HOLDS = {"html", "body", "main", "div", "article", "section", "aside", "header", "table", "ul", "ol", "blockquote"}


class _Blocks(HTMLParser):
    """Blocks, with those of each open skipped element kept aside until its end is known.

    A head ends where an element begins that it can't hold. An end tag closes what is still
    open inside its element. A nav or footer that nothing but the page's end closes was
    never meant to hide the rest: its text counts.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now = [], []
        self.open: list[tuple[str, int]] = []  # tag, and number of blocks when it began
        self.known: Counter = Counter()

    def end(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.blocks.append(text)
        self.now = []

    def _close(self, down_to: int, ended: bool):
        """Close the open elements from ``down_to``; text of skipped ones goes unless the page ended before them."""
        self.end()
        for tag, blocks in reversed(self.open[down_to:]):
            self.known[tag] -= 1
            if tag in _SKIP and not (ended and tag in ("nav", "footer")):
                del self.blocks[blocks:]
        del self.open[down_to:]

    def _last(self, tag: str) -> int:
        return next(k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag)

    def handle_starttag(self, tag, attrs):
        if self.known["head"] and tag not in _IN_HEAD:
            self._close(self._last("head"), False)
        if tag in _BLOCK or tag in _SKIP:
            self.end()
        if tag in _HOLDS or tag in _SKIP:
            self.open.append((tag, len(self.blocks)))
            self.known[tag] += 1

    def handle_endtag(self, tag):
        if self.known[tag]:
            self._close(self._last(tag), tag in ("body", "html"))
        elif tag in _BLOCK:
            self.end()

    def handle_data(self, data):
        self.now.append(data)

    def finish(self):
        self.close()
        self._close(0, True)


def blocks_of(html: str | None) -> list[str]:
    p = _Blocks()
    p.feed(html or "")
    p.finish()
    return p.blocks


@arrow_udf(T.ArrayType(T.StringType()))
def _blocks(pages: pa.Array) -> pa.Array:
    return pa.array([blocks_of(x) for x in pages.to_pylist()], pa.list_(pa.string()))


def html_blocks(html: str) -> Column:
    """Paragraphs, list items and cells of a page, without scripts and navigation."""
    return _blocks(F.col(html).cast("string"))
