"""Visible text of HTML pages, block by block, without a browser."""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd

from .vectorised import vectorised

# Elements without readable text, and elements that begin and end a block.
SILENT = frozenset("script style iframe object svg math form template noscript head".split())
BLOCKS = frozenset("address article aside blockquote dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
SCHEMA = "array<struct<tag: string, text: string>>"


class Reader(HTMLParser):
    """Collects blocks (tag, text); two line breaks in a row end a block like a block element does."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.open, self.parts, self.silent, self.breaks = [], ["body"], [], 0, 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts, self.breaks = [], 0
        if text:
            self.blocks.append((self.open[-1], text))

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag == "br":
            self.breaks += 1
            self.parts.append(" ")
            if self.breaks == 2:
                self.flush()
        elif tag in BLOCKS:
            self.flush()
            if tag != "hr":
                self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCKS:
            self.flush()
            if tag in self.open[1:]:
                while self.open.pop() != tag:
                    pass

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if data.strip():
                self.breaks = 0


def read_blocks(html: str, most_block: int | None = None, most_text: int | None = None) -> tuple[list[tuple[str, str]], bool]:
    """Blocks (tag, text) of a page, and whether a budget left any out: blocks longer than most_block, or what comes
    when most_text characters are reached. Without budgets the page is read whole."""
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    fit = [b for b in reader.blocks if most_block is None or len(b[1]) <= most_block]
    ends = accumulate(len(text) for _, text in fit)
    out = [b for b, end in zip(fit, ends, strict=True) if most_text is None or end <= most_text]
    return out, len(out) < len(reader.blocks)


@vectorised(SCHEMA)
def html_blocks(s: pd.Series) -> pd.Series:
    return s.map(lambda h: [{"tag": t, "text": x} for t, x in read_blocks(h)[0]] if h else [])


@vectorised("string")
def html_text(s: pd.Series) -> pd.Series:
    return s.map(lambda h: "\n".join(x for _, x in read_blocks(h)[0]) if h else "")
