"""Text of parsed pages, as Arrow UDFs over the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

_HIDDEN = frozenset({"script", "style", "meta", "title", "head", "noscript", "template"})
_SIDE = frozenset({"nav", "footer", "aside", "header", "form"})
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Walker(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.nodes: list[tuple[str, bool, bool]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        data = data.strip()
        if data and (not self.open or self.open[-1] not in _HIDDEN):
            self.nodes.append((data, any(t in ("main", "article") for t in self.open), any(t in _SIDE for t in self.open)))


def walk(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, inside main content, inside page furniture) of the text nodes."""
    w = _Walker()
    try:
        w.feed(page or "")
        w.close()
    except (ValueError, AssertionError):
        return []
    return w.nodes


def _visible(html: pd.Series) -> pd.Series:
    return html.map(lambda h: " ".join(t for t, _, _ in walk(h)))


def _main(html: pd.Series) -> pd.Series:
    return html.map(lambda h: " ".join(t for t, main, side in walk(h) if main and not side))


def visible_text(html: str) -> Column:
    return pandas_udf(_visible, "string")(html)


def main_text(html: str) -> Column:
    return pandas_udf(_main, "string")(html)
