"""HTML to plain text with the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Citations of extracted text are bound to this; it changes whenever the rules below do.
IDENTITY = "lexigrid-html/1"
SKIPPED = ("script", "style")


class _Texts(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.inside = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.inside += tag in SKIPPED

    def handle_endtag(self, tag: str) -> None:
        self.inside -= tag in SKIPPED and self.inside > 0

    def handle_data(self, data: str) -> None:
        if not self.inside and (text := data.strip()):
            self.parts.append(text)


def text_of(html: str | None) -> str:
    """Text nodes without script and style, stripped, with one space between; comments and doctypes are no text."""
    reader = _Texts()
    reader.feed(html or "")
    reader.close()
    return " ".join(reader.parts)


def html_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(text_of)

    return run.asNondeterministic()(html)
