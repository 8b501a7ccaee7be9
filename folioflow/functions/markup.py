"""What column functions can't say: normal forms and tables of HTML, as Arrow-batched Python."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.session import ship


class Tables(HTMLParser):
    """The rows of cells of a table's HTML."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []
            if not self.rows:
                self.rows.append([])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()).replace("|", "\\|"))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def table_markdown(html: str | None) -> str:
    """A pipe table; the first row heads it; short rows are filled. Empty without cells."""
    p = Tables()
    p.feed(html or "")
    rows = [r for r in p.rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = [f"| {' | '.join([*r, *[''] * (width - len(r))])} |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def normal(text: str | None) -> str | None:
    """NFKC with each run of blanks as one space, for finding excerpts."""
    return None if text is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip()


def _column(function, *columns: Column | str) -> Column:
    ship(SparkSession.active())

    def run(x: pd.Series) -> pd.Series:
        return x.map(function, na_action=None).astype(object)

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.StringType())(*columns)


def tables_as_markdown(html: Column | str) -> Column:
    return _column(table_markdown, html)


def normalized(text: Column | str) -> Column:
    return _column(normal, text)
