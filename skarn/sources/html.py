"""Text of HTML pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

#: The headings a filing's text starts from, in order of rank.
FORM_MARKERS = ("UNITED STATES SECURITIES AND EXCHANGE COMMISSION", "FORM 8-K", "FORM 10-K", "FORM 10-Q")


def page_text(page: str, markers: tuple[str, ...] = FORM_MARKERS) -> str:
    """Text nodes joined by spaces, white space evened out, from the first marker of the list that occurs."""
    import re
    from html.parser import HTMLParser

    nodes: list[str] = []
    reader = HTMLParser()
    reader.handle_data = nodes.append
    reader.feed(page)
    reader.close()
    text = re.sub(r"\s+", " ", " ".join(n for n in nodes if n.strip())).strip()
    at = next((i for m in markers if (i := text.find(m)) >= 0), 0)
    return text[at:]


def html_text(c: Column, markers: tuple[str, ...] = FORM_MARKERS) -> Column:
    """page_text of a column; null stays null. The parser is Python's, so this runs on Arrow batches."""

    @F.pandas_udf("string")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(lambda x: page_text(x, markers), na_action="ignore")

    return parse(c)
