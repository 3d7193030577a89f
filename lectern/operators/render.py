"""Rendering: plain text with page marks, messages as Markdown, visible text and safe tables from HTML."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from lectern.functions.text import escape_markdown


def plain_pages(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, markdown)``: text of pages parted by form feeds, escaped, with a comment before each page."""
    pages = F.transform(F.split(F.col(text), "\f"), lambda p, i: F.concat(F.lit("<!-- page "), (i + 1).cast("string"), F.lit(" -->\n\n"), escape_markdown(F.trim(p))))
    return docs.select(doc, F.array_join(pages, "\n\n").alias("markdown"))


def transcript(turns: DataFrame, doc: str, order: str, head: str, text: str) -> DataFrame:
    """``(doc, markdown)``: each turn as a level-2 heading and its text, in order."""
    one = F.concat(F.lit("## "), F.col(head), F.lit("\n\n"), F.col(text))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, one.alias("m")))), lambda x: x["m"])
    return turns.groupBy(doc).agg(F.array_join(parts, "\n\n").alias("markdown"))


_HIDDEN = re.compile(r"(?is)<!--.*?(-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(</\2\s*>|\Z)")
_TAG = re.compile(r"(?s)<[/!?]?[A-Za-z][^>]*>|<![^>]*>")


@F.pandas_udf(T.StringType())
def visible_text(s: pd.Series) -> pd.Series:
    """Text of an HTML page without scripts, styles, comments and tags; entities decoded, white space collapsed."""
    return s.map(lambda x: None if x is None else " ".join(html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", x))).split()))


_TABLE_TAGS = frozenset("table thead tbody tfoot tr th td caption colgroup col br sub sup b i em strong".split())
_ANY = re.compile(r"(?s)<(/?)([A-Za-z][A-Za-z0-9]*)([^>]*)>|<")


def sanitize(fragment: str) -> str:
    """A table's HTML with allowed tags only; of their attributes row and column spans of 1 to 1000 stay."""

    def one(m: re.Match) -> str:
        name = (m.group(2) or "").lower()
        if name not in _TABLE_TAGS:
            return "&lt;" if m.group(2) is None else ""
        if m.group(1):
            return f"</{name}>"
        spans = [(k.lower(), int(v)) for k, v in re.findall(r"\b(rowspan|colspan)\s*=\s*[\"']?([0-9]{1,4})\b", m.group(3), re.I)]
        return f"<{name}" + "".join(f' {k}="{v}"' for k, v in sorted(spans) if 1 <= v <= 1000) + ">"

    return _ANY.sub(one, _HIDDEN.sub("", fragment))


@F.pandas_udf(T.StringType())
def safe_table(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else sanitize(x))
