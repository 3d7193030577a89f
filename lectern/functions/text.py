"""Scalar text functions as Catalyst expressions; only Unicode normal forms use Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def squash(c: Column) -> Column:
    """White space (Unicode) collapsed to single spaces and trimmed."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"\A | \z", "")


def title_key(c: Column) -> Column:
    """Comparison key of a title: 512 characters at most, lower case, runs of other than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.substring(c, 1, 512)), r"[^\p{L}\p{N}]+", " "))


def token_estimate(c: Column) -> Column:
    """A quarter of the ASCII characters, rounded up, and every other character."""
    ascii_only = F.length(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    return (F.ceil(ascii_only / F.lit(4)) + F.length(c) - ascii_only).cast("bigint")


def word_count(c: Column) -> Column:
    """Words that begin with a letter and go on with letters, digits, apostrophes and hyphens."""
    return F.regexp_count(c, F.lit(r"\p{L}[\p{L}\p{N}'’-]*"))


def first_year(c: Column) -> Column:
    """First year of 1800 to 2099 that no digit touches, null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?:\A|[^0-9])((?:18|19|20)[0-9]{2})(?![0-9])", 1), F.lit("")).cast("int")


def dehyphenate(c: Column) -> Column:
    """Letter, hyphen, white space, letter: a word broken at a line end is joined."""
    return F.regexp_replace(c, r"(?<=\p{L})-\s+(?=\p{L})", "")


def occurrences(text: Column, target: Column) -> Column:
    """How often ``target`` occurs without overlap; 0 for an empty target."""
    return F.when(F.length(target) > 0, ((F.length(text) - F.length(F.replace(text, target, F.lit("")))) / F.length(target)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def chain(c: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, *r), rules, c)


def plain_reference(c: Column) -> Column:
    """Markdown of a reference without images, link targets, tags and emphasis."""
    return squash(chain(c, (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<(https?://[^>]+)>", "$1"), (r"</?[A-Za-z][^>]*>", " "), (r"[*_~`]+", "")))


def word_runs(words: str, n: int) -> Column:
    """All runs of ``n`` words of a column of words, joined by spaces; of fewer words all of them. Each run is taken by places: a slice reads the whole array."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_\[\]<>#|])", r"\\$1")


def superscript_digits(c: Column) -> Column:
    return F.translate(c, "⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")


def fold_quotes(c: Column) -> Column:
    return F.translate(c, "‘’‚‛“”„‟‐‑‒–—−", "''''\"\"\"\"------")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC, white space collapsed, trimmed."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()))


_MARKS = re.compile(r"[^a-z0-9]+")


@F.pandas_udf(T.StringType())
def search_key(s: pd.Series) -> pd.Series:
    """NFKD without marks, lower case, other than letters and digits as one space."""

    def key(x: str | None) -> str | None:
        if x is None:
            return None
        low = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.category(c).startswith("M")).lower()
        return " ".join("".join(c if c.isalnum() else " " for c in low).split())

    return s.map(key)


def slug(c: Column) -> Column:
    """Fragment name of a heading without its suffix against repetition."""
    return F.regexp_replace(F.trim(F.regexp_replace(search_key(c), r"[^\p{L}\p{N} -]", "")), r"\s+", "-")
