"""Identifiers of publications: normal forms, extraction from free text, URLs, cache keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lectern.functions.text import chain

LIMIT = 4096
_TAIL = r"[.,;:!?)}\]>]+\z"


def _bounded(c: Column) -> Column:
    return F.trim(F.substring(F.coalesce(c, F.lit("")), 1, LIMIT))


def doi(c: Column) -> Column:
    """DOI in lower case without prefix, resolver or angle brackets; '' where it is none."""
    x = F.trim(chain(_bounded(c), (r"(?i)\Adoi\s*:\s*", ""), (r"(?i)\Ahttps?://(dx\.)?doi\.org/", "")))
    x = F.regexp_replace(x, r"(?s)\A< *(.*?) *>\z", "$1")
    return F.lower(F.regexp_extract(x, r"\A(10\.[0-9]{4,9}/[!#-'*+\--;<=>?@A-Z\[\]^_`a-z{|}~./]+)\z", 1))  # each step once: a column named twice is computed twice


def arxiv(c: Column) -> Column:
    """arXiv id without prefix, URL, query, suffix and version, in lower case; '' where it is none."""
    x = chain(
        _bounded(c), (r"(?i)\Aarxiv(\s+id)?\s*:\s*", ""), (r"(?i)\Ahttps?://(www\.)?arxiv\.org/(abs|pdf)/", ""),
        (r"(?s)[?#].*\z", ""), (r"(?i)\.pdf\z", ""), (r"(?i)v[0-9]+\z", ""),
    )
    x = F.lower(F.trim(x))
    return F.regexp_extract(x, r"\A([0-9]{4}\.[0-9]{4,5}|[a-z][a-z0-9.\-]*/[0-9]{7})\z", 1)


def openalex(c: Column) -> Column:
    x = F.upper(F.trim(F.regexp_replace(_bounded(c), r"(?i)\Ahttps?://openalex\.org/", "")))
    return F.regexp_extract(x, r"\A(W[1-9][0-9]*)\z", 1)


def pmid(c: Column) -> Column:
    """One to twelve digits, bare or at the end of a PubMed URL; '' otherwise."""
    x = F.regexp_replace(_bounded(c), r"(?i)\Ahttps?://(pubmed\.ncbi\.nlm\.nih\.gov|www\.ncbi\.nlm\.nih\.gov/pubmed)/([0-9]+)/?\z", "$2")
    return F.regexp_extract(x, r"\A([0-9]{1,12})\z", 1)


def _first(found: Column, normal) -> Column:
    good = F.filter(F.transform(found, lambda t: normal(F.regexp_replace(t, _TAIL, ""))), lambda v: v != "")
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def extract(c: Column) -> Column:
    """First valid DOI (white space may follow its prefix), arXiv id, labelled PMID and PDF link of a reference text."""
    text = F.substring(F.coalesce(c, F.lit("")), 1, 16384)
    d = F.transform(F.regexp_extract_all(text, F.lit(r"(10\.[0-9]{4,9}/\s*[^\s<>\"()]+)"), 1), lambda t: F.regexp_replace(t, r"\s", ""))
    a = F.regexp_extract_all(text, F.lit(r"(?i)\barxiv(?:\s+id)?\s*:\s*([a-z0-9./\-]+)"), 1)
    p = F.regexp_extract_all(text, F.lit(r"(?i)\bpmid\s*:?\s*([0-9]+)"), 1)
    return F.struct(_first(d, doi).alias("doi"), _first(a, arxiv).alias("arxiv_id"), _first(p, pmid).alias("pmid"), pdf_url(text).alias("pdf_url"))


def is_pdf_url(u: Column) -> Column:
    """http(s) with a host and no user, whose path ends in .pdf or whose query asks for a pdf."""
    safe = u.rlike(r"(?i)\Ahttps?://[^/?#@\s]+([/?#]|\z)")
    path = u.rlike(r"(?i)\Ahttps?://[^/?#]+[^?#]*\.pdf([?#]|\z)")
    query = u.rlike(r"(?i)\A[^?#]*\?([^#]*&)?(format|type|download|filetype)=pdf([&#]|\z)")
    return F.coalesce(safe & (path | query), F.lit(False))


def pdf_url(text: Column) -> Column:
    links = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(https?://[^\s<>\"]+)"), 1), lambda t: F.regexp_replace(t, _TAIL, ""))
    return F.coalesce(F.regexp_replace(F.get(F.filter(links, is_pdf_url), F.lit(0)), r"#.*\z", ""), F.lit(""))


#: Four numbers to 255, leading zeros and nine digits at most, in a private, shared, loopback or link-local range.
_OCTET = r"(?=[0-9]{1,9}(?:\.|\z))0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_INNER = r"(?:0*(?:0|10|127)\.|0*100\.0*(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|0*169\.0*254\.|0*172\.0*(?:1[6-9]|2[0-9]|3[01])\.|0*192\.0*168\.)"
_PRIVATE = rf"\A(?={_OCTET}(?:\.{_OCTET}){{3}}\z){_INNER}"


def is_public_url(u: Column) -> Column:
    """http(s) without user to a host that is neither local nor in a private, shared, loopback or link-local range of IPv4 or IPv6."""
    host = F.lower(F.regexp_extract(u, r"(?i)\Ahttps?://(\[[0-9a-f:.]+\]|[^/?#:@\[\]\s]+)(?::[0-9]+)?(?:[/?#]|\z)", 1))
    host = F.regexp_replace(host, r"[\[\]]", "")
    inner = host.rlike(_PRIVATE)
    local = host.rlike(r"\A(?:localhost|.*\.(?:localhost|local|internal|home\.arpa))\z")
    six = host.rlike(r"\A(?:::1?\z|f[cd]|fe[89ab]|::ffff:(?:0:)?(?:127\.|10\.|192\.168\.))")
    return F.coalesce((host != "") & ~local & ~inner & (~host.contains(":") | ~six) & (F.length(u) <= 4096), F.lit(False))


def public_url(u: Column) -> Column:
    """A public link without its fragment, else ''."""
    return F.when(is_public_url(u), F.regexp_replace(u, r"#.*\z", "")).otherwise("")


def safe_link(u: Column, schemes: str = "https?") -> Column:
    """The link without control characters if it has one of the schemes or is a fragment, else ''."""
    x = F.regexp_replace(F.coalesce(u, F.lit("")), r"[\x00-\x1F\x7F]", "")
    return F.when(x.rlike(rf"(?i)\A(?:(?:{schemes})://|#)"), x).otherwise("")


def scope_key(profile: Column, ids: Column) -> Column:
    """Cache key of a set of identifiers, in whatever order they come."""
    return cache_key(profile, F.array_join(F.array_sort(F.array_distinct(ids)), "\n"))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts, one a line; null parts are empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def sources(values: Column) -> Column:
    """Provider names: trimmed, lower case, valid, distinct and sorted."""
    names = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda v: v.rlike(r"\A[a-z][a-z0-9-]{0,63}\z"))))
