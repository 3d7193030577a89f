"""Scalar rules of records: texts, metadata, paths, geometry, progress and requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from lectern.functions import identifiers as I
from lectern.functions.text import chain, squash


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


# Text


def leading(c: Column, n: int, at: int | Column = 0) -> Column:
    """At most ``n`` characters from offset ``at``."""
    return F.substring(c, F.lit(at) + 1, F.lit(n))


def trailing(c: Column, n: int, to: Column | None = None) -> Column:
    """At most ``n`` characters before offset ``to`` (the end)."""
    end = F.length(c) if to is None else to
    begin = F.greatest(end - n, F.lit(0))
    return F.substring(c, begin + 1, end - begin)


def text_quote(c: Column, begin: Column, end: Column, n: int = 80) -> Column:
    """``struct(prefix, suffix)``: up to ``n`` characters before and after a range."""
    return F.struct(trailing(c, n, begin).alias("prefix"), F.substring(c, end + 1, F.lit(n)).alias("suffix"))


def title_query(c: Column, limit: int = 512) -> Column:
    """The likely title within a reference: without closing year and edition; from the last word before a colon on, or else the longest part of 12 characters or more."""
    x = chain(
        squash(_text(c)), (r"(?i)\s*\([^()]{0,256}\b(?:18|19|20)[0-9]{2}[a-z]?\b[^()]{0,256}\)\s*\.?\z", ""), (r"(?i)\s+\b[0-9]+(?:st|nd|rd|th)\s+(?:edn|edition)\b\s*\.?\z", ""),
        (r"(?i)\s+\b(?:edn|edition)\b\s*\.?\z", ""), (r"(?i)\s+\b(?:18|19|20)[0-9]{2}[a-z]?\b\s*\.?\z", ""),
    )
    x = F.trim(x)
    tail = F.regexp_extract(x, r"(?s)\A[^:]*?([\p{L}\p{N}][\p{L}\p{N}'’\x{2010}-]*[^:\p{L}\p{N}]*:.*)\z", 1)
    parts = F.filter(F.transform(F.split(x, r"(?:\.\s+|[。；;]\s*)"), lambda p: F.trim(p)), lambda p: F.length(p) >= 12)
    best = F.get(F.filter(parts, lambda p: F.length(p) == F.array_max(F.transform(parts, lambda q: F.length(q)))), F.lit(0))
    found = F.when(F.instr(x, ":") > 0, F.when(tail != "", tail).otherwise(x)).otherwise(F.coalesce(best, x))
    return F.substring(squash(found), 1, limit)


def unclosed_parenthesis(c: Column) -> Column:
    """Whether more brackets are opened than closed; a closing one without an opening one is ignored."""
    marks = F.split(F.translate(F.regexp_replace(c, r"[^()（）]", ""), "（）", "()"), "")
    depth = F.aggregate(marks, F.lit(0), lambda d, x: F.when(x == "(", d + 1).when((x == ")") & (d > 0), d - 1).otherwise(d))
    return F.coalesce(depth > 0, F.lit(False))


def unescape_html(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_label(c: Column) -> Column:
    return F.regexp_replace(squash(c), r"([\\\[\]])", r"\\$1")


def escape_cell(c: Column) -> Column:
    """Cell of a table: pipes and backslashes before them escaped, line ends as a break."""
    return chain(c, (r"(\\*)\|", r"$1$1\\|"), (r"\r?\n", "<br>"))


def escape_alt(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\\[\]])", r"\\$1")


def unescape_alt(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\\[\]])", "$1")


def keep_hyphens(c: Column) -> Column:
    """A word broken at a line end is joined, its hyphen stays."""
    return F.regexp_replace(c, r"(?<=\p{L}-)\s+(?=\p{L})", "")


def fold_hyphens(c: Column) -> Column:
    """Words without any of their hyphens, broken at a line end or not."""
    return F.regexp_replace(c, r"(?<=\p{L})[-‐‑]\s*(?=\p{L})", "")


def year_list(c: Column) -> Column:
    """Years at the beginning, separated by commas, with their letters."""
    run = F.regexp_extract(_text(c), r"(?i)\A\s*((?:18|19|20)[0-9]{2}[a-z]?(?:\s*[,，]\s*(?:18|19|20)[0-9]{2}[a-z]?)*)", 1)
    return F.regexp_extract_all(F.lower(run), F.lit(r"((?:18|19|20)[0-9]{2}[a-z]?)"), 1)


def panel_label(c: Column) -> Column:
    """Comparison form of a panel's label."""
    return F.lower(F.regexp_replace(F.translate(_text(c), "（）", "()"), r"(?U)\s+", ""))


def code_language(c: Column) -> Column:
    """Usual name of a code block's language, '' if unknown to it."""
    alias = {"js": "javascript", "mjs": "javascript", "ts": "typescript", "py": "python", "sh": "bash", "shell": "bash", "zsh": "bash", "yml": "yaml", "c++": "cpp", "cs": "csharp", "rb": "ruby", "rs": "rust", "md": "markdown", "html": "xml", "tex": "latex", "golang": "go"}
    first = F.lower(F.regexp_extract(F.trim(_text(c)), r"\A(?:\{\.)?([A-Za-z0-9+#.-]+)", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in alias.items() for x in kv]), first), first)


def may_highlight(code: Column, chars: int = 50000, lines: int = 5000) -> Column:
    return (F.length(code) <= chars) & (F.regexp_count(code, F.lit("\n")) < lines)


def fence_of(line: Column) -> Column:
    """Marks that open a fence, '' if the line opens none."""
    return F.regexp_extract(_text(line), r"\A {0,3}(`{3,}(?=[^`]*\z)|~{3,})", 1)


def line_ending(line: Column) -> Column:
    return F.regexp_extract(_text(line), r"(\r?\n|\r)\z", 1)


def trailing_spaces(line: Column) -> Column:
    return F.length(F.regexp_extract(F.regexp_replace(_text(line), r"\r?\n\z", ""), r"( *)\z", 1))


def is_indented_code(line: Column) -> Column:
    return _text(line).rlike(r"\A(?: {4}|\t)\s*\S")


# Predicates on blocks


def is_reorderable(kind: Column, locations: Column, text: Column) -> Column:
    """Prose with a place on a page, that may be moved within its columns."""
    other = text.rlike(r"\A(?: {0,3}(?:#{1,6}(?:[ \t]|\z)|>|(?:[-+*]|[0-9]+[.)])[ \t]+|```|~~~)| {4}\S|\t\S|<|\$\$|\\\[|\\begin\{)")
    return F.coalesce((kind == "text") & (F.size(locations) > 0) & (F.trim(text) != "") & ~other, F.lit(False))


def is_image_only(block: Column) -> Column:
    rows = F.filter(F.transform(F.split(_text(block), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return (F.size(rows) > 0) & F.forall(rows, lambda x: x.rlike(r"\A!\[[^\]\n]*\]\(.+\)[ \t]*\z"))


def ends_incomplete(text: Column, words: int = 6) -> Column:
    """Ends with an operator or an opening or listing mark, after enough words."""
    x = F.rtrim(_text(text))
    return x.rlike(r"[+\-*/=<>≤≥≠(\[{,;:]\z") & (F.regexp_count(x, F.lit(r"\p{L}[\p{L}\p{N}'’-]*")) >= words)


def starts_as_continuation(text: Column) -> Column:
    x = F.ltrim(_text(text))
    return (x != "") & ~x.rlike(r"\A(?:#{1,6}(?:\s|\z)|(?:[-+*]|[0-9]+[.)])\s+|>\s|```|~~~|<)")


def at_page_top(locations: Column, most: float = 220) -> Column:
    return F.forall(locations, lambda x: x["bbox"][1] <= most)


def single_page(locations: Column) -> Column:
    """The page of all locations, null if there are several or none."""
    pages = F.array_distinct(F.transform(locations, lambda x: x["page_index"]))
    return F.when(F.size(pages) == 1, F.get(pages, F.lit(0)))


def earliest(locations: Column) -> Column:
    """First of the locations by page, top and left; its page is the flow's page."""
    return F.array_min(F.transform(locations, lambda x: F.struct(x["page_index"].alias("page"), x["bbox"][1].alias("y0"), x["bbox"][0].alias("x0"))))


def shares_ab_panels(caption: Column) -> Column:
    return caption.rlike(r"(?i)[(（]\s*a\s*[)）]") & caption.rlike(r"(?i)[(（]\s*b\s*[)）]")


def is_numeric_citation(c: Column) -> Column:
    return c.rlike(r"\A[0-9]+(?:\s*[-–—]\s*[0-9]+)?(?:\s*[,，;；]\s*[0-9]+(?:\s*[-–—]\s*[0-9]+)?)*\z")


def is_translatable_text(kind: Column, text: Column) -> Column:
    """A heading, paragraph, list, quote or table with a letter or digit outside of placeholders, that is not display math alone."""
    bare = F.regexp_replace(text, "⟦+[0-9]+⟧", "")
    math = F.trim(text).rlike(r"(?s)\A(?:\$\$.*\$\$|\\\[.*\\\])\z")
    return kind.isin("heading", "paragraph", "list", "quote", "table") & bare.rlike(r"[\p{L}\p{N}]") & ~math


def provider_supports(provider: Column, doi: Column, arxiv: Column) -> Column:
    """Whether a provider can look a paper up by the identifiers it has."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(provider == "semantic-scholar", has(doi) | has(arxiv)).when(provider.isin("openalex", "opencitations"), has(doi)).otherwise(F.lit(False))


def is_safe_body(html: Column) -> Column:
    x = F.lower(html)
    bad = x.rlike(r"</?(?:script|iframe|object|embed|form|style)\b") | x.rlike(r"\bon[a-z]+\s*=") | x.rlike(r"(?:href|src)\s*=\s*[\"']\s*javascript:") | x.rlike(r"<img\b[^>]*\bsrc\s*=")
    return ~bad


def note_html(c: Column, prefix: str = "doc") -> Column:
    """Layout wrappers (sections, figures, panels, algorithms) as plain paragraphs, for a note editor that knows none."""
    return F.trim(chain(
        c, (rf'(?is)<div\b[^>]*class="[^"]*{prefix}-figure-panel-label[^"]*"[^>]*>(.*?)</div>', "<p>$1</p>"), (r"(?i)</?(?:section|figure)\b[^>]*>", ""),
        (rf'(?i)<div\b[^>]*class="[^"]*{prefix}-(?:figure-panel|algorithm)[^"]*"[^>]*>', ""), (r"(?i)</div>", ""), (r"(?i)<figcaption>", f'<p class="{prefix}-caption">'), (r"(?i)</figcaption>", "</p>"), (r"\n{3,}", "\n\n"),
    ))


# Identifiers and metadata


def labelled_identifiers(doi: Column, extra: Column) -> Column:
    """``struct(doi, arxiv_id)``: the field first, else the first labelled line of the notes."""
    rows = F.transform(F.split(F.substring(_text(extra), 1, 65536), r"\r?\n"), lambda x: F.trim(x))
    first = lambda pattern, normal: F.coalesce(F.get(F.filter(F.transform(rows, lambda r: normal(F.regexp_extract(r, pattern, 1))), lambda v: v != ""), F.lit(0)), F.lit(""))
    own = I.doi(doi)
    found = first(r"(?i)\A(?:doi\s*:\s*|https?://(?:dx\.)?doi\.org/)(\S+)\z", I.doi)
    arxiv = first(r"(?i)\A(?:arxiv(?:\s+id)?\s*:\s*(?=\S+\z)|(?=https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/\S+\z))(\S+)\z", I.arxiv)
    return F.struct(F.when(own != "", own).otherwise(found).alias("doi"), arxiv.alias("arxiv_id"))


def item_identifiers(doi: Column, pmid: Column, extra: Column) -> Column:
    """``struct(doi, arxiv_id, pmid, openalex_id)`` from an item's fields and notes."""
    note = lambda pattern: F.regexp_extract(_text(extra), pattern, 1)
    own = F.when(_text(pmid) != "", pmid).otherwise(note(r"(?i)(?:\A|\n)\s*(?:PMID|PubMed ID)\s*:\s*([0-9]{1,12})"))
    return F.struct(I.doi(doi).alias("doi"), I.arxiv(note(r"(?i)(?:\A|\n)\s*arxiv(?:\s+id)?\s*:\s*([^\n]+)")).alias("arxiv_id"), I.pmid(own).alias("pmid"), I.openalex(note(r"(?i)(?:\A|\n)\s*OpenAlex(?:\s+ID)?\s*:\s*(\S+)")).alias("openalex_id"))


def paper_node(library: Column, key: Column) -> Column:
    """``library:key``; an error if either is missing."""
    good = library.isNotNull() & (F.coalesce(key, F.lit("")) != "")
    return F.when(good, F.concat_ws(":", library.cast("string"), key)).otherwise(F.raise_error(F.lit("a paper needs a library and a key")))


def year_or_zero(c: Column) -> Column:
    """A year of 0 to 9999, else 0."""
    y = F.trim(_text(c)).try_cast("double")
    return F.when((y >= 0) & (y <= 9999) & (y == F.floor(y)), y.cast("int")).otherwise(0)


def provider_record(raw: Column) -> Column:
    """What ``paper_of_record`` reads of a provider's JSON record."""
    return F.from_json(raw, "paperId string, title string, year string, externalIds struct<DOI:string,ArXiv:string>, authors array<struct<name:string>>")


def provider_paper(raw: Column) -> Column:
    """``struct(paper_id, title, year, doi, arxiv_id, authors)`` of a provider's JSON record; null without a valid paper id."""
    return paper_of_record(provider_record(raw))


def paper_of_record(x: Column) -> Column:
    paper = F.trim(F.substring(F.coalesce(x["paperId"], F.lit("")), 1, 4096))
    names = F.filter(F.transform(F.slice(F.coalesce(x["authors"], F.array().cast("array<struct<name:string>>")), 1, 100), lambda a: squash(F.substring(F.coalesce(a["name"], F.lit("")), 1, 256))), lambda v: v != "")
    row = F.struct(paper.alias("paper_id"), squash(F.substring(F.coalesce(x["title"], F.lit("")), 1, 512)).alias("title"), year_or_zero(x["year"]).alias("year"), I.doi(x["externalIds"]["DOI"]).alias("doi"), I.arxiv(x["externalIds"]["ArXiv"]).alias("arxiv_id"), names.alias("authors"))
    return F.when(paper.rlike(r"\A[A-Za-z0-9._:-]+\z"), row)


ITEM_TYPES = {"article": "journalArticle", "journal-article": "journalArticle", "book": "book", "book-chapter": "bookSection", "conference": "conferencePaper", "proceedings-article": "conferencePaper", "preprint": "preprint", "dissertation": "thesis", "report": "report", "dataset": "dataset"}


def item_type(c: Column) -> Column:
    """Library type of a provider's type; unknown ones are documents."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ITEM_TYPES.items() for x in kv]), F.lower(F.trim(_text(c)))), F.lit("document"))


def item_year(year: Column, date: Column) -> Column:
    """The year field, else the first year in the date, else 0."""
    own = year_or_zero(year)
    return F.when(own > 0, own).otherwise(F.coalesce(F.nullif(F.regexp_extract(_text(date), r"((?:18|19|20)[0-9]{2})", 1), F.lit("")).cast("int"), F.lit(0)))


def creator(name: Column) -> Column:
    """``struct(first, last)``: 'Last, First' at the comma, else the last word is the last name."""
    x = squash(_text(name))
    comma = F.instr(x, ",") > 0
    last = F.when(comma, F.trim(F.substring_index(x, ",", 1))).otherwise(F.substring_index(x, " ", -1))
    first = F.when(comma, F.trim(F.regexp_replace(x, r"\A[^,]*,", ""))).otherwise(F.trim(F.substring(x, F.lit(1), F.length(x) - F.length(F.substring_index(x, " ", -1)))))
    return F.struct(first.alias("first"), last.alias("last"))


def has_pdf(attachments: Column) -> Column:
    """Whether one of the attachments ``(mime, path)`` is a PDF by its type or its name."""
    return F.exists(F.slice(attachments, 1, 1000), lambda a: (F.lower(F.coalesce(a["mime"], F.lit(""))) == "application/pdf") | F.coalesce(a["path"], F.lit("")).rlike(r"(?i)\.pdf\z"))


# Paths


def normal_path(path: Column, base: Column | None = None) -> Column:
    """Path below ``base`` with '.' and '..' resolved, '' if it would leave the root."""
    whole = F.replace(_text(path) if base is None else F.concat_ws("/", base, _text(path)), F.lit("\\"), F.lit("/"))
    start = F.array().cast("array<string>")
    out = F.aggregate(
        F.filter(F.split(whole, "/"), lambda s: (s != "") & (s != ".")), F.struct(start.alias("p"), F.lit(True).alias("ok")),
        lambda a, s: F.when(s == "..", F.struct(F.slice(a["p"], F.lit(1), F.greatest(F.size(a["p"]) - 1, F.lit(0))).alias("p"), (a["ok"] & (F.size(a["p"]) > 0)).alias("ok"))).otherwise(F.struct(F.concat(a["p"], F.array(s)).alias("p"), a["ok"].alias("ok"))),
    )
    return F.when(out["ok"], F.array_join(out["p"], "/")).otherwise(F.lit(""))


def asset_path(path: Column) -> Column:
    """A relative path without '..', else ''."""
    x = F.replace(_text(path), F.lit("\\"), F.lit("/"))
    bad = x.rlike(r"(?:\A|/)\.\.(?:/|\z)") | x.rlike(r"\A(?:/|[A-Za-z][A-Za-z0-9+.-]*:)")
    return F.when(bad, F.lit("")).otherwise(normal_path(x))


def page_list(c: Column) -> Column:
    """Pages of 0 and above, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(c, lambda p: p >= 0)))


# Geometry


def page_rect(bbox: Column, width: Column, height: Column, transform: Column) -> Column:
    """Rectangle ``[x0, y0, x1, y1]`` on the page of a box in thousandths, as the hull of its corners after the affine ``transform``."""
    x = lambda i: bbox[i] / 1000 * width
    y = lambda i: bbox[i] / 1000 * height
    corners = [(x(i), y(j)) for i in (0, 2) for j in (1, 3)]
    det = transform[0] * transform[3] - transform[1] * transform[2]
    back = [((transform[3] * (p - transform[4]) - transform[2] * (q - transform[5])) / det, (transform[0] * (q - transform[5]) - transform[1] * (p - transform[4])) / det) for p, q in corners]
    return F.when(det != 0, F.array(F.least(*[p for p, _ in back]), F.least(*[q for _, q in back]), F.greatest(*[p for p, _ in back]), F.greatest(*[q for _, q in back])))


def sort_part(c: Column, width: int) -> Column:
    return F.lpad(F.least(F.greatest(F.floor(c).cast("bigint"), F.lit(0)), F.lit(10**width - 1)).cast("string"), width, "0")


def sort_index(page: Column, offset: Column, height: Column, top: Column) -> Column:
    """Five digits of page, six of offset, five of the distance from the top."""
    return F.concat_ws("|", sort_part(page, 5), sort_part(offset, 6), sort_part(height - top, 5))


def sort_offset(index: Column) -> Column:
    return F.nullif(F.regexp_extract(_text(index), r"\A[0-9]{5}\|([0-9]{6})\|[0-9]{5}\z", 1), F.lit("")).cast("int")


def node_radius(degree: Column) -> Column:
    return 6 + F.least(F.lit(8.0), 2.4 * F.sqrt(F.greatest(degree, F.lit(0))))


def progress(extracted: Column, total: Column, low: int = 20, high: int = 90, fallback: int = 40) -> Column:
    """Per cent within ``low`` and ``high`` of the pages done; the fallback without a count of pages."""
    value = F.floor(low + (high - low) * extracted / total + 0.5)
    return F.when((total > 0) & extracted.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value))).otherwise(fallback).cast("int")


def backoff(attempt: Column, base_ms: int = 500) -> Column:
    return (F.lit(base_ms) * F.pow(F.lit(2), attempt)).cast("bigint")


def retry_after(value: Column, now: Column, most_ms: int = 60000) -> Column:
    """Milliseconds of a Retry-After header: seconds or a date of HTTP; null if it is neither."""
    seconds = F.trim(value).try_cast("double")
    stamp = F.try_to_timestamp(F.regexp_replace(value, r"\A[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    ms = F.when(seconds >= 0, seconds * 1000).when(stamp.isNotNull(), F.greatest(F.lit(0.0), (F.unix_timestamp(stamp) - F.unix_timestamp(now)).cast("double") * 1000))
    return F.when(ms.isNotNull(), F.least(F.lit(most_ms), ms)).cast("bigint")


# Tasks and usage


def is_retryable(status: Column, code: Column) -> Column:
    """Throttled, server or network errors and timeouts are worth another try."""
    return F.coalesce((status == 429) | status.between(500, 599) | code.isin("network", "timeout"), F.lit(False))


def is_terminal(code: Column) -> Column:
    return code.isin("failed", "expired", "not-found", "invalid-response", "too-large")


def own_result(rows: Column, data_id: Column, file_name: Column) -> Column:
    """Of polled results the one with the data id, else the file name, else the only one."""
    by_id = F.get(F.filter(rows, lambda r: r["data_id"] == data_id), F.lit(0))
    by_name = F.get(F.filter(rows, lambda r: r["file_name"] == file_name), F.lit(0))
    return F.coalesce(by_id, by_name, F.when(F.size(rows) == 1, F.get(rows, F.lit(0))))


def count_or_null(c: Column) -> Column:
    """A whole number of 0 and above, else null."""
    x = c.try_cast("double")
    return F.when((x >= 0) & (x == F.floor(x)), x.cast("bigint"))


def finish_reason(c: Column) -> Column:
    return F.when(c.isin("stop", "length", "content-filter", "tool-calls", "error", "other"), c)


def byte_limit(c: Column, least: int = 1, most: int = 64 << 20, default: int = 4 << 20) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(count_or_null(c), F.lit(default))))


LANGUAGES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "zh-CN": "Simplified Chinese", "ja": "Japanese"}


def translation_prompt(language: Column, payload: Column) -> Column:
    """Messages for a translator: what to do, then the blocks as JSON."""
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), language), language)
    task = F.concat(F.lit("Translate each block into "), name, F.lit(". Keep placeholders as they are. Answer with a JSON array of {id, translatedMarkdown}."))
    return F.array(F.struct(F.lit("system").alias("role"), task.alias("content")), F.struct(F.lit("user").alias("role"), payload.alias("content")))


def reuse_translation(found: Column, wanted: Column) -> Column:
    """Whether a stored translation serves: language equal, and the key, or without a key document, source and settings."""
    same = lambda n: found[n].eqNullSafe(wanted[n])
    return same("language") & F.when(found["key"].isNotNull(), same("key")).otherwise(same("doc_id") & same("source_hash") & same("settings_hash"))


def all_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts)
