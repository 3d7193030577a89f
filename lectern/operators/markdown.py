"""Structure of Markdown documents. Line and paragraph work is relational; block scanning runs per document in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lectern.functions.text import chain, squash, word_count
from lectern.operators.relational import islands
from lectern.session import bounded_batches

HEADING = r"\A {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*\z"
REFERENCE_HEADING = r"(?i)\A(#{1,6}[ \t]+)?[*_]{0,2}(references?|bibliography|(works|literature)[ \t]+cited|参考(文献|资料|书目))[*_]{0,2}[ \t]*[:：]?[ \t]*#*[ \t]*\z"


def lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n, offset, line, ending)``: lines without their ends, numbered from 0, with character offsets. Null texts give none."""
    source = bounded_batches(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")))
    ints = [T.StructField(n, T.IntegerType()) for n in ("n", "offset")]
    schema = T.StructType([T.StructField(doc, source.schema["doc"].dataType), *ints, T.StructField("line", T.StringType()), T.StructField("ending", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, n, offset, line, ending = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t is None:
                    continue
                at, parts = 0, t.split("\n")
                for k, x in enumerate(parts):
                    bare = x[:-1] if x.endswith("\r") else x
                    of.append(i)
                    n.append(k)
                    offset.append(at)
                    line.append(bare)
                    ending.append((x + "\n")[len(bare) :] if k + 1 < len(parts) else x[len(bare) :])
                    at += len(x) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(n, pa.int32()), pa.array(offset, pa.int32()), pa.array(line, pa.string()), pa.array(ending, pa.string())], schema.names)

    return source.mapInArrow(cut, schema)


def paragraphs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n, block)``: what stands between blank lines."""
    rows = docs.select(doc, F.posexplode(F.split(F.col(text), r"\n[ \t]*\n\s*")).alias("n", "block"))
    return rows.where(F.trim("block") != "")


def headings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, offset, level, title)`` of ATX and Setext headings outside of code."""
    rows = blocks(docs, doc, text).where("type = 'heading'")
    atx = F.col("markdown").rlike(r"\A {0,3}#")
    level = F.when(atx, F.length(F.regexp_extract("markdown", r"\A {0,3}(#{1,6})", 1))).when(F.col("markdown").rlike(r"\n {0,3}=+[ \t]*\z"), 1).otherwise(2)
    bare = F.when(atx, F.regexp_extract("markdown", HEADING, 2)).otherwise(F.regexp_replace("markdown", r"\n {0,3}(=+|-+)[ \t]*\z", ""))
    return rows.select(doc, F.col("begin").alias("offset"), level.cast("int").alias("level"), visible_heading(bare).alias("title")).where("title <> ''")


def visible_heading(c: Column) -> Column:
    return squash(chain(c, (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", ""), (r"`+([^`]*)`+", "$1"), (r"\*{1,3}|_{2,3}|~~", ""), (r"\\([!-/:-@\[-`{-~])", "$1")))


def heading_anchors(heads: DataFrame, slug: Column, doc: str = "doc_id") -> DataFrame:
    """Headings with ``anchor``: the slug, and from its second occurrence on a number."""
    w = Window.partitionBy(doc, "__s").orderBy("offset")
    return heads.withColumn("__s", slug).withColumn("__k", F.row_number().over(w) - 1).withColumn("anchor", F.when(F.col("__k") > 0, F.concat_ws("-", "__s", "__k")).otherwise(F.col("__s"))).drop("__s", "__k")


def table_cells(line: Column) -> Column:
    """Cells of a table row; an escaped pipe is part of its cell."""
    body = F.regexp_replace(F.trim(line), r"\A\||(?<!\\)\|\z", "")
    return F.transform(F.split(body, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def gfm_tables(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n, row, cells)``: tables by their header's line; row 0 is the header; rows have its width."""
    rows = lines(docs, doc, text)
    w = Window.partitionBy(doc).orderBy("n")
    rule = F.col("line").rlike(r"\A\s*\|?(\s*:?-{3,}:?\s*\|)+(\s*:?-{3,}:?\s*)?\z")
    rows = rows.withColumn("__rule", rule).withColumn("__head", F.lead("__rule").over(w) & F.col("line").contains("|") & ~rule)
    rows = rows.withColumn("__start", F.last(F.when(F.col("__head"), F.col("n")), True).over(w))
    rows = rows.withColumn("__gap", F.max(F.when(~F.col("line").contains("|"), F.col("n"))).over(w))
    rows = rows.where(F.col("__start").isNotNull() & (F.coalesce("__gap", F.lit(-1)) < F.col("__start")) & ~F.col("__rule"))
    rows = rows.withColumn("cells", table_cells(F.col("line")))
    t = Window.partitionBy(doc, "__start").orderBy("n")
    width = F.size(F.first("cells").over(t))
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), width)), F.lit(1), width)
    return rows.select(doc, F.col("__start").alias("n"), (F.row_number().over(t) - 1).alias("row"), padded.alias("cells"))


def figure_caption(c: Column) -> Column:
    """``struct(label, description)`` of a figure caption; null where there is none."""
    ident = r"(?:s?[0-9]+[a-z]?|[ivxlcdm]+[a-z]?)"
    latin = rf"(?is)\A((?:algorithm|chart|figure|fig\.?|scheme|table)[ \t]+{ident}[.:：。])[ \t]+(\S.*)\z"
    short = rf"(?is)\A(fig[.．][ \t]*{ident}[.:：。]?)[ \t]*(\S.*)\z"
    han = rf"(?is)\A((?:图表|图)[ \t]*{ident}[.:：。])[ \t]*(\S.*)\z"
    han_bare = rf"(?is)\A((?:图表|图)[ \t]*{ident})[ \t]+(\S.*)\z"
    x = F.trim(c)
    out = F.lit(None).cast("struct<label:string,description:string>")
    for p in (han_bare, short, han, latin):
        out = F.when(x.rlike(p), F.struct(F.regexp_extract(x, p, 1).alias("label"), F.regexp_extract(x, p, 2).alias("description"))).otherwise(out)
    return out


def table_caption(c: Column) -> Column:
    p = r"(?is)\A(table[ \t]+(?:s?[0-9]+[a-z]?|[ivxlcdm]+[a-z]?)[.:]?)[ \t]+(\S.*)\z"
    x = F.trim(c)
    return F.when(x.rlike(p), F.struct(F.regexp_extract(x, p, 1).alias("label"), F.regexp_extract(x, p, 2).alias("description")))


def label_references(c: Column) -> Column:
    """Figure and table labels that a text mentions, as 'figure 3' in lower case, in order."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)\b((?:figure|fig\.|table)[ \t]+s?[0-9]+[a-z]?)\b"), 1)
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"\Afig\.", "figure"), r"[ \t]+", " "))


def numeric_citations(c: Column, limit: int = 100) -> Column:
    """Numbers cited in square brackets, ranges written out (spans above ``limit`` are ignored)."""
    lists = F.regexp_extract_all(c, F.lit(r"\[([0-9]+(?:\s*[,–-]\s*[0-9]+)*)\]"), 1)
    parts = F.flatten(F.transform(lists, lambda x: F.split(F.regexp_replace(x, r"\s+", ""), ",")))

    def numbers(p):
        a, b = F.regexp_extract(p, r"\A([0-9]+)", 1).try_cast("int"), F.coalesce(F.regexp_extract(p, r"[–-]([0-9]+)\z", 1).try_cast("int"), F.regexp_extract(p, r"\A([0-9]+)", 1).try_cast("int"))
        return F.when((b >= a) & (b - a <= limit), F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(parts, numbers)))


def author_year_citations(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, author, year)`` of parenthetical citations such as (Smith et al., 2020; Ng 2019)."""
    groups = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\(([^()]{1,240})\)"), 1))
    parts = docs.select(doc, groups.alias("g")).select(doc, F.explode(F.split("g", ";")).alias("p"))
    p = r"\A\s*(\p{Lu}[\p{L}'’-]+)[^0-9]*?,?\s*((?:18|19|20)[0-9]{2})[a-z]?\s*\z"
    return parts.where(F.col("p").rlike(p)).select(doc, F.regexp_extract("p", p, 1).alias("author"), F.regexp_extract("p", p, 2).cast("int").alias("year"))


def is_block(c: Column) -> Column:
    """Whether a paragraph is a block of another kind than prose."""
    return c.rlike(r"\A( {0,3}(#{1,6}([ \t]|\z)|>|([-+*]|[0-9]+[.)])[ \t]+|```|~~~)| {4}\S|\t\S|<|\$\$|\\\[|!\[[^\]]*\]\(.+\)\s*\z)") | c.rlike(r"(?i)\A(algorithm|chart|fig\.?|figure|scheme|table)[ \t]+[a-z]?[0-9]+")


def join_prose(blocks: DataFrame, doc: str = "doc_id", order: str = "n", block: str = "block", min_words: int = 6) -> DataFrame:
    """``(doc, run, text)``: paragraphs broken in the middle of a sentence joined by a space.

    A paragraph goes on in the next one if both are prose, the first has ``min_words`` words
    and ends in a letter or digit, or in a semicolon with another one later in the sentence,
    and the next begins in lower case. Nothing is joined below a reference heading.
    """
    w = Window.partitionBy(doc).orderBy(order)
    b = blocks.withColumn("__p", F.lag(block).over(w)).withColumn("__ref", F.coalesce(F.max(F.trim("__p").rlike(REFERENCE_HEADING).cast("int")).over(w), F.lit(0)))
    prev, now = F.rtrim(F.col("__p")), F.rtrim(F.col(block))
    goes_on = prev.rlike(r"[\p{L}\p{N}]\z") | (prev.endswith(";") & now.rlike(r"\A[^.!?]*;"))
    joined = prev.isNotNull() & (F.col("__ref") == 0) & ~is_block(prev) & ~is_block(now) & goes_on & now.rlike(r"\A\p{Ll}") & (word_count(prev) >= min_words)
    runs = islands(b.withColumn("__j", F.coalesce(joined, F.lit(False))), [doc], [order], ~F.col("__j"), "run")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, F.rtrim(F.col(block)).alias("t")))), lambda x: x["t"])
    return runs.groupBy(doc, "run").agg(F.array_join(parts, " ").alias("text"))


def bullet_runs(blocks: DataFrame, doc: str = "doc_id", order: str = "n", block: str = "block") -> DataFrame:
    """Blocks with ``text``: in runs of two or more, the bullets that OCR leaves (``•``, ``\\-``) become ``-``."""
    mark = r"\A[ \t]*(?:\\-|•)[ \t]+(?=\S)"
    w = Window.partitionBy(doc).orderBy(order)
    b = blocks.withColumn("__m", F.col(block).rlike(mark) & ~F.col(block).contains("\n"))
    b = b.withColumn("__g", F.sum((~F.col("__m") | ~F.coalesce(F.lag("__m").over(w), F.lit(False))).cast("int")).over(w))
    size = F.count("*").over(Window.partitionBy(doc, "__g", "__m"))
    return b.withColumn("__n", size).withColumn("text", F.when(F.col("__m") & (F.col("__n") >= 2), F.regexp_replace(F.col(block), mark, "- ")).otherwise(F.col(block))).drop("__m", "__g", "__n")


_OPEN = re.compile(r" {0,3}(`{3,}|~{3,})([^\n]*)\Z")


def scan_blocks(text: str) -> list[tuple[str, int, int]]:
    """``(type, begin, end)`` of the top-level blocks of a Markdown text.

    Types: heading, code, math, table, html, quote, list, rule, image, paragraph.
    """
    out, i, at = [], 0, 0
    rows = text.split("\n")
    starts = []
    for r in rows:
        starts.append(at)
        at += len(r) + 1

    def kind(r: str) -> str:
        s = r.strip()
        if s and s[0] not in "#-*_>+<$\\!" and not s[0].isdecimal():
            return "paragraph"
        if re.match(r" {0,3}#{1,6}([ \t]|$)", r):
            return "heading"
        if re.match(r" {0,3}([-*_])[ \t]*(\1[ \t]*){2,}$", r):
            return "rule"
        if re.match(r" {0,3}>", r):
            return "quote"
        if re.match(r" {0,3}([-+*]|\d{1,9}[.)])([ \t]+|$)", r):
            return "list"
        if re.match(r" {0,3}<(/?[A-Za-z]|!--)", r):
            return "html"
        if s.startswith("$$") or s.startswith("\\["):
            return "math"
        if re.fullmatch(r"!\[[^\]]*\]\(.+\)", s):
            return "image"
        return "paragraph"

    while i < len(rows):
        if not rows[i].strip():
            i += 1
            continue
        begin, m = i, _OPEN.match(rows[i])
        if m and not (m.group(1)[0] == "`" and "`" in m.group(2)):
            mark = m.group(1)
            i += 1
            while i < len(rows) and not re.fullmatch(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*", rows[i]):
                i += 1
            i += 1
            out.append(("code", begin, min(i, len(rows))))
            continue
        if re.match(r"( {4}|\t)\S", rows[i]):
            while i < len(rows) and (not rows[i].strip() or re.match(r"( {4}|\t)", rows[i])):
                i += 1
            end = i
            while not rows[end - 1].strip():
                end -= 1
            out.append(("code", begin, end))
            continue
        k = kind(rows[i])
        if k == "math":
            close = "$$" if rows[i].strip().startswith("$$") else "\\]"
            if not (rows[i].strip().endswith(close) and len(rows[i].strip()) > 2):
                while i + 1 < len(rows) and not rows[i + 1].strip().endswith(close):
                    i += 1
                i += 1
            i += 1
        elif k in ("heading", "rule", "image"):
            i += 1
        elif "|" in rows[i] and i + 1 < len(rows) and re.fullmatch(r"\s*\|?(\s*:?-{3,}:?\s*\|)+(\s*:?-{3,}:?\s*)?", rows[i + 1]):
            k = "table"
            while i < len(rows) and "|" in rows[i]:
                i += 1
        else:
            i += 1
            while i < len(rows) and rows[i].strip():
                if k == "paragraph" and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", rows[i]):
                    k = "heading"
                    i += 1
                    break
                if k == "paragraph" and (kind(rows[i]) in ("heading", "rule", "quote", "html", "math") or _OPEN.match(rows[i])):
                    break
                if k in ("quote", "list") and kind(rows[i]) in ("heading", "rule") or _OPEN.match(rows[i]) and k != "html":
                    break
                i += 1
        i = min(i, len(rows))
        if k == "html" and re.match(r" {0,3}<table[\s>]", rows[begin], re.I):
            k = "table"
        out.append((k, begin, i))
    return [(k, starts[a], starts[b - 1] + len(rows[b - 1])) for k, a, b in out]


@F.pandas_udf(T.ArrayType(T.StructType().add("type", "string").add("begin", "integer").add("end", "integer")))
def _blocks(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [] if t is None else [{"type": k, "begin": a, "end": b} for k, a, b in scan_blocks(t)])


def blocks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n, type, begin, end, markdown)`` of the top-level blocks."""
    rows = docs.select(doc, text, F.posexplode(_blocks(F.col(text))).alias("n", "b"))
    return rows.select(doc, "n", "b.type", "b.begin", "b.end", F.substring(F.col(text), F.col("b.begin") + 1, F.col("b.end") - F.col("b.begin")).alias("markdown"))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _fenced(s: pd.Series) -> pd.Series:
    def one(t: str | None) -> list[bool]:
        out, mark = [], ""
        for r in (t or "").split("\n"):
            if mark:
                out.append(True)
                if re.fullmatch(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*", r):
                    mark = ""
            else:
                m = _OPEN.match(r)
                if m and not (m.group(1)[0] == "`" and "`" in m.group(2)):
                    mark = m.group(1)
                out.append(bool(mark) or bool(re.match(r"( {4}|\t)\S", r)))
        return out

    return s.map(one)


def blocked_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n, blocked)``: whether each line lies in fenced or indented code."""
    return docs.select(doc, F.posexplode(_fenced(F.col(text))).alias("n", "blocked"))


_MATH_MARK = re.compile(r"\\[\\$]|\\[()]|\$+|\n")


def inline_math(text: str) -> list[tuple[int, int]]:
    """Ranges of ``$…$`` and ``\\(…\\)`` within lines, in one pass.

    The content must not be blank, its padding the same on both sides; after a closing dollar there may be no digit, nor, if the
    content has spaces, a letter. A dollar that can't close opens anew. Of overlapping ranges the first counts.
    """
    found, dollar, bracket = [], None, None
    for m in _MATH_MARK.finditer(text):
        mark, at = m.group(), m.start()
        if mark == "\n":
            dollar = bracket = None
        elif mark == "\\(":
            bracket = at
        elif mark == "\\)":
            if bracket is not None and text[bracket + 2 : at].strip():
                found.append((bracket, at + 2))
            bracket = None
        elif mark == "$":
            if dollar is not None:
                body, after = text[dollar + 1 : at], text[at + 1 : at + 2]
                fine = body.strip() and body[0].isspace() == body[-1].isspace() and not after.isdigit()
                if fine and not (" " in body and after.isalnum() and after.isascii()):
                    found.append((dollar, at + 1))
                    dollar = None
                    continue
            dollar = at
    out, reach = [], 0
    for b, e in sorted(found):
        if b >= reach:
            out.append((b, e))
            reach = e
    return out


PROTECTED = re.compile(r"(?s)(```.*?```|`[^`\n]+`|!\[[^\]]*\]\([^)]*\)|<[^>\n]+>|https?://\S+|\$\$.*?\$\$|\$[^$\n]+\$|\[[0-9,–\- ]+\])")


@F.pandas_udf(T.StructType().add("text", "string").add("parts", T.ArrayType(T.StringType())))
def protect(s: pd.Series) -> pd.DataFrame:
    """Text with code, images, tags, links, math and numeric citations replaced by numbered placeholders.

    The placeholders' mark is lengthened until the text doesn't contain it.
    """
    texts, parts = [], []
    for t in s:
        kept: list[str] = []
        mark = "\u27e6"
        while t and mark in t:
            mark += "\u27e6"

        def put(m: re.Match, kept=kept, mark=mark) -> str:
            kept.append(m.group(0))
            return f"{mark}{len(kept) - 1}\u27e7"

        texts.append(None if t is None else PROTECTED.sub(put, t))
        parts.append([mark, *kept])
    return pd.DataFrame({"text": texts, "parts": parts})


@F.pandas_udf(T.StringType())
def restore(text: pd.Series, parts: pd.Series) -> pd.Series:
    """The inverse of ``protect``."""
    def one(t, p):
        if t is None:
            return None
        return re.sub(re.escape(p[0]) + r"([0-9]+)\u27e7", lambda m: p[1 + int(m.group(1))], t)

    return pd.Series([one(t, p) for t, p in zip(text, parts)])
