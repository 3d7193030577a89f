"""Anchoring of annotations in Markdown and in the text of pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from lectern.functions import rx as regex
from lectern.functions.text import squash
from lectern.operators.sourcemap import NormalText, VisibleIndex, normal_text, occurrences, visible_text
from lectern.session import spread, structs_of

#: Characters that one side of a quote's context needs to count.
CONTEXT = 12


_FOLDS = [
    (regex.compile(p), new)
    for p, new in (
        (r"[‘’‚‛]", "'"), (r"[“”„‟]", '"'), (r"[‐‑‒–—−]", "-"), (r"(?<=\d)\s*\uFFFD\s*(?=[CF]\b)", "°"), (r"\\pm\b", "±"), (r"\\(?:geq|ge)\b|>=", "≥"), (r"\\(?:leq|le)\b|<=", "≤"), (r"\\(?:neq|ne)\b|!=", "≠"),
        (r"\^\{?\\circ\}?", "°"), (r"\\(?:mathrm|text)\{([^{}]*)\}", r"\1"), (r"\\%", "%"), (r"</?su[bp]>", ""), (r"\$|\\[()]", ""), (r"[_^]\{([^{}]*)\}", r"\1"), (r"(?<=\p{L})-\s+(?=\p{L})", ""), (r"\s+(?=[,.;:!?%)\]])", ""),
    )
]
#: What one of them could change has one of these.
_FOLDABLE = regex.compile(r"[‘’‚‛“”„‟‐‑‒–—−\uFFFD\\<>!^_$-]|\s[,.;:!?%)\]]")


def fold_annotation(s: str) -> str:
    """Comparison form of a page's text: quotes and hyphens unified, words joined over line ends, marks of mathematics plain, no space before punctuation."""
    if _FOLDABLE.search(s):
        for pattern, new in _FOLDS:
            s = pattern.sub(new, s)
    return normal_text(s)


def order_key(sort_index: Column, page: Column, key: Column) -> list[Column]:
    """Order of annotations: sort index, page (missing last), id."""
    return [F.coalesce(sort_index, F.lit("")), page.asc_nulls_last(), F.coalesce(key, F.lit(""))]


def same_annotation(a: Column, b: Column) -> Column:
    """Equal in kind, text and rectangles."""
    return a["type"].eqNullSafe(b["type"]) & squash(a["text"]).eqNullSafe(squash(b["text"])) & a["rects"].eqNullSafe(b["rects"])


def existing_annotations(wanted: DataFrame, held: DataFrame, most: int = 10_000) -> DataFrame:
    """``(wanted_id, id)``: annotations of the same document, kind, text and rectangles that are there already; the smallest id."""
    a = wanted.where(F.size("rects") <= most).select("wanted_id", "doc_id", "type", squash("text").alias("t"), "rects")
    b = held.select("id", "doc_id", "type", squash("text").alias("t"), "rects")
    return a.join(b, ["doc_id", "type", "t", "rects"]).groupBy("wanted_id").agg(F.min("id").alias("id"))


def _by_context(text: str, found: list[int], size: int, prefix: str, suffix: str) -> list[int]:
    p, s = normal_text(prefix or ""), normal_text(suffix or "")
    good = found
    if len(p) >= CONTEXT:
        good = [i for i in good if text[:i].rstrip().endswith(p)]
    if len(s) >= CONTEXT:
        good = [i for i in good if text[i + size :].lstrip().startswith(s)]
    return good if len(p) >= CONTEXT or len(s) >= CONTEXT else []


def anchor(markdown: str, pages: list[tuple[int, int, int]], notes: list[dict]) -> Iterator[tuple]:
    """``(id, begin, end, how)`` of annotations in order; how is saved, exact, page, order, context, folded, ambiguous or not-found.

    ``pages`` has ``(begin, end, page)`` ranges of the Markdown. A saved range counts if it still holds the text. Else one
    occurrence is taken: the only one, the only one on the annotation's page, the only one after what was matched before,
    or the only one in the quote's context; and without any, the same in the folded form of the text.
    """
    index, folded, last = VisibleIndex(markdown), None, 0

    def page_of(begin: int, end: int) -> int | None:
        hit = [p for b, e, p in pages if b <= begin and end <= e]
        return hit[0] if len(hit) == 1 else None

    for note in notes:
        target, span, how = normal_text(note["text"] or ""), None, "not-found"
        b, e = note.get("begin"), note.get("end")
        if b is not None and e is not None and 0 <= b < e <= len(markdown) and target and normal_text(visible_text(markdown[b:e])) == target:
            span, how = (b, e), "saved"
        found = occurrences(index.text, target)[0] if target and span is None else []
        spans = [index.source_range(i, i + len(target)) for i in found]
        if spans:
            how, at = "exact", list(range(len(spans)))
            hints = [page_of(*spans[k]) for k in at]
            if len(at) > 1 and note.get("page") is not None and None not in hints:
                at, how = [k for k in at if hints[k] == note["page"]], "page"
            if len(at) > 1 and last > 0:
                after = [k for k in at if spans[k][0] >= last]
                if len(after) == 1:
                    at, how = after, "order"
            if len(at) != 1:
                near = _by_context(index.text, found, len(target), note.get("prefix"), note.get("suffix"))
                at, how = ([found.index(near[0])], "context") if len(near) == 1 else ([], "ambiguous")
            span = spans[at[0]] if at else None
        elif target and span is None:
            if folded is None:
                folded = [(m.start(), fold_annotation(m[0])) for m in regex.finditer(r"[^\n]+", markdown)]
            want = fold_annotation(note["text"])
            hits = [(i, f) for i, f in folded if want and want in f]
            if len(hits) == 1 and hits[0][1].count(want) == 1:
                i = hits[0][0]
                line = markdown[i:].split("\n", 1)[0]
                span, how = (i, i + len(line)), "folded"
            elif hits:
                how = "ambiguous"
        if span:
            last = max(last, span[1])
        yield note["id"], *(span or (None, None)), how


def overlay(docs: DataFrame, annotations: DataFrame, page_ranges: DataFrame | None = None, doc: str = "doc_id", text: str = "markdown") -> DataFrame:
    """``(doc, id, begin_at, end_at, how)``: annotations joined to the text of their document.

    ``annotations`` is ``(doc, id, text, sort_index, page_index, prefix, suffix, begin, end)``; ``page_ranges`` ``(doc, begin, end, page)``.
    A document's annotations are taken in their order, as each match restricts the later ones. Annotations of documents that
    aren't there are left out; empty texts are not found.
    """
    item = F.struct(F.coalesce("sort_index", F.lit("")).alias("s"), F.coalesce("page_index", F.lit(2**31 - 1)).alias("p"), "id", "text", F.col("page_index").alias("page"), "prefix", "suffix", "begin", "end")
    packed = spread(annotations, doc).groupBy(doc).agg(F.array_sort(F.collect_list(item)).alias("notes"))
    rows = spread(docs.select(doc, F.coalesce(text, F.lit("")).alias("md")), doc).join(packed, doc)
    if page_ranges is not None:
        rows = rows.join(page_ranges.groupBy(doc).agg(F.collect_list(F.struct("begin", "end", "page")).alias("pages")), doc, "left")
    else:
        rows = rows.withColumn("pages", F.lit(None).cast("array<struct<begin:int,end:int,page:int>>"))
    rows = rows.select(doc, "md", "notes", "pages")
    kind = annotations.schema["id"].dataType
    schema = T.StructType([rows.schema[doc], T.StructField("id", kind), T.StructField("begin_at", T.IntegerType()), T.StructField("end_at", T.IntegerType()), T.StructField("how", T.StringType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, *a) for i, md, notes, pages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *map(structs_of, batch.columns[2:])) for a in anchor(md, [(p["begin"], p["end"], p["page"]) for p in pages or ()], notes)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema.names)

    return rows.mapInArrow(run, schema)


def merged_overlays(*parts: DataFrame) -> DataFrame:
    """Union of overlays; of annotations with one id the first part's counts."""
    union = None
    for n, p in enumerate(parts):
        p = p.withColumn("__n", F.lit(n))
        union = p if union is None else union.unionByName(p)
    w = Window.partitionBy("doc_id", "id").orderBy("__n")
    return union.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__n", "__k")


def panel_order(found: DataFrame, annotations: DataFrame) -> DataFrame:
    """All annotations, matched or not, numbered in their order within the document."""
    rows = annotations.join(found.select("doc_id", "id", "how"), ["doc_id", "id"], "left").withColumn("matched", F.coalesce(~F.col("how").isin("ambiguous", "not-found"), F.lit(False)))
    w = Window.partitionBy("doc_id").orderBy(*order_key(F.col("sort_index"), F.col("page_index"), F.col("id").cast("string")))
    return rows.withColumn("n", F.row_number().over(w) - 1)


# Text of pages


def _index_without(source: str, pattern: str) -> NormalText:
    """The normal form of what a pattern leaves of a text."""
    gone = [m.span() for m in regex.finditer(pattern, source)]
    if not gone:
        return NormalText(source)
    kept = [k for b, e in zip([0, *(e for _, e in gone)], [*(b for b, _ in gone), len(source)]) for k in range(b, e)]
    return NormalText("".join(source[k] for k in kept), kept, [k + 1 for k in kept])


def locate(pages: list[dict], note: dict, known: dict | None = None) -> tuple[int | None, int | None, int | None, str]:
    """``(page, begin, end, how)`` of a text in pages ``{page_index, text}``, in characters of the page's text.

    Ways in order: words joined at line ends, hyphens kept, without hyphens; and for texts of 32 characters or more, with § read as ±.
    More than one place is decided by the quote's context, or is ambiguous. ``known`` keeps the forms of the pages for other texts.
    """
    known = {} if known is None else known
    ways = [("joined", r"(?<=\p{L})-\s+(?=\p{L})"), ("hyphens", r"(?<=\p{L}-)\s+(?=\p{L})"), ("folded", r"(?<=\p{L})[-‐‑]\s*(?=\p{L})")]
    some = [(k, p) for k, p in enumerate(pages) if note.get("page") is None or p["page_index"] == note["page"]]
    for glyph in (False, True):
        if glyph and not (len(note["text"] or "") >= 32 and regex.search(r"±\s*\d", note["text"])):
            break
        for how, pattern in ways:
            target = normal_text(regex.sub(pattern, "", note["text"] or ""))
            hits = []
            for k, p in some:
                index = known.get((k, pattern, glyph))
                if index is None:
                    source = regex.sub(r"§(?=\s*\d)", "±", p["text"] or "") if glyph else p["text"] or ""
                    index = known[k, pattern, glyph] = _index_without(source, pattern)
                hits += [(p["page_index"], index, i) for i in occurrences(index.text, target)[0]]
            if len(hits) > 1:
                near = [h for h in hits if _by_context(h[1].text, [h[2]], len(target), note.get("prefix"), note.get("suffix"))]
                if len(near) != 1:
                    return None, None, None, "ambiguous"
                hits, how = near, "context"
            if hits:
                page, index, i = hits[0]
                return page, *index.source_range(i, i + len(target)), "glyph" if glyph else how
    return None, None, None, "not-found"


def locate_in_pages(notes: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``(doc, id, page_index, begin_at, end_at, how)`` of texts ``(doc, id, text, page, prefix, suffix)`` in pages ``(doc, page_index, text)``."""
    packed = spread(notes, doc).groupBy(doc).agg(F.collect_list(F.struct("id", "text", "page", "prefix", "suffix")).alias("notes"))
    text = spread(pages, doc).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("pages"))
    rows = packed.join(text, doc).select(doc, "notes", "pages")
    schema = T.StructType([rows.schema[doc], notes.schema["id"], *(T.StructField(n, T.IntegerType()) for n in ("page_index", "begin_at", "end_at")), T.StructField("how", T.StringType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, n["id"], *locate(ps, n, known)) for i, ns, ps in zip(batch.column(0).to_pylist(), *map(structs_of, batch.columns[1:])) for known in ({},) for n in ns]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema.names)

    return rows.mapInArrow(run, schema)


def item_rects(ranges: DataFrame, items: DataFrame) -> DataFrame:
    """Rectangles of ranges ``(doc_id, id, page_index, begin_at, end_at)`` over text items ``(.., source_from, source_to, x, y, width, height)``.

    An item's part is its share of characters. Parts on one line (both edges within 1) with a gap of 2 or less are one rectangle.
    """
    hit = spread(ranges, "doc_id").join(spread(items, "doc_id"), ["doc_id", "page_index"]).where("source_from < end_at and begin_at < source_to")
    share = lambda c: (c - F.col("source_from")) / (F.col("source_to") - F.col("source_from"))
    x0 = F.col("x") + F.col("width") * share(F.greatest("begin_at", "source_from"))
    x1 = F.col("x") + F.col("width") * share(F.least("end_at", "source_to"))
    parts = hit.select("doc_id", "id", "page_index", "source_from", x0.alias("x0"), x1.alias("x1"), F.col("y").alias("y0"), (F.col("y") + F.col("height")).alias("y1"))
    w = Window.partitionBy("doc_id", "id", "page_index").orderBy("source_from")
    new = F.lag("x0").over(w).isNull() | (F.abs(F.col("y0") - F.lag("y0").over(w)) > 1) | (F.abs(F.col("y1") - F.lag("y1").over(w)) > 1) | (F.col("x0") - F.lag("x1").over(w) > 2)
    runs = parts.withColumn("__new", new.cast("int")).withColumn("run", F.sum("__new").over(w))
    return runs.groupBy("doc_id", "id", "page_index", "run").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def unique_on_page(hits: DataFrame) -> DataFrame:
    """``(query_id, hit)``: the only search hit on the page that the query names."""
    on = hits.where("page_index = hint").groupBy("query_id").agg(F.count("*").alias("n"), F.min("hit").alias("hit"))
    return on.where("n = 1").select("query_id", "hit")
