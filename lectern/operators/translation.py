"""Translation: sections, batches, request plan, responses, views."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lectern.functions.records import is_translatable_text
from lectern.functions.text import token_estimate
from lectern.operators import markdown as M
from lectern.operators.relational import greedy_batches, islands
from lectern.session import materialize


def sections(blocks: DataFrame, doc: str, order: str, starts: str) -> DataFrame:
    """Blocks with ``section``: one more at every block that starts one, unless it is the document's first."""
    w = Window.partitionBy(doc).orderBy(order)
    return islands(blocks.withColumn("__b", F.col(starts) & (F.row_number().over(w) > 1)), [doc], [order], F.col("__b"), "section").drop("__b")


def batches(blocks: DataFrame, keys: list[str], order: str, text: str, translatable: str, max_blocks: int = 8, max_tokens: int = 2000) -> DataFrame:
    return greedy_batches(blocks.withColumn("__t", token_estimate(F.col(text))), keys, order, "__t", translatable, max_blocks, max_tokens)


def payloads(blocks: DataFrame, packed: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """``(keys, batch, payload)``: the JSON array of a batch's blocks in order."""
    rows = blocks.join(packed, [*keys, order])
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t")))), lambda x: F.struct(x[order].cast("string").alias("id"), x["t"].alias("markdown")))
    return rows.groupBy(*keys, "batch").agg(F.to_json(items).alias("payload"))


def plan(blocks: DataFrame, baseline: DataFrame, keys: list[str], translatable: str = "translatable", force: bool = False, retry: DataFrame | None = None) -> DataFrame:
    """Blocks with ``action``: retain what the baseline holds unfailed, request the rest that is translatable, else skip.

    ``force`` requests everything; with ``retry (keys)`` only those blocks are requested, the baseline's others retained, failed or not.
    """
    b = baseline.select(*keys, F.col("failed").alias("__f"))
    again = retry.select(*keys).distinct().withColumn("__r", F.lit(True)) if retry is not None else None
    rows = blocks.join(b, keys, "left")
    if again is not None:
        rows = rows.join(again, keys, "left")
        action = F.when(~F.col(translatable), "skip").when(F.col("__r"), "request").when(F.col("__f").isNotNull(), "retain").otherwise("skip")
        return rows.withColumn("action", action).drop("__f", "__r")
    keep = ~F.col("__f") & F.lit(not force)
    return rows.withColumn("action", F.when(~F.col(translatable), "skip").when(keep, "retain").otherwise("request")).drop("__f")


def merged(requested: DataFrame, retained: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, markdown, failed)``: what was requested, else what was retained."""
    r, k = (df.select(*keys, F.col("markdown").alias(m), F.col("failed").alias(f)) for df, m, f in ((requested, "__m", "__f"), (retained, "__n", "__g")))
    both = r.join(k, keys, "full")
    return both.select(*keys, F.when(F.col("__m").isNotNull(), F.col("__m")).otherwise(F.col("__n")).alias("markdown"), F.when(F.col("__m").isNotNull(), F.col("__f")).otherwise(F.col("__g")).alias("failed"))


def blocks_of(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n, block_id, type, begin, end, markdown, request_markdown, parts, translatable)`` of the top-level blocks.

    Code, images, tags, links, math and numeric citations are placeholders in what is requested. From a heading of references on nothing is
    translatable until the next heading of level 1 that is none.
    """
    rows = M.blocks(docs, doc, text)
    w = Window.partitionBy(doc).orderBy("n")
    refers = (F.col("type") == "heading") & F.regexp_replace("markdown", r"\n[ \t]*(?:=+|-+)[ \t]*\z", "").rlike(M.REFERENCE_HEADING)
    opens = F.when(refers, F.lit(True)).when((F.col("type") == "heading") & F.col("markdown").rlike(r"\A {0,3}#[ \t]"), F.lit(False))
    inside = F.coalesce(F.last(opens, True).over(w), F.lit(False))
    rows = rows.withColumn("__in", inside).withColumn("p", M.protect(F.col("markdown")))
    may = is_translatable_text(F.col("type"), F.col("p.text")) & ~F.col("__in")
    return rows.select(doc, "n", F.concat_ws("-", F.lit("block"), "n", "begin", "end", "type").alias("block_id"), "type", "begin", "end", "markdown", F.col("p.text").alias("request_markdown"), F.col("p.parts").alias("parts"), may.alias("translatable"))


def editable_blocks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n, block_id, type, begin, end, markdown)`` of paragraphs, tables and headings that hold no math."""
    rows = blocks_of(docs, doc, text)
    math = F.col("markdown").rlike(r"\$|\\\\\(|\\\\\[")
    atx = (F.col("type") != "heading") | F.col("markdown").rlike(r"\A {0,3}#")
    return rows.where(F.col("type").isin("paragraph", "table", "heading") & atx & ~math).select(doc, "n", "block_id", "type", "begin", "end", "markdown")


def check_block(request: Column, answer: Column) -> Column:
    """'ok', or why a translated block can't be used: placeholders not the same in the same order, a tag or image of its own, or not one block of the same kind."""
    marks = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(⟦+[0-9]+⟧)"), 1)
    kind = lambda c: F.when(c.rlike(r"\A {0,3}#{1,6}[ \t]"), F.concat(F.lit("h"), F.length(F.regexp_extract(c, r"\A {0,3}(#{1,6})", 1)))).when(c.rlike(r"\A {0,3}>"), "quote").when(c.rlike(r"\A {0,3}(?:[-+*]|[0-9]{1,9}[.)])[ \t]"), "list").when(c.rlike(r"\A[^\n]*\|[^\n]*\n\s*\|?\s*:?-{3,}"), "table").otherwise("paragraph")
    split = (kind(answer) != "list") & F.trim(answer).rlike(r"\n[ \t]*\n")
    return (
        F.when(F.coalesce(F.trim(answer), F.lit("")) == "", "empty").when(marks(request) != marks(answer), "placeholders")
        .when(answer.rlike(r"</?[A-Za-z][^>]*>|!\[[^\]]*\]\("), "markup").when(split | (kind(request) != kind(answer)), "structure").otherwise("ok")
    )


def text_parts(c: Column) -> Column:
    """A protected text as ``array<struct<kind, text>>``: texts to translate, and placeholders as they are."""
    pieces = F.filter(F.split(F.regexp_replace(c, "(⟦+[0-9]+⟧)", "\u0000$1\u0000"), "\u0000"), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(F.when(x.rlike("\\A⟦+[0-9]+⟧\\z"), "mark").when(x.rlike(r"[\p{L}\p{N}]"), "text").otherwise("space").alias("kind"), x.alias("text")))


def translate(blocks: DataFrame, translator: Callable[[list[str]], list[str]], keys: list[str], rounds: int = 2) -> DataFrame:
    """``(keys, markdown, failed, rounds)``: blocks after the ladder of attempts, by an injected translator.

    ``blocks`` is ``(keys, request_markdown, parts)``. What fails ``check_block`` is asked for again, ``rounds`` times, then
    in its parts of text between placeholders; what still fails keeps its source text and is marked. Each round goes over
    what is left only, and its results are written.
    """
    said = F.pandas_udf(lambda s: pd.Series(translator(list(s)), dtype=object), T.StringType())
    left = blocks.select(*keys, "request_markdown", "parts")
    done = None
    for n in range(1, rounds + 1):
        tried = materialize(left.withColumn("answer", said("request_markdown")).withColumn("status", check_block(F.col("request_markdown"), F.col("answer"))), f"translated-{n}")
        good = tried.where("status = 'ok'").withColumn("rounds", F.lit(n))
        done = good if done is None else done.unionByName(good)
        left = tried.where("status <> 'ok'").select(*keys, "request_markdown", "parts")
    pieces = left.select(*keys, "request_markdown", "parts", F.posexplode(text_parts(F.col("request_markdown"))).alias("at", "x"))
    told = pieces.withColumn("t", F.when(F.col("x.kind") == "text", said("x.text")).otherwise(F.col("x.text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "")
    last = told.groupBy(*keys, "request_markdown", "parts").agg(joined.alias("answer")).withColumn("status", check_block(F.col("request_markdown"), F.col("answer"))).withColumn("rounds", F.lit(rounds + 1))
    every = done.unionByName(last)
    failed = F.col("status") != "ok"
    return every.select(*keys, M.restore(F.when(failed, F.col("request_markdown")).otherwise(F.col("answer")), F.col("parts")).alias("markdown"), failed.alias("failed"), "rounds")


def complete(blocks: DataFrame, translated: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``(doc, valid)``: ids of translations not empty and each once, and every translatable block there."""
    ids = translated.groupBy(doc, "block_id").agg(F.count("*").alias("n"))
    both = blocks.select(doc, "block_id", "translatable").join(ids, [doc, "block_id"], "full")
    bad = (F.coalesce("block_id", F.lit("")) == "") | (F.coalesce("n", F.lit(0)) > 1) | (F.coalesce("translatable", F.lit(False)) & F.col("n").isNull())
    return both.groupBy(doc).agg((~F.bool_or(bad)).alias("valid"))


def comparison_view(blocks: DataFrame, doc: str, order: str, text: str, translated: str) -> DataFrame:
    """``(doc, order, begin, end, other_begin, other_end)``: where source and translation of each block stand in the view of both."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    extra = F.coalesce(F.length(translated) + 2, F.lit(0))
    end = F.sum(F.length(text) + 2 + extra).over(w)
    begin = end - F.length(text) - 2 - extra
    rows = blocks.withColumn("begin", begin).withColumn("end", F.col("begin") + F.length(text))
    return rows.select(doc, order, "begin", "end", F.when(F.col(translated).isNotNull(), F.col("end") + 2).alias("other_begin"), F.when(F.col(translated).isNotNull(), F.col("end") + 2 + F.length(translated)).alias("other_end"))


def to_comparison(positions: DataFrame, ranges: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``positions (doc, at)`` of the source with ``mapped``, in the view of both; ``ranges (doc, source_begin, source_end, begin)``. Null between blocks."""
    r = ranges.select(F.col(doc).alias("__d"), "source_begin", "source_end", F.col("begin").alias("__b"))
    hit = positions.join(r, (F.col(doc) == F.col("__d")) & (F.col("source_begin") <= F.col("at")) & (F.col("at") <= F.col("source_end")), "left")
    return hit.groupBy(doc, "at").agg(F.min(F.col("__b") + F.col("at") - F.col("source_begin")).alias("mapped"))


def language_states(descriptors: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``(doc, complete, partial)``: languages by their newest translation, sorted."""
    newest = descriptors.groupBy(doc, "language").agg(F.max_by("failed", "at").alias("failed"))
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("language"))))
    return newest.groupBy(doc).agg(pick(~F.col("failed")).alias("complete"), pick(F.col("failed")).alias("partial"))


def validate(responses: DataFrame, blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``(doc, id, status, markdown)``: ok, duplicate, unknown, empty or missing, for each requested or answered block.

    ``responses`` is ``(doc, raw)``; raw is a JSON array of {id, translatedMarkdown}, maybe in a json fence.
    """
    body = F.regexp_replace(F.trim("raw"), r"(?s)\A```(?:json)?\s*|\s*```\z", "")
    answered = responses.select(doc, F.explode(F.from_json(body, "array<struct<id:string,translatedMarkdown:string>>")).alias("r")).groupBy(doc, F.col("r.id").alias("id")).agg(F.count("*").alias("n"), F.min("r.translatedMarkdown").alias("markdown"))
    both = blocks.select(doc, F.col("block_id").alias("id"), F.lit(True).alias("asked")).join(answered, [doc, "id"], "full")
    status = F.when(F.col("asked").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.coalesce(F.trim("markdown"), F.lit("")) == "", "empty").otherwise("ok")
    return both.select(doc, "id", status.alias("status"), F.when(status == "ok", F.col("markdown")).alias("markdown"))


def materialize_view(blocks: DataFrame, changes: DataFrame, doc: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """``(doc, order, begin, end, markdown)``: blocks with replacements, and where they stand in the joined document."""
    r = changes.select(doc, order, F.col("replacement").alias("__r"))
    m = blocks.join(r, [doc, order], "left").withColumn("markdown", F.coalesce("__r", text))
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("markdown") + len(separator)).over(w) - len(separator)
    return m.withColumn("end", end).withColumn("begin", F.col("end") - F.length("markdown")).select(doc, order, "begin", "end", "markdown")


def usage(df: DataFrame, keys: list[str], *counts: str) -> DataFrame:
    """Sums that are null where all parts are."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
