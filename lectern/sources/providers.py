"""Records of citation providers, as landed JSON lines, and the library's own tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lectern.functions import identifiers as I, records as R
from lectern.functions.text import squash, title_key, word_runs
from lectern.operators.relational import fold_rows, unique_keys

#: References of a paper that count; those beyond mark it truncated.
MAX_REFERENCES = 1000
NOT_PAPERS = ("attachment", "note", "annotation")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed answers of a provider: one JSON object a line; rows that are no object have null fields."""
    return spark.read.schema(schema).json(path)


def first_found(asked: DataFrame, by_doi: DataFrame, by_arxiv: DataFrame) -> DataFrame:
    """Answers to ``asked (node, doi, arxiv_id)``: by DOI, and by arXiv id where that found nothing."""
    d = by_doi.select(F.col("doi").alias("__d"), F.col("answer").alias("__by_doi"))
    a = by_arxiv.select(F.col("arxiv_id").alias("__a"), F.col("answer").alias("__by_arxiv"))
    hit = asked.join(d, (F.col("doi") == F.col("__d")) & (F.col("doi") != ""), "left").join(a, (F.col("arxiv_id") == F.col("__a")) & (F.col("arxiv_id") != ""), "left")
    return hit.select(*asked.columns, F.coalesce("__by_doi", "__by_arxiv").alias("answer"))


def paper_references(answers: DataFrame, most: int = MAX_REFERENCES) -> DataFrame:
    """``(node, ordinal, paper_id, title, year, doi, arxiv_id, authors, truncated)`` of answers ``(node, data array<string>, next)``.

    ``data`` has a JSON record for each reference, in order; ``next`` is set where there are more.
    """
    cut = answers.withColumn("truncated", F.col("next").isNotNull() | (F.size("data") > most))
    parsed = F.transform(F.slice("data", 1, most), R.provider_record)  # before they are rows: each field of a column would parse again
    rows = cut.select("node", "truncated", F.posexplode(parsed).alias("ordinal", "r")).withColumn("x", R.paper_of_record(F.col("r")))
    return rows.where("x is not null").select("node", "ordinal", "x.*", "truncated")


def resolve_batches(asked: DataFrame, answers: DataFrame, size: int = 500) -> DataFrame:
    """Papers ``(node, ordinal)`` with what their batch's answer has at their place.

    ``answers`` is ``(batch, papers array<string>)``: position by position what was asked for.
    """
    placed = asked.withColumn("batch", F.floor(F.col("ordinal") / size)).withColumn("at", F.col("ordinal") % size)
    rows = answers.select("batch", F.posexplode("papers").alias("at", "raw"))
    return placed.join(rows, ["batch", "at"], "left").select(*asked.columns, R.provider_paper(F.col("raw")).alias("paper"))


def cited_dois(answers: DataFrame, most: int = MAX_REFERENCES) -> DataFrame:
    """``(node, ordinal, doi)``: distinct DOIs of the first rows of answers ``(node, cited array<string>)``, where they first appear.

    A row names a paper by several identifiers, as in ``omid:br/1 doi:10.1/x``.
    """
    rows = answers.select("node", F.posexplode(F.slice("cited", 1, most)).alias("row", "c"))
    found = rows.select("node", "row", F.posexplode(F.regexp_extract_all("c", F.lit(r"(?i)\bdoi:(10\.\S+)"), 1)).alias("at", "d")).withColumn("doi", I.doi(F.col("d"))).where("doi <> ''")
    first = found.groupBy("node", "doi").agg(F.min(F.struct("row", "at")).alias("p"))
    return first.select("node", (F.row_number().over(Window.partitionBy("node").orderBy("p")) - 1).alias("ordinal"), "doi")


def works_of_dois(papers: DataFrame, works: DataFrame) -> DataFrame:
    """``(doi, openalex_id)``: distinct DOIs of papers with the only work that has them.

    ``works`` is ``(doi, openalex_id)``; those that nobody asked for, and DOIs of several works, go.
    """
    asked = papers.select(I.doi(F.col("doi")).alias("doi")).where("doi <> ''").distinct()
    w = works.select(I.doi(F.col("doi")).alias("doi"), I.openalex(F.col("openalex_id")).alias("openalex_id")).where("doi <> '' and openalex_id <> ''").distinct()
    return asked.join(unique_keys(w, "doi", "openalex_id"), "doi").select("doi", "openalex_id")


def work_references(works: DataFrame, ids: DataFrame, most: int = MAX_REFERENCES) -> DataFrame:
    """``(node, ordinal, doi)``: referenced works ``(node, referenced array<string>)`` that lead to one local DOI, each DOI once."""
    local = unique_keys(ids.select("openalex_id", "doi").distinct(), "openalex_id", "doi")
    rows = works.select("node", F.posexplode("referenced").alias("ordinal", "r")).withColumn("openalex_id", I.openalex(F.col("r"))).join(local, "openalex_id")
    first = rows.groupBy("node", "doi").agg(F.min("ordinal").alias("ordinal"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("ordinal"))).where(F.col("n") <= most).drop("n")


def search_papers(queries: DataFrame, papers: DataFrame, limit: int = 10) -> DataFrame:
    """``(query_id, node, step)``: papers whose title key holds the query's; else those of its likely title; ``limit`` for each query.

    ``queries`` is ``(query_id, text, year)``; a year, if given, must be the paper's. Queries and titles meet by the query's first
    three words, so that nothing is crossed.
    """
    both = queries.select("query_id", "year", F.array(F.struct(F.lit(0).alias("step"), title_key("text").alias("q")), F.struct(F.lit(1).alias("step"), title_key(R.title_query(F.col("text"))).alias("q"))).alias("qs"))
    asked = both.select("query_id", F.col("year").alias("qy"), F.inline("qs")).where("q <> ''").withColumn("g", F.array_join(F.slice(F.split("q", " "), 1, 3), " "))
    held = papers.select("node", F.col("year").alias("py"), title_key(F.col("title")).alias("tk")).withColumn("ws", F.split("tk", " "))
    held = held.select("node", "py", "tk", F.explode(F.array_distinct(F.flatten(F.array(*[word_runs("ws", n) for n in (1, 2, 3)])))).alias("g"))
    hit = asked.join(held, "g").where(F.contains(F.concat(F.lit(" "), "tk", F.lit(" ")), F.concat(F.lit(" "), "q", F.lit(" "))) & (F.col("qy").isNull() | (F.col("qy") == F.col("py"))))
    hit = hit.select("query_id", "node", "step").distinct()
    best = hit.withColumn("least", F.min("step").over(Window.partitionBy("query_id"))).where("step = least")
    return best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("node"))).where(F.col("n") <= limit).select("query_id", "node", "step")


def open_access(refs: DataFrame, first: str = "s2_url", second: str = "oa_url") -> DataFrame:
    """``refs`` with ``pdf_url`` and ``pdf_source``: the archive's own address, then two providers' answers, then the reference's link; public links only."""
    arxiv = I.arxiv(F.col("arxiv_id"))
    ways = [("arxiv", F.when(arxiv != "", F.concat(F.lit("https://arxiv.org/pdf/"), arxiv))), (first.removesuffix("_url"), F.col(first)), (second.removesuffix("_url"), F.col(second)), ("reference", F.col("pdf_url"))]
    held = refs.withColumns({f"__{n}": F.coalesce(c, F.lit("")) for n, c in ways})
    first_of = F.coalesce(*[F.when(I.is_public_url(F.col(f"__{n}")), F.struct(F.lit(n).alias("n"), F.regexp_replace(f"__{n}", r"#.*\z", "").alias("u"))) for n, _ in ways])  # the later ways only where the first have none
    found = held.withColumn("__x", F.explode(F.array(first_of)))  # computed once for both columns
    return found.withColumn("pdf_source", F.col("__x.n")).withColumn("pdf_url", F.coalesce("__x.u", F.lit(""))).drop("__x", *[f"__{n}" for n, _ in ways])


# The library


def list_papers(items: DataFrame, library) -> DataFrame:
    """Regular items of a library that are not deleted, by key."""
    keep = (F.col("library_id") == F.lit(library)) & ~F.col("deleted") & ~F.col("item_type").isin(*NOT_PAPERS)
    title = F.coalesce(F.nullif(squash("title"), F.lit("")), F.lit("Untitled"))
    return items.where(keep).select(R.paper_node(F.col("library_id"), F.col("key")).alias("node"), "item_id", "key", title.alias("title"), R.item_year(F.col("year"), F.col("date")).alias("year"), R.labelled_identifiers(F.col("doi"), F.col("extra")).alias("x")).select("node", "item_id", "key", "title", "year", "x.*").orderBy("key")


def library_index(items: DataFrame) -> DataFrame:
    """``(kind, value, item_id, library_id)``: an item's identifiers and title key, each a row."""
    ids = R.item_identifiers(F.col("doi"), F.col("pmid"), F.col("extra"))
    rows = items.select("item_id", "library_id", ids.alias("x"), title_key(F.col("title")).alias("tk"))
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"x.{k}").alias("value")) for k in ("doi", "arxiv_id", "pmid", "openalex_id")], F.struct(F.lit("title").alias("kind"), F.col("tk").alias("value")))
    return rows.select(F.inline(pairs), "item_id", "library_id").where("value <> ''").select("kind", "value", "item_id", "library_id")


def project_item(items: DataFrame) -> DataFrame:
    """Items with year, searchable authors (lower case, 100 at most) and whether a PDF is attached."""
    names = F.filter(F.transform(F.slice("creators", 1, 100), lambda c: F.lower(F.trim(F.coalesce(c["last"], c["name"], F.lit(""))))), lambda v: v != "")
    return items.select("item_id", "library_id", "title", R.item_year(F.col("year"), F.col("date")).alias("year"), F.array_join(names, " ").alias("author_search_text"), R.has_pdf(F.col("attachments")).alias("has_pdf"))


def first_pdf(attachments: DataFrame, most: int = 1000) -> DataFrame:
    """``(item_id, attachment_id)``: the first PDF among an item's first attachments."""
    w = Window.partitionBy("item_id").orderBy("ordinal")
    some = attachments.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    pdf = (F.lower("mime") == "application/pdf") | F.col("path").rlike(r"(?i)\.pdf\z")
    return some.where(pdf).groupBy("item_id").agg(F.min_by("attachment_id", "ordinal").alias("attachment_id"))


def top_level(ids: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct items that the ids are, or belong to."""
    hit = ids.select("item_id").join(parents.select(F.col("child").alias("item_id"), "parent"), "item_id", "left")
    return hit.select(F.coalesce("parent", "item_id").alias("item_id")).distinct()


def libraries(found: DataFrame, user_id, user_name: str = "My Library") -> DataFrame:
    """Libraries ``(library_id, name, kind)``, each once, the user's first (added if it is missing), then by name."""
    one = found.groupBy("library_id").agg(F.min_by("name", "ordinal").alias("name"), F.min_by("kind", "ordinal").alias("kind"))
    own = found.sparkSession.createDataFrame([(user_id, user_name, "user")], one.schema).join(one.where("kind = 'user'").limit(1), how="left_anti", on=F.lit(True))
    return one.unionByName(own).orderBy(F.col("kind") != "user", "name")


def distinct_candidates(rows: DataFrame, group: str, order: str, identities: Column) -> DataFrame:
    """Rows of a group in order, without those of which any identity was seen on a row that was kept.

    Whether a row stays depends on what was kept before it, so each group is folded in its order.
    """
    source = rows.withColumn("__ids", F.filter(identities, lambda v: v.isNotNull() & (v != "")))

    def unseen():
        seen: set = set()

        def ask(ids) -> bool:
            new = seen.isdisjoint(ids or ())
            if new:
                seen.update(ids or ())
            return new

        return ask

    return fold_rows(source, [group], [F.col(order).asc_nulls_last()], ["__ids"], unseen).drop("__ids")


def candidates(local: DataFrame, online: DataFrame, limit: int = 20) -> DataFrame:
    """Candidates of a lookup ``(lookup_id, ordinal, doi, arxiv_id, title, year)``: the library's before those found online, each work once."""
    both = local.withColumn("__o", F.lit(0)).unionByName(online.withColumn("__o", F.lit(1)))
    both = both.withColumn("rank", F.row_number().over(Window.partitionBy("lookup_id").orderBy("__o", "ordinal"))).drop("__o")
    names = F.array(F.concat(F.lit("doi:"), F.nullif(I.doi(F.col("doi")), F.lit(""))), F.concat(F.lit("arxiv:"), F.nullif(I.arxiv(F.col("arxiv_id")), F.lit(""))), F.concat(F.lit("title:"), F.nullif(title_key(F.col("title")), F.lit("")), F.lit(":"), F.coalesce(F.col("year"), F.lit(0)).cast("string")))
    kept = distinct_candidates(both, "lookup_id", "rank", names)
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("lookup_id").orderBy("rank"))).where(F.col("n") <= limit).drop("n")


def affected(changes: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct attachments that changed annotations belong to."""
    return changes.join(parents.select(F.col("child").alias("item_id"), "parent"), "item_id").select(F.col("parent").alias("attachment_id")).distinct()
