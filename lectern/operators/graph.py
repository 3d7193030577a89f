"""Citation graph: provider merge, edges, degrees, warnings, scope, status, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lectern.functions import identifiers as I
from lectern.functions.text import title_key, word_runs
from lectern.operators.relational import ambiguous_keys, first_nonempty, unique_join
from lectern.session import materialize, small_or_shuffled


def normal_papers(papers: DataFrame) -> DataFrame:
    return papers.withColumn("doi", I.doi(F.col("doi"))).withColumn("arxiv_id", I.arxiv(F.col("arxiv_id")))


def edges(papers: DataFrame, references: DataFrame) -> DataFrame:
    """``(source, target, sources)``: references resolved by DOI, else arXiv id, to the only paper that has it.

    ``references`` is ``(source, doi, arxiv_id, provider)``. Self loops go; repeated edges become one
    with the sorted union of their providers. References are first made distinct by
    identifier, so that the identifier strings are normalised and joined once each.
    """
    p = normal_papers(papers)
    ids = references.select("doi", "arxiv_id").distinct()
    ids = ids.withColumn("__d", I.doi(F.col("doi"))).withColumn("__a", I.arxiv(F.col("arxiv_id")))
    ids = unique_join(unique_join(ids, p, "__d", "doi", "node", "__by_doi"), p, "__a", "arxiv_id", "node", "__by_arxiv")
    ids = ids.select(F.col("doi").alias("__rd"), F.col("arxiv_id").alias("__ra"), F.coalesce("__by_doi", "__by_arxiv").alias("target")).where("target is not null")
    hit = references.join(ids, references["doi"].eqNullSafe(ids["__rd"]) & references["arxiv_id"].eqNullSafe(ids["__ra"]))
    hit = hit.where(F.col("source") != F.col("target"))
    return hit.groupBy("source", "target").agg(I.sources(F.collect_set("provider")).alias("sources"))


def nodes(papers: DataFrame, graph: DataFrame) -> DataFrame:
    """Papers with in, out and total degree over distinct edges, zero included."""
    ends = graph.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(graph.select("target", F.lit(0), F.lit(1)))
    d = ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return papers.join(d, "node", "left").select(*papers.columns, zero("in_degree").alias("in_degree"), zero("out_degree").alias("out_degree"), (zero("in_degree") + zero("out_degree")).alias("degree"))


def warnings(papers: DataFrame) -> DataFrame:
    """``(code, identifier, n)``: identifiers that several papers share, and papers without any."""
    p = normal_papers(papers)
    shared = [ambiguous_keys(p, c).select(F.lit("ambiguous-identifier").alias("code"), F.col(c).alias("identifier"), "n") for c in ("doi", "arxiv_id")]
    none = p.where("doi = '' and arxiv_id = ''").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("missing-identifiers").alias("code"), F.lit("").alias("identifier"), "n")
    return shared[0].unionByName(shared[1]).unionByName(none)


def scope(papers: DataFrame, graph: DataFrame, focus) -> DataFrame:
    """Nodes of the focus and its targets, with degrees over the focus's outgoing edges."""
    own = graph.where(F.col("source") == F.lit(focus))
    keep = own.select(F.col("target").alias("node")).union(papers.where(F.col("node") == F.lit(focus)).select("node")).distinct()
    return nodes(papers.join(keep, "node", "left_semi"), own)


def neighbours(graph: DataFrame) -> DataFrame:
    """``(node, n_references, n_cited_by)`` of nodes with an edge."""
    ends = graph.select(F.col("source").alias("node"), F.lit(1).alias("r"), F.lit(0).alias("c")).union(graph.select("target", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("r").alias("n_references"), F.sum("c").alias("n_cited_by"))


def merge_providers(records: DataFrame, max_references: int = 1000) -> DataFrame:
    """One row per ``(node, key)`` over providers, in the order of ``rank`` and, within a record, of ``ordinal``.

    ``records`` is ``(node, rank, provider, doi, arxiv_id, title, year)`` and may have ``ordinal``, ``paper_id`` and ``authors`` of
    a reference, and ``truncated`` and ``fetched_at`` of its record. The key is the DOI, else the arXiv id; references with
    neither go. Each field is the first to arrive that is not empty; sources are the sorted union. Keys that first appear
    after ``max_references`` others of a node go and mark the node truncated, as does a record that was truncated.
    """
    have = set(records.columns)
    r = records.withColumn("doi", I.doi(F.col("doi"))).withColumn("arxiv_id", I.arxiv(F.col("arxiv_id")))
    key = F.when(F.col("doi") != "", F.concat(F.lit("doi:"), "doi")).when(F.col("arxiv_id") != "", F.concat(F.lit("arxiv:"), "arxiv_id"))
    order = F.struct("rank", *(["ordinal"] if "ordinal" in have else ["title", "year"]))
    more = [first_nonempty(F.substring("title", 1, 512), order).alias("title"), first_nonempty(F.col("year"), order).alias("year")]
    if "paper_id" in have:
        more.append(first_nonempty(F.col("paper_id"), order).alias("paper_id"))
    if "authors" in have:
        more.append(F.slice(F.min_by(F.when(F.size("authors") > 0, F.col("authors")), F.when(F.size("authors") > 0, order)), 1, 100).alias("authors"))
    keyed = r.withColumn("key", key).where("key is not null")
    merged = keyed.groupBy("node", "key").agg(F.min(order).alias("__first"), *more, I.sources(F.collect_set("provider")).alias("sources"))
    w = Window.partitionBy("node")
    numbered = merged.withColumn("__n", F.row_number().over(w.orderBy("__first", "key"))).withColumn("truncated", F.count("*").over(w) > max_references)
    kept = numbered.where(F.col("__n") <= max_references).drop("__n", "__first")
    facts = [f for f in ("truncated", "fetched_at") if f in have]
    if facts:
        whole = records.groupBy("node").agg(*([F.bool_or("truncated").alias("__t")] if "truncated" in have else []), *([F.max("fetched_at").alias("fetched_at")] if "fetched_at" in have else []))
        kept = kept.join(whole, "node")
        if "truncated" in have:
            kept = kept.withColumn("truncated", F.col("truncated") | F.coalesce("__t", F.lit(False))).drop("__t")
    return kept


def tag_provider(records: DataFrame, provider: str) -> DataFrame:
    """A provider's records with their provenance; what was not fetched has no paper id and no references."""
    fetched = F.col("status") == "fetched"
    tagged = F.transform("references", lambda x: x.withField("sources", F.array(F.lit(provider))))
    return records.select(*[c for c in records.columns if c not in ("paper_id", "references", "provider")], F.lit(provider).alias("provider"), F.when(fetched, F.col("paper_id")).otherwise("").alias("paper_id"), F.when(fetched, tagged).otherwise(F.slice(tagged, 1, 0)).alias("references"))


def with_records(nodes_: DataFrame, records: DataFrame) -> DataFrame:
    """Nodes with the paper id and status of their record, if any."""
    return nodes_.join(records.select("node", "paper_id", "status"), "node", "left")


def unresolved(nodes_: DataFrame) -> DataFrame:
    """``(code, identifier, n)``: papers that their provider doesn't know."""
    return nodes_.where("status = 'unindexed'").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("unresolved-papers").alias("code"), F.lit("").alias("identifier"), "n")


def warning_count(found: DataFrame) -> DataFrame:
    """``(code, n)``: what the warnings of a code count, one without a count as 1."""
    return found.groupBy("code").agg(F.sum(F.coalesce(F.nullif("n", F.lit(0)), F.lit(1))).cast("bigint").alias("n"))


def scope_warnings(found: DataFrame, scoped: DataFrame, focus) -> DataFrame:
    """Warnings of a focus: those without a node or about it stay, counted ones are counted over the scoped nodes.

    ``found`` is ``(code, node, n)``; ``scoped`` has ``doi``, ``arxiv_id`` and ``paper_id``.
    """
    own = found.where(~F.col("code").isin("missing-identifiers", "unresolved-papers") & (F.col("node").isNull() | (F.col("node") == F.lit(focus))))
    count = lambda code, rule: scoped.where(rule).agg(F.count("*").alias("n")).where("n > 0").select(F.lit(code).alias("code"), F.lit(None).cast("string").alias("node"), "n")
    before = found.where("code = 'unresolved-papers'").limit(1).select(F.lit(1).alias("__one"))
    lost = count("unresolved-papers", "coalesce(paper_id, '') = ''").join(F.broadcast(before), how="left_semi", on=F.lit(True))
    return own.select("code", "node", "n").unionByName(count("missing-identifiers", "doi = '' and arxiv_id = ''")).unionByName(lost)


def visible(nodes_: DataFrame, connected: bool) -> DataFrame:
    return nodes_.where("degree > 0") if connected else nodes_


def search(papers: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Papers whose title, DOI or arXiv id holds the text in any case, by title and node, ``limit`` at most."""
    q = F.lit(text.strip().lower())
    hit = F.contains(F.lower("title"), q) | F.contains("doi", q) | F.contains("arxiv_id", q)
    return normal_papers(papers).where(hit).orderBy("title", "node").limit(limit)


def snapshot(nodes_: DataFrame, graph: DataFrame, found: DataFrame) -> DataFrame:
    """One row: numbers of nodes, connected nodes, edges and warnings."""
    n = nodes_.agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") > 0).alias("connected"))
    e = graph.agg(F.count("*").alias("edges"))
    w = warning_count(found).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("warnings"))
    return n.join(e, how="full", on=F.lit(True)).join(w, how="full", on=F.lit(True))  # one row each


def refresh_plan(papers: DataFrame, records: DataFrame, now, force: bool = False, positive_seconds: int = 30 * 86400, negative_seconds: int = 7 * 86400) -> DataFrame:
    """``(node, provider, action)``: read a fresh record, or fetch one that is missing, stale or forced.

    ``papers`` is ``(node, provider)``: whom to ask; ``records`` is ``(node, provider, status, fetched_at)``.
    """
    age = F.unix_seconds(now) - F.unix_seconds(F.col("fetched_at").cast("timestamp"))
    fresh = F.coalesce(age <= F.when(F.col("status") == "fetched", positive_seconds).otherwise(negative_seconds), F.lit(False)) & F.lit(not force)
    found = papers.join(records, ["node", "provider"], "left")
    return found.select("node", "provider", F.when(fresh, "cached").otherwise("fetch").alias("action"))


def partial_records(fetched: DataFrame, deadline) -> DataFrame:
    """What a refresh publishes at its deadline: the providers that settled by then, the others as pending."""
    return fetched.withColumn("state", F.when(F.col("settled_at") <= deadline, F.col("status")).otherwise("pending"))


def reference_status(lookups: DataFrame, items: DataFrame, kinds: tuple[str, ...] = ("doi", "arxiv_id", "pmid", "openalex_id")) -> DataFrame:
    """``(lookup_id, status, can_import)`` of references against a library.

    All items that the first kind of identifier with any hit leads to count. More than one
    in the target library, or none there and more than one elsewhere, is ambiguous. Items are counted by identifier and library
    before lookups meet them, so that an identifier that many items share costs a lookup no more than another.
    """
    named = F.filter(F.array(*[F.struct(F.lit(i).alias("p"), F.col(c).alias("v")) for i, c in enumerate(kinds)]), lambda x: x["v"] != "")
    held = items.select("library_id", "has_pdf", F.explode(named).alias("x"))
    held = materialize(held.groupBy("x", "library_id").agg(F.count("*").alias("n"), F.coalesce(F.bool_or("has_pdf"), F.lit(False)).alias("has_pdf")), "held")
    held = small_or_shuffled(held, 128)
    every = small_or_shuffled(materialize(held.groupBy("x").agg(F.coalesce(F.sum(F.when(F.col("library_id").isNotNull(), F.col("n"))), F.lit(0)).alias("every")), "every"), 96)
    asked = lookups.select("lookup_id", F.col("target_library_id").alias("library_id"), (F.size(named) > 0).alias("reliable"), F.explode_outer(named).alias("x"))
    own = F.coalesce("n", F.lit(0))
    other = F.when(F.col("library_id").isNotNull(), F.col("every") - own).otherwise(0)
    found = asked.join(every, "x", "left").join(held, ["x", "library_id"], "left").select("lookup_id", "reliable", F.when(F.col("every").isNotNull(), F.col("x.p")).alias("p"), F.struct(own.alias("own"), other.alias("other"), F.coalesce("has_pdf", F.lit(False)).alias("pdf")).alias("f"))
    best = found.groupBy("lookup_id").agg(F.max("reliable").alias("reliable"), F.min_by("f", "p").alias("f"))
    n = best.select("lookup_id", "reliable", *[F.coalesce(F.col(f"f.{c}"), F.lit(0)).alias(c) for c in ("own", "other")], F.coalesce("f.pdf", F.lit(False)).alias("pdf"))
    ambiguous = (F.col("own") > 1) | ((F.col("own") == 0) & (F.col("other") > 1))
    status = F.when(ambiguous, "ambiguous").when((F.col("own") == 1) & F.col("pdf"), "present").when(F.col("own") == 1, "present-no-pdf").when(F.col("other") == 1, "present-other-library").when(F.col("reliable"), "absent").otherwise("unknown")
    return n.select("lookup_id", status.alias("status"), (F.col("reliable") & ~ambiguous).alias("can_import"))


def title_candidates(texts: DataFrame, titles: DataFrame, min_length: int = 8, words: int = 3, limit: int | None = None) -> DataFrame:
    """``(ref_id, item_id)``: titles whose key stands in the text's key as whole words.

    Pairs meet by the first ``words`` words of the title's key (shorter titles by all); only the ids of texts take part in
    that join, and texts come back for the pairs found. If both tables have ``year`` (0 or null: unknown), years that
    are known must agree; if both have ``authors`` (arrays), sets that are not empty must share a name. With ``limit``
    only the first items of a text, by id, are kept.
    """
    t = titles.withColumn("tk", title_key(F.col("title"))).where(F.length("tk") >= min_length)
    t = t.withColumn("g", F.array_join(F.slice(F.split("tk", " "), 1, words), " ")).withColumn("k", F.least(F.size(F.split("tk", " ")), F.lit(words)))
    keyed = texts.withColumn("rk", F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")))
    listed = keyed.select("ref_id", F.split("rk", " ").alias("ws"))
    asked = listed.select("ref_id", F.explode(F.array_distinct(F.flatten(F.array(*[word_runs("ws", n) for n in range(1, words + 1)])))).alias("g"))
    t = materialize(t, "titles")
    firsts = small_or_shuffled(t.select("g").distinct(), 96)  # most runs of words begin no title and go before any shuffle
    pairs = asked.join(firsts, "g", "left_semi").join(t.select("g", "item_id"), "g").select("ref_id", "item_id").distinct()
    rule = F.contains(F.concat(F.lit(" "), "rk", F.lit(" ")), F.concat(F.lit(" "), "tk", F.lit(" ")))
    right = ["item_id", "tk"]
    if "year" in texts.columns and "year" in titles.columns:
        t, right = t.withColumn("__y", F.coalesce(F.nullif("year", F.lit(0)), F.lit(None))), [*right, "__y"]
        mine = F.nullif(F.col("year"), F.lit(0))
        rule &= mine.isNull() | F.col("__y").isNull() | (mine == F.col("__y"))
    if "authors" in texts.columns and "authors" in titles.columns:
        t, right = t.withColumn("__a", F.coalesce("authors", F.array().cast("array<string>"))), [*right, "__a"]
        own = F.coalesce(F.col("authors"), F.array().cast("array<string>"))
        rule &= (F.size(own) == 0) | (F.size("__a") == 0) | F.arrays_overlap(own, "__a")
    asked_for = small_or_shuffled(materialize(pairs.join(t.select(*right), "item_id"), "pairs"), 1200)  # texts stay where they are if the pairs are few
    hit = keyed.join(asked_for, "ref_id").where(rule).select("ref_id", "item_id").distinct()
    if limit is None:
        return hit
    return hit.withColumn("__n", F.row_number().over(Window.partitionBy("ref_id").orderBy("item_id"))).where(F.col("__n") <= limit).drop("__n")
