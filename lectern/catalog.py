"""The registered queries of the document-analytics operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern import fixtures as X
from lectern.functions import identifiers as I, text as S
from lectern.operators import cache, citations, graph, layout, markdown as M, relational as R, render, translation as TR
from lectern.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
NOW = "2024-03-01 00:00:00"


def query(sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query under its name; ``views`` names the fixtures that its SQL needs."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = ("WITH " + ", ".join(X.SQL[v] for v in views.split()) + " " if views else "") + sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Citation graph


@query("SELECT source, target, array_to_string(sources, ',') AS sources FROM edges", "papers refs edges")
def citation_graph_edges(spark, d):
    return graph.edges(X.papers(spark, d), X.references(spark, d)).select("source", "target", F.array_join("sources", ",").alias("sources"))


_NODES = """SELECT p.node, p.title, count(*) FILTER (WHERE e.target = p.node)::BIGINT AS in_degree, count(*) FILTER (WHERE e.source = p.node)::BIGINT AS out_degree, count(e.source)::BIGINT AS degree
FROM {p} p LEFT JOIN (SELECT source, target, source AS n FROM {e} UNION ALL SELECT source, target, target FROM {e}) e ON e.n = p.node GROUP BY p.node, p.title"""


@query(_NODES.format(p="papers", e="edges"), "papers refs edges")
def citation_graph_nodes(spark, d):
    p = X.papers(spark, d)
    return graph.nodes(p.select("node", "title"), graph.edges(p, X.references(spark, d)))


@query("""SELECT 'ambiguous-identifier' AS code, doi AS identifier, count(*)::BIGINT AS n FROM papers WHERE doi <> '' GROUP BY doi HAVING count(*) > 1
UNION ALL SELECT 'ambiguous-identifier', arxiv_id, count(*) FROM papers WHERE arxiv_id <> '' GROUP BY arxiv_id HAVING count(*) > 1
UNION ALL SELECT 'missing-identifiers', '', count(*) FROM papers WHERE doi = '' AND arxiv_id = '' HAVING count(*) > 0""", "papers")
def citation_graph_warnings(spark, d):
    return graph.warnings(X.papers(spark, d))


@query("""SELECT s.node, s.title, (s.node <> 'lib:1')::BIGINT AS in_degree, (CASE WHEN s.node = 'lib:1' THEN (SELECT count(*) FROM edges WHERE source = 'lib:1') ELSE 0 END)::BIGINT AS out_degree,
 (CASE WHEN s.node = 'lib:1' THEN (SELECT count(*) FROM edges WHERE source = 'lib:1') ELSE 1 END)::BIGINT AS degree
FROM papers s WHERE s.node = 'lib:1' OR s.node IN (SELECT target FROM edges WHERE source = 'lib:1')""", "papers refs edges")
def citation_graph_scope(spark, d):
    p = X.papers(spark, d)
    return graph.scope(p.select("node", "title"), graph.edges(p, X.references(spark, d)), "lib:1")


@query("""SELECT node, sum(r)::BIGINT AS n_references, sum(c)::BIGINT AS n_cited_by FROM (SELECT source AS node, 1 AS r, 0 AS c FROM edges UNION ALL SELECT target, 0, 1 FROM edges) GROUP BY node""", "papers refs edges")
def graph_neighbours(spark, d):
    return graph.neighbours(graph.edges(X.papers(spark, d), X.references(spark, d)))


@query("SELECT node, title FROM papers WHERE contains(lower(title), 'blue') OR contains(doi, '10.1000/p77') OR contains(arxiv_id, '2101.0003')", "papers")
def graph_search(spark, d):
    p = graph.normal_papers(X.papers(spark, d))
    return p.where(F.lower("title").contains("blue") | F.col("doi").contains("10.1000/p77") | F.col("arxiv_id").contains("2101.0003")).select("node", "title")


@query("""SELECT 'n' || l_orderkey AS node, 'doi:10.1000/p' || l_partkey AS key,
 coalesce((list(CASE WHEN l_linenumber % 2 = 0 THEN 't' || l_linenumber END ORDER BY l_returnflag, l_linenumber) FILTER (WHERE l_linenumber % 2 = 0))[1], NULL) AS title,
 array_to_string(list_sort(list(DISTINCT 'prov-' || lower(l_returnflag))), ',') AS sources, false AS truncated FROM lineitem GROUP BY l_orderkey, l_partkey""")
def provider_merge(spark, d):
    r = table(spark, d, "lineitem").select(F.concat(F.lit("n"), "l_orderkey").alias("node"), F.col("l_returnflag").alias("rank"), F.concat(F.lit("PROV-"), "l_returnflag").alias("provider"), F.concat(F.lit("doi:10.1000/P"), "l_partkey").alias("doi"), F.lit("").alias("arxiv_id"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("t"), "l_linenumber")).otherwise("").alias("title"), F.lit(0).alias("year"))
    return graph.merge_providers(r).select("node", "key", "title", F.array_join("sources", ",").alias("sources"), "truncated")


_ITEMS = """items AS (SELECT c_custkey AS item_id, c_nationkey % 3 AS library_id, '10.9/c' || (c_custkey % 1000) AS doi, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 800)::VARCHAR ELSE '' END AS pmid, c_acctbal > 0 AS has_pdf FROM customer),
lookups AS (SELECT o_orderkey AS lookup_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '10.9/c' || (o_custkey * 2 % 1700) END AS doi, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE (o_custkey % 900)::VARCHAR END AS pmid, (o_custkey % 3)::INT AS target FROM orders),
hits AS (SELECT lookup_id, item_id, 0 AS p FROM lookups l JOIN items i ON l.doi = i.doi AND l.doi <> '' UNION ALL SELECT lookup_id, item_id, 1 FROM lookups l JOIN items i ON l.pmid = i.pmid AND l.pmid <> ''),
best AS (SELECT h.lookup_id, h.item_id FROM hits h JOIN (SELECT lookup_id, min(p) AS p FROM hits GROUP BY 1) b USING (lookup_id, p)),
counts AS (SELECT l.lookup_id, l.doi <> '' OR l.pmid <> '' AS reliable, count(*) FILTER (WHERE i.library_id = l.target) AS own, count(*) FILTER (WHERE i.library_id <> l.target) AS other, coalesce(bool_or(i.library_id = l.target AND i.has_pdf), false) AS pdf
 FROM lookups l LEFT JOIN best b USING (lookup_id) LEFT JOIN items i USING (item_id) GROUP BY ALL)"""


@query("WITH " + _ITEMS + """ SELECT lookup_id, CASE WHEN own > 1 OR (own = 0 AND other > 1) THEN 'ambiguous' WHEN own = 1 AND pdf THEN 'present' WHEN own = 1 THEN 'present-no-pdf' WHEN other = 1 THEN 'present-other-library' WHEN reliable THEN 'absent' ELSE 'unknown' END AS status,
 reliable AND NOT (own > 1 OR (own = 0 AND other > 1)) AS can_import FROM counts""")
def reference_status(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    items = c.select(F.col("c_custkey").alias("item_id"), (F.col("c_nationkey") % 3).alias("library_id"), F.concat(F.lit("10.9/c"), F.col("c_custkey") % 1000).alias("doi"), F.when(F.col("c_custkey") % 2 == 0, (F.col("c_custkey") % 800).cast("string")).otherwise("").alias("pmid"), (F.col("c_acctbal") > 0).alias("has_pdf"))
    lookups = o.select(F.col("o_orderkey").alias("lookup_id"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("10.9/c"), F.col("o_custkey") * 2 % 1700)).alias("doi"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise((F.col("o_custkey") % 900).cast("string")).alias("pmid"), (F.col("o_custkey") % 3).cast("int").alias("target_library_id"))
    return graph.reference_status(lookups, items, ("doi", "pmid"))


_KEY = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"""SELECT DISTINCT doc_id AS ref_id, item_id FROM documents, benchmark WHERE length({_KEY.format('benchmark.text[:512]')}) >= 8 AND contains(' ' || {_KEY.format('documents.text')} || ' ', ' ' || {_KEY.format('benchmark.text[:512]')} || ' ')""")
def title_candidates(spark, d):
    return graph.title_candidates(table(spark, d, "documents").select(F.col("doc_id").alias("ref_id"), "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("title")))


# Identifiers and links


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 3 THEN '' ELSE '10.1234/ab-' || p_partkey END AS doi, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE '1901.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') END AS arxiv_id,
 CASE WHEN p_partkey % 3 = 2 THEN '' ELSE p_partkey::VARCHAR END AS pmid, CASE WHEN p_partkey = 0 THEN '' ELSE 'W' || p_partkey END AS openalex_id FROM part""")
def normalize_identifiers(spark, d):
    k = F.col("p_partkey")
    n = F.lpad((k % 100000).cast("string"), 5, "0")
    raw_doi = F.when(k % 5 == 0, F.concat(F.lit(" doi: 10.1234/AB-"), k)).when(k % 5 == 1, F.concat(F.lit("HTTPS://dx.doi.org/10.1234/ab-"), k)).when(k % 5 == 2, F.concat(F.lit("<10.1234/Ab-"), k, F.lit(">"))).when(k % 5 == 3, F.concat(F.lit("10.12/ab "), k)).otherwise(F.concat(F.lit("10.1234/ab-"), k))
    raw_arxiv = F.when(k % 4 == 0, F.concat(F.lit("arXiv ID: 1901."), n, F.lit("v12"))).when(k % 4 == 1, F.concat(F.lit("https://arxiv.org/pdf/1901."), n, F.lit(".pdf?x=1"))).when(k % 4 == 2, F.concat(F.lit("1901."), n)).otherwise(F.concat(F.lit("19.01"), n))
    raw_pmid = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), k, F.lit("/"))).otherwise(F.concat(F.lit("x"), k))
    return table(spark, d, "part").select("p_partkey", I.doi(raw_doi).alias("doi"), I.arxiv(raw_arxiv).alias("arxiv_id"), I.pmid(raw_pmid).alias("pmid"), I.openalex(F.concat(F.lit("https://openalex.org/w"), k)).alias("openalex_id"))


@query("""SELECT p_partkey, '10.5555/x' || p_partkey AS doi, '2012.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS arxiv_id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE '' END AS pmid, 'https://host.example/' || p_partkey || '.pdf' AS pdf_url FROM part""")
def extract_identifiers(spark, d):
    k = F.col("p_partkey")
    ref = F.concat(F.lit("A. Name, "), "p_name", F.lit(", 2012, doi 10.5555/\n X"), k, F.lit(". arXiv: 2012."), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("v3; "), F.when(k % 2 == 0, F.concat(F.lit("PMID: "), k)).otherwise(k.cast("string")), F.lit(" see https://host.example/page and https://host.example/"), k, F.lit(".pdf#p2)."))
    return table(spark, d, "part").select("p_partkey", I.extract(ref).alias("x")).select("p_partkey", "x.*")


@query("""SELECT page_id, (page_id % 3 = 0 AND NOT regexp_matches(url, '[?#]')) OR (page_id % 3 = 1 AND NOT contains(url, '#')) AS is_pdf, page_id % 5 <> 0 AS is_public, CASE WHEN page_id % 7 = 0 THEN '' ELSE url END AS link FROM pages""")
def url_filters(spark, d):
    p, u = F.col("page_id"), F.col("url")
    doc = F.when(p % 3 == 0, F.concat(u, F.lit("/a.PDF#x"))).when(p % 3 == 1, F.concat(u, F.lit("?a=1&format=pdf"))).otherwise(F.concat(u, F.lit("?q=x.pdf")))
    host = F.when(p % 5 == 0, F.concat(F.lit("http://192.168.1.2/"), p)).otherwise(u)
    return table(spark, d, "pages").select("page_id", I.is_pdf_url(doc).alias("is_pdf"), I.is_public_url(host).alias("is_public"), I.safe_link(F.when(p % 7 == 0, F.concat(F.lit("javascript:"), u)).otherwise(u)).alias("link"))


@query("SELECT o_orderkey, sha256(o_orderkey || chr(10) || o_orderstatus || chr(10) || o_orderpriority) AS key FROM orders")
def cache_keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey", I.cache_key(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("key"))


# Scalar text


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squashed, md5(trim(regexp_replace(lower(text[:512]), '[^\p{L}\p{N}]+', ' ', 'g'))) AS title_key,
 (ceil(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / 4.0) + length(regexp_replace(text, '[\x00-\x7F]', '', 'g')))::BIGINT AS tokens,
 length(regexp_extract_all(text, '\p{L}[\p{L}\p{N}''’-]*'))::BIGINT AS words, CASE WHEN length(text) > 200 THEN text[:199] || '…' ELSE text END AS short FROM documents""")
def text_scalars(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(S.squash(t)).alias("squashed"), F.md5(S.title_key(t)).alias("title_key"), S.token_estimate(t).alias("tokens"), S.word_count(t).cast("bigint").alias("words"), S.truncate(t, 200).alias("short"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g'))) AS key FROM documents WHERE NOT regexp_matches(text, '[^\x00-ɏ]')")
def search_keys(spark, d):
    """All documents; the SQL states those without characters above U+024F only."""
    return table(spark, d, "documents").select("doc_id", F.md5(S.search_key("text")).alias("key"))


@query()
def nfkc_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", S.nfkc("text").alias("text"))


@query(r"SELECT o_orderkey, year(o_orderdate)::INT AS year, 'state of ' || o_orderpriority AS joined FROM orders")
def year_and_dehyphenate(spark, d):
    y = S.first_year(F.concat(F.lit("no. 20123, p. "), F.date_format("o_orderdate", "MM/yyyy"), F.lit("a")))
    return table(spark, d, "orders").select("o_orderkey", y.alias("year"), S.dehyphenate(F.concat(F.lit("st-\n ate of "), "o_orderpriority")).alias("joined"))


@query("SELECT doc_id, item_id, ((length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text))::BIGINT AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def text_occurrences(spark, d):
    b = F.broadcast(table(spark, d, "benchmark").select("item_id", F.col("text").alias("target")))  # a fixed set of items
    both = table(spark, d, "documents").join(b, F.contains(F.col("text"), F.col("target")))
    return both.select("doc_id", "item_id", S.occurrences(F.col("text"), F.col("target")).alias("n"))


@query("""SELECT item_id, min(doc_id) AS doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY item_id
 HAVING count(*) = 1 AND sum((length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text)) = 1""")
def unique_containment(spark, d):
    return text_occurrences(spark, d).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n")).where("n = 1").select("item_id", "doc_id")


# Markdown


@query("""SELECT doc_id, n, line, (SELECT coalesce(sum(length(x) + 1), 0) FROM (SELECT unnest(string_split(d.text, chr(10))[:l.n]) AS x))::BIGINT AS begin_at
 FROM documents d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) - 1 AS n) l""")
def line_records(spark, d):
    return M.lines(table(spark, d, "documents")).select("doc_id", F.col("n").cast("bigint").alias("n"), "line", F.col("offset").cast("bigint").alias("begin_at"))


@query(r"""SELECT doc_id, n, block FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10) || chr(10))) AS block FROM marked) WHERE trim(block) <> ''""", "marked")
def paragraph_blocks(spark, d):
    return M.paragraphs(X.marked(spark, d)).select("doc_id", F.col("n").cast("bigint").alias("n"), "block")


@query("SELECT conv_id AS doc_id, CASE WHEN turn = 0 THEN 1 ELSE 2 END::INT AS level, CASE WHEN turn = 0 THEN 'Talk ' || conv_id ELSE 'Turn ' || turn END AS title FROM conversations")
def outline_headings(spark, d):
    return M.headings(X.marked(spark, d)).select("doc_id", "level", "title")


@query("SELECT conv_id AS doc_id, CASE WHEN turn = 0 THEN 'talk-' || conv_id ELSE 'turn-' || turn END AS anchor FROM conversations")
def heading_anchors(spark, d):
    return M.heading_anchors(M.headings(X.marked(spark, d)), S.slug(F.col("title"))).select("doc_id", "anchor")


@query("""SELECT e.event_id, m.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) m ON e.user_id = m.user_id AND e.ts >= m.ts""")
def reading_position_asof(spark, d):
    e = table(spark, d, "events")
    marks = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"))
    return R.last_at_or_before(e.select("user_id", "ts", "event_id"), marks, "user_id", "ts", "ts", "last_purchase").select("event_id", "last_purchase")


@query("""SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS row, role || '/' || (CASE WHEN turn % 2 = 0 THEN 'a|b' || turn ELSE '' END) AS cells FROM conversations UNION ALL SELECT DISTINCT conv_id, 0, 'who/what' FROM conversations""")
def gfm_table_rows(spark, d):
    row = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("| "), "role", F.lit(" | a\\|b"), "turn", F.lit(" | extra |"))).otherwise(F.concat(F.lit("| "), "role", F.lit(" |")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("r")))), lambda x: x["r"])
    docs = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.concat(F.lit("intro\n\n| who | what |\n|---|:---|\n"), F.array_join(rows, "\n"), F.lit("\n\nend")).alias("text"))
    return M.gfm_tables(docs).select("doc_id", F.col("row").cast("bigint").alias("row"), F.array_join("cells", "/").alias("cells"))


@query("""SELECT o_orderkey, 'Figure ' || (o_orderkey % 90) || '.' AS figure, 'About ' || o_orderstatus AS about, CASE WHEN o_orderkey % 2 = 0 THEN 'Table S' || (o_orderkey % 9) || ':' END AS table_label FROM orders""")
def captions(spark, d):
    k = F.col("o_orderkey")
    fig = M.figure_caption(F.concat(F.lit("  Figure "), k % 90, F.lit(". About "), "o_orderstatus"))
    tab = M.table_caption(F.when(k % 2 == 0, F.concat(F.lit("Table S"), k % 9, F.lit(": x"))).otherwise(F.concat(F.lit("Tables "), k % 9)))
    return table(spark, d, "orders").select("o_orderkey", fig["label"].alias("figure"), fig["description"].alias("about"), tab["label"].alias("table_label"))


@query("SELECT o_orderkey, 'figure ' || (o_orderkey % 90) || ',table s3,figure 2b' AS labels FROM orders")
def label_mentions(spark, d):
    t = F.concat(F.lit("See Fig. "), F.col("o_orderkey") % 90, F.lit(", Table  S3 and figure 2b; configure 4."))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(M.label_references(t), ",").alias("labels"))


@query("""SELECT o_orderkey, x AS number FROM (SELECT o_orderkey, unnest(list_distinct(list_concat([(o_orderkey % 50)::INT], list_transform(range(0, 4), lambda i: ((o_orderkey % 20) + i)::INT)))) AS x FROM orders)""")
def numeric_citations(spark, d):
    k = F.col("o_orderkey")
    t = F.concat(F.lit("as shown ["), k % 50, F.lit(", "), k % 20, F.lit("–"), k % 20 + 3, F.lit("] and [5-2] or [1-500] not (7)"))
    return table(spark, d, "orders").select("o_orderkey", F.explode(M.numeric_citations(t)).alias("number"))


@query("SELECT o_orderkey AS doc_id, unnest(['Smith', 'Ng']) AS author, unnest([2000 + (o_orderkey % 20)::INT, 1999]) AS year FROM orders")
def author_year_citations(spark, d):
    t = F.concat(F.lit("It is known (Smith et al., "), F.lit(2000) + F.col("o_orderkey") % 20, F.lit("; Ng 1999b) (see above) (p. 3)."))
    return M.author_year_citations(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), t.alias("text")))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS number, 'Part ' || l_partkey || ', 19' || (l_suppkey % 90 + 10) || '. more' AS reference FROM lineitem")
def reference_list(spark, d):
    one = F.concat(F.lit("["), "l_linenumber", F.lit("] Part "), "l_partkey", F.lit(", 19"), F.col("l_suppkey") % 90 + 10, F.lit(".\n   more"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", one.alias("r")))), lambda x: x["r"])
    docs = spread(table(spark, d, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("# T\n\n[9] in text\n\n## References\n\n"), F.array_join(items, "\n"), F.lit("\n\n# Appendix\n[99] no")).alias("text"))
    return citations.references(docs).select("doc_id", "number", "reference")


@query(r"""WITH b AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, rtrim(unnest(string_split(text, chr(10)))) AS block FROM documents),
c AS (SELECT *, lag(block) OVER (PARTITION BY doc_id ORDER BY n) AS p FROM b WHERE trim(block) <> ''),
j AS (SELECT *, coalesce(p IS NOT NULL AND regexp_matches(block, '^\p{Ll}') AND regexp_matches(p, '[\p{L}\p{N}]$') AND length(regexp_extract_all(p, '\p{L}[\p{L}\p{N}''’-]*')) >= 6, false) AS joined FROM c),
r AS (SELECT *, sum((NOT joined)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM j)
SELECT doc_id, run::BIGINT AS run, md5(string_agg(block, ' ' ORDER BY n)) AS text FROM r GROUP BY doc_id, run""")
def prose_join(spark, d):
    b = M.lines(table(spark, d, "documents")).where(F.trim("line") != "").select("doc_id", "n", F.col("line").alias("block"))
    return M.join_prose(b).select("doc_id", F.col("run").cast("bigint").alias("run"), F.md5("text").alias("text"))


@query("""WITH b AS (SELECT *, turn % 4 IN (1, 2) AS m FROM conversations), g AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, m ORDER BY turn) AS isle FROM b)
SELECT conv_id AS doc_id, turn AS n, CASE WHEN m AND count(*) OVER (PARTITION BY conv_id, m, isle) >= 2 THEN '- ' WHEN m THEN '• ' ELSE '' END || role AS text FROM g""")
def bullet_runs(spark, d):
    b = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("n"), F.concat(F.when((F.col("turn") % 4).isin(1, 2), "• ").otherwise(""), "role").alias("block"))
    return M.bullet_runs(b).select("doc_id", "n", "text")


@query()
def markdown_blocks(spark, d):
    return M.blocks(X.marked(spark, d))


@query("SELECT o_orderkey AS doc_id, n::BIGINT AS n, n BETWEEN 1 AND 3 OR n = 5 AS blocked FROM orders, range(0, 7) t(n)")
def fence_blocked_lines(spark, d):
    t = F.concat(F.lit("a\n```` x\n``` "), "o_orderpriority", F.lit("\n`````\nb\n    code\nend"))
    return M.blocked_lines(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), t.alias("text"))).select("doc_id", F.col("n").cast("bigint").alias("n"), "blocked")


@query("""SELECT o_orderkey, 'see ⟦0⟧ and ⟦1⟧, ' || o_orderstatus || ' ⟦2⟧ ⟦3⟧' AS protected, 'see `a' || o_orderkey || '` and ![x](u), ' || o_orderstatus || ' $k$ [1, ' || (o_orderkey % 9) || ']' AS restored FROM orders""")
def placeholder_round_trip(spark, d):
    t = F.concat(F.lit("see `a"), "o_orderkey", F.lit("` and ![x](u), "), "o_orderstatus", F.lit(" $k$ [1, "), F.col("o_orderkey") % 9, F.lit("]"))
    p = table(spark, d, "orders").select("o_orderkey", M.protect(t).alias("p"))
    return p.select("o_orderkey", F.col("p.text").alias("protected"), M.restore(F.col("p.text"), F.col("p.parts")).alias("restored"))


# Layout


@query("SELECT doc_id, ord, x0 < x1 AND y0 < y1 AND y1 <= 1000 AS valid FROM (SELECT * FROM boxes)", "boxes")
def bbox_valid(spark, d):
    b = X.boxes(spark, d)
    return b.select("doc_id", "ord", layout.valid_box(F.col("page"), F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")])).alias("valid"))


@query("""SELECT doc_id, page::INT AS page, ord, (two AND x0 >= 400)::INT AS col, (row_number() OVER (PARTITION BY doc_id, page ORDER BY (two AND x0 >= 400)::INT, y0, x0, ord))::INT AS pos
 FROM (SELECT *, min(x0) OVER (PARTITION BY doc_id, page) < 400 AND max(x0) OVER (PARTITION BY doc_id, page) >= 400 AS two FROM boxes)""", "boxes")
def column_reading_order(spark, d):
    return layout.reading_order(X.boxes(spark, d), ["doc_id", "page"]).select("doc_id", F.col("page").cast("int").alias("page"), "ord", "col", "pos")


@query("WITH q AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS ord FROM lineitem) SELECT a.doc_id, a.ord AS a, b.ord AS b FROM q a JOIN q b ON a.doc_id = b.doc_id AND b.ord = a.ord + 1 AND a.ord % 2 = 1")
def panel_pairs(spark, d):
    """Two panels side by side for every pair of lines, far below the pair before."""
    k = F.col("l_linenumber")
    x, y = F.when(k % 2 == 1, 50).otherwise(500), F.floor((k - 1) / 2) * 240
    b = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey").distinct().select(F.col("l_orderkey").alias("doc_id"), k.alias("ord"), x.alias("x0"), (x + 430).alias("x1"), y.alias("y0"), (y + 150).alias("y1"))
    return layout.panel_pairs(b, ["doc_id"]).select("doc_id", "a", "b")


# Intervals


@query("""SELECT p.doc_id, p.at, CASE WHEN count(s.span) = 1 THEN min(s.span) END AS span FROM (SELECT DISTINCT doc_id, (begin_at + 12)::BIGINT AS at FROM spans) p LEFT JOIN spans s ON s.doc_id = p.doc_id AND s.begin_at <= p.at AND p.at + 4 <= s.end_at GROUP BY ALL""", "spans")
def interval_containment(spark, d):
    s = X.spans(spark, d)
    p = s.select("doc_id", (F.col("begin_at") + 12).alias("at")).distinct().withColumn("to_at", F.col("at") + 4)
    return R.containing(p, s, "doc_id", "at", "to_at", "begin_at", "end_at", "span").select("doc_id", "at", "span")


@query("""WITH m AS (SELECT *, max(end_at) OVER (PARTITION BY doc_id ORDER BY begin_at, end_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
r AS (SELECT *, sum((reach IS NULL OR begin_at > reach)::INT) OVER (PARTITION BY doc_id ORDER BY begin_at, end_at ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT doc_id, min(begin_at) AS begin_at, max(end_at) AS end_at, count(*)::BIGINT AS n FROM r GROUP BY doc_id, run""".replace("WITH m", "WITH " + X.SQL["spans"] + ", sp AS (SELECT * FROM spans), m"))
def interval_merge(spark, d):
    return R.merge_intervals(X.spans(spark, d), ["doc_id"], "begin_at", "end_at")


@query("""SELECT doc_id, begin_at, end_at FROM picked WHERE taken""", "")
def interval_greedy_select(spark, d):
    return R.greedy_intervals(X.spans(spark, d), ["doc_id"], "begin_at", "end_at")


_SQL["interval_greedy_select"] = "WITH RECURSIVE " + X.SQL["spans"] + """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY begin_at, end_at) AS k FROM spans),
p AS (SELECT doc_id, k, begin_at, end_at, true AS taken, end_at AS reach FROM o WHERE k = 1
 UNION ALL SELECT o.doc_id, o.k, o.begin_at, o.end_at, o.begin_at >= p.reach, CASE WHEN o.begin_at >= p.reach THEN o.end_at ELSE p.reach END FROM p JOIN o ON o.doc_id = p.doc_id AND o.k = p.k + 1)
SELECT doc_id, begin_at, end_at FROM p WHERE taken"""


# Translation and revisions


def _blocks(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("n"), "role", "text", (F.col("role") == "assistant").alias("translatable"))


@query("SELECT conv_id AS doc_id, turn AS n, (sum((turn % 3 = 0 AND turn > 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS section FROM conversations")
def translation_sections(spark, d):
    return TR.sections(_blocks(spark, d).withColumn("h1", F.col("n") % 3 == 0), "doc_id", "n", "h1").select("doc_id", "n", F.col("section").cast("bigint").alias("section"))


@query(r"""WITH RECURSIVE b AS (SELECT conv_id AS doc_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role = 'assistant' AS c, (ceil(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / 4.0) + length(regexp_replace(text, '[\x00-\x7F]', '', 'g')))::BIGINT AS t FROM conversations),
p AS (SELECT doc_id, turn, k, c, 1 AS batch, c::INT AS n, t AS s FROM b WHERE k = 1
 UNION ALL SELECT b.doc_id, b.turn, b.k, b.c, p.batch + f, CASE WHEN f = 1 THEN 0 ELSE p.n END + b.c::INT, CASE WHEN f = 1 THEN 0 ELSE p.s END + b.t
 FROM p JOIN b ON b.doc_id = p.doc_id AND b.k = p.k + 1, LATERAL (SELECT ((b.c AND p.n >= 2) OR p.s + b.t > 150)::INT AS f))
SELECT doc_id, turn AS n, dense_rank() OVER (PARTITION BY doc_id ORDER BY batch)::BIGINT AS batch FROM (SELECT *, bool_or(c) OVER (PARTITION BY doc_id, batch) AS keep FROM p) WHERE keep""")
def translation_batches(spark, d):
    return TR.batches(_blocks(spark, d), ["doc_id"], "n", "text", "translatable", 2, 150).select("doc_id", "n", "batch")


@query("SELECT conv_id AS doc_id, turn AS n, CASE WHEN role <> 'assistant' THEN 'skip' WHEN turn % 4 = 1 AND turn % 3 <> 0 THEN 'retain' ELSE 'request' END AS action FROM conversations")
def translation_plan(spark, d):
    b = _blocks(spark, d)
    base = b.where("n % 4 = 1").select("doc_id", "n", (F.col("n") % 3 == 0).alias("failed"))
    return TR.plan(b, base, ["doc_id", "n"]).select("doc_id", "n", "action")


@query("SELECT conv_id AS doc_id, turn::VARCHAR AS id, CASE WHEN turn % 3 = 2 THEN 'missing' WHEN turn = 3 THEN 'duplicate' WHEN turn % 5 = 4 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN turn % 3 <> 2 AND turn <> 3 AND turn % 5 <> 4 THEN role END AS markdown FROM conversations UNION ALL SELECT DISTINCT conv_id, 'x', 'unknown', NULL FROM conversations")
def translation_responses(spark, d):
    b = _blocks(spark, d)
    one = lambda i, t: F.struct(i.alias("id"), t.alias("translatedMarkdown"))
    said = F.when(F.col("n") % 5 == 4, " ").otherwise(F.col("role"))
    mine = F.array_repeat(one(F.col("n").cast("string"), said), F.when(F.col("n") % 3 == 2, 0).when(F.col("n") == 3, 2).otherwise(1))
    raw = b.groupBy("doc_id").agg(F.concat(F.lit("```json\n"), F.to_json(F.concat(F.flatten(F.collect_list(mine)), F.array(one(F.lit("x"), F.lit("y"))))), F.lit("\n```")).alias("raw"))
    return TR.validate(raw, b.select("doc_id", F.col("n").cast("string").alias("block_id")))


@query("""WITH m AS (SELECT conv_id AS doc_id, turn AS n, CASE WHEN turn % 3 = 0 THEN 'new ' || role ELSE text END AS markdown FROM conversations)
SELECT doc_id, n, markdown, (sum(length(markdown) + 2) OVER w - 2)::BIGINT AS end_at, (sum(length(markdown) + 2) OVER w - 2 - length(markdown))::BIGINT AS begin_at FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY n)""")
def revision_materialize(spark, d):
    b = _blocks(spark, d)
    changes = b.where("n % 3 = 0").select("doc_id", "n", F.concat(F.lit("new "), "role").alias("replacement"))
    return TR.materialize_view(b, changes, "doc_id", "n", "text").select("doc_id", "n", "markdown", F.col("end").cast("bigint").alias("end_at"), F.col("begin").cast("bigint").alias("begin_at"))


# Caches


def _entries(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("accessed"), F.sum(F.octet_length("props")).alias("size"))


_ENTRIES = "e AS (SELECT user_id AS key, max(ts) AS accessed, sum(strlen(props))::BIGINT AS size FROM events GROUP BY user_id)"


@query(f"WITH {_ENTRIES}, r AS (SELECT *, row_number() OVER (ORDER BY accessed DESC, key) AS n, sum(size) OVER (ORDER BY accessed DESC, key ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT key, size FROM r WHERE n <= 100 AND s <= 60000")
def cache_lru_keep(spark, d):
    return R.lru_keep(_entries(spark, d), "accessed", "size", "key", 100, 60000).select("key", "size")


@query(f"WITH {_ENTRIES}, t AS (SELECT max(accessed) AS now FROM e) SELECT key FROM e, t WHERE epoch(now)::BIGINT - epoch(accessed)::BIGINT <= 43200".replace("epoch(now)::BIGINT", "floor(epoch(now))").replace("epoch(accessed)::BIGINT", "floor(epoch(accessed))"))
def cache_ttl(spark, d):
    e = _entries(spark, d)
    now = e.agg(F.max("accessed").cast("timestamp").alias("now"))
    return cache.alive(e.crossJoin(F.broadcast(now)), "accessed", F.col("now"), 43200).select("key")


@query(f"WITH {_ENTRIES} SELECT count(*)::BIGINT AS entries, sum(size)::BIGINT AS bytes FROM e")
def cache_stats(spark, d):
    return cache.stats(_entries(spark, d), "size")


@query(f"SELECT event_id, floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(ts)) > CASE WHEN value > 50 THEN 2592000 ELSE 604800 END AS stale FROM events")
def cache_staleness(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", cache.stale(F.col("ts"), F.coalesce(F.col("value") > 50, F.lit(False)), F.lit(NOW).cast("timestamp")).alias("stale"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_wins(spark, d):
    return cache.latest(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_id, coalesce(count(*) FILTER (WHERE event_type = 'click') OVER w = 2, false) AS open FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)")
def circuit_breaker(spark, d):
    return cache.open_circuits(table(spark, d, "events").withColumn("failed", F.col("event_type") == "click"), "user_id", "event_id", "failed")


# Rendering


@query()
def html_visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", render.visible_text("html").alias("text"))


@query("SELECT p_partkey, '<table><tr><td rowspan=\"2\">' || p_name || '</td><td>x</td></tr></table>' AS html FROM part")
def html_table_sanitize(spark, d):
    h = F.concat(F.lit("<TABLE class=a><script>x</script><tr onclick='e()'><td rowspan=2 colspan=0><a href='u'>"), "p_name", F.lit("</a></td><!-- c --><td>x</td></tr></TABLE>"))
    return table(spark, d, "part").select("p_partkey", render.safe_table(h).alias("html"))


@query("""SELECT conv_id AS doc_id, string_agg('<!-- page ' || (turn + 1) || ' -->' || chr(10) || chr(10) || regexp_replace(trim(text), '([\\\\`*_\\[\\]<>#|])', '\\\\\\1', 'g'), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id""")
def plain_text_render(spark, d):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return render.plain_pages(table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(texts, "\f").alias("text")))


@query("SELECT conv_id AS doc_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def structured_render(spark, d):
    return render.transcript(table(spark, d, "conversations").withColumnRenamed("conv_id", "doc_id"), "doc_id", "turn", "role", "text")


from lectern import catalog_documents  # noqa: E402, F401  (registers its queries)
