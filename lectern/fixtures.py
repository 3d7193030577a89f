"""Inputs of the registered queries, derived from the star-schema tables by fixed expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.session import table

#: DuckDB views with the same rows as the functions of this module.
SQL = {
    "papers": """papers AS (SELECT 'lib:' || p_partkey AS node, p_name AS title,
  CASE WHEN p_partkey % 17 = 0 THEN '' ELSE '10.1000/p' || (p_partkey - (p_partkey % 23 = 0)::INT) END AS doi,
  CASE WHEN p_partkey % 34 = 0 THEN '2101.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') ELSE '' END AS arxiv_id FROM part)""",
    "refs": """refs AS (SELECT 'lib:' || a.l_partkey AS source, CASE WHEN b.l_partkey % 17 = 0 THEN '' ELSE '10.1000/p' || b.l_partkey END AS doi,
  CASE WHEN b.l_partkey % 17 = 0 THEN '2101.' || lpad((b.l_partkey % 100000)::VARCHAR, 5, '0') ELSE '' END AS arxiv_id,
  CASE a.l_returnflag WHEN 'A' THEN 'openalex' WHEN 'N' THEN 's2' ELSE 'opencitations' END AS provider
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber <= b.l_linenumber)""",
    "edges": """by_doi AS (SELECT doi, min(node) AS node FROM papers WHERE doi <> '' GROUP BY doi HAVING count(*) = 1),
by_arxiv AS (SELECT arxiv_id, min(node) AS node FROM papers WHERE arxiv_id <> '' GROUP BY arxiv_id HAVING count(*) = 1),
edges AS (SELECT r.source, coalesce(d.node, a.node) AS target, list_sort(list(DISTINCT r.provider)) AS sources
  FROM refs r LEFT JOIN by_doi d ON r.doi = d.doi LEFT JOIN by_arxiv a ON r.arxiv_id = a.arxiv_id
  WHERE coalesce(d.node, a.node) IS NOT NULL AND coalesce(d.node, a.node) <> r.source GROUP BY 1, 2)""",
    "boxes": """boxes AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page, l_linenumber AS ord,
  CASE WHEN l_partkey % 2 = 0 THEN 40 ELSE 540 END + l_suppkey % 7 AS x0, CASE WHEN l_partkey % 2 = 0 THEN 40 ELSE 540 END + 300 + l_suppkey % 50 AS x1,
  (l_quantity * 16)::INT AS y0, (l_quantity * 16)::INT + 120 AS y1 FROM lineitem)""",
    "spans": """spans AS (SELECT l_orderkey AS doc_id, l_linenumber AS span, (l_linenumber * 40 - l_partkey % 30)::BIGINT AS begin_at, (l_linenumber * 40 + l_suppkey % 30)::BIGINT AS end_at FROM lineitem)""",
    "marked": """marked AS (SELECT conv_id AS doc_id, string_agg(CASE WHEN turn = 0 THEN '# Talk ' || conv_id ELSE '## Turn *' || turn || '*' END || chr(10) || chr(10) || replace(text, chr(10), ' '), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)""",
}


def papers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    named = F.concat(F.when(k % 3 == 0, "DOI: 10.1000/P").when(k % 3 == 1, "https://doi.org/10.1000/p").otherwise("10.1000/P"), k - (k % 23 == 0).cast("int"))
    raw = F.concat(F.lit("arXiv:2101."), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("v2"))
    return table(spark, d, "part").select(F.concat(F.lit("lib:"), k).alias("node"), F.col("p_name").alias("title"), F.when(k % 17 == 0, "").otherwise(named).alias("doi"), F.when(k % 34 == 0, raw).otherwise("").alias("arxiv_id"))


def references(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one order cite the parts of its later lines; the return flag is the provider."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    a = rows.select("l_orderkey", F.col("l_linenumber").alias("la"), F.col("l_partkey").alias("pa"), "l_returnflag")
    b = rows.select("l_orderkey", F.col("l_linenumber").alias("lb"), F.col("l_partkey").alias("pb"))
    pairs = a.join(b, "l_orderkey").where("la <= lb")
    k = F.col("pb")
    provider = F.when(F.col("l_returnflag") == "A", "OpenAlex").when(F.col("l_returnflag") == "N", " s2").otherwise("opencitations")
    return pairs.select(F.concat(F.lit("lib:"), "pa").alias("source"), F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("https://dx.doi.org/10.1000/P"), k)).alias("doi"), F.when(k % 17 == 0, F.concat(F.lit("2101."), F.lpad((k % 100000).cast("string"), 5, "0"))).otherwise("").alias("arxiv_id"), provider.alias("provider"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    left = F.when(F.col("l_partkey") % 2 == 0, 40).otherwise(540)
    y = (F.col("l_quantity") * 16).cast("int")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), F.col("l_linenumber").alias("ord"), (left + F.col("l_suppkey") % 7).alias("x0"), (left + 300 + F.col("l_suppkey") % 50).alias("x1"), y.alias("y0"), (y + 120).alias("y1"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("l_linenumber") * 40
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("span"), (at - F.col("l_partkey") % 30).cast("bigint").alias("begin_at"), (at + F.col("l_suppkey") % 30).cast("bigint").alias("end_at"))


def marked(spark: SparkSession, d: str) -> DataFrame:
    """One Markdown document per conversation: a heading and a paragraph for each turn."""
    head = F.when(F.col("turn") == 0, F.concat(F.lit("# Talk "), "conv_id")).otherwise(F.concat(F.lit("## Turn *"), "turn", F.lit("*")))
    part = F.concat(head, F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit(" ")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"])
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(parts, "\n\n").alias("text"))
