"""The registered queries of the ten operators, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.bpe import bpe_round_trip
from lectern.llm.chat import format_chat, stream_events
from lectern.llm.exact_dedup import exact_dedup
from lectern.llm.html_wrapper import extract_pages
from lectern.llm.line_rules import line_frequency_rules
from lectern.llm.mixing import mix_sources
from lectern.llm.near_dedup import near_dedup
from lectern.llm.quality import quality_filter
from lectern.llm.substring_dedup import repeated_passages
from lectern.llm.token_store import write_tokens
from lectern.session import table


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids, and in ``text`` what decoding those ids gives."""
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency_rules(table(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the written store, without the folder's name, which differs from run to run."""
    return write_tokens(table(spark, sf_dir, "documents")).drop("root")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), copy_col="copy_no")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(stream_events(table(spark, sf_dir, "conversations")))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents
), normal AS (
  SELECT doc_id, text, source, pos, line, lower(trim(regexp_replace(line, '[ \t\r\f\v]+', ' ', 'g'))) AS norm FROM lines
), hosts AS (
  SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source
), often AS (
  SELECT l.source, l.norm FROM normal l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  WHERE l.norm <> '' GROUP BY l.source, l.norm, h.n
  HAVING count(DISTINCT l.doc_id) > greatest(10, h.n * 0.001)
), marked AS (
  SELECT n.*, o.norm IS NOT NULL AS dropped
  FROM normal n LEFT JOIN often o ON n.source IS NOT DISTINCT FROM o.source AND n.norm = o.norm
), rebuilt AS (
  SELECT doc_id, text, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS kept, bool_or(dropped) AS touched
  FROM marked GROUP BY doc_id, text
)
SELECT d.doc_id, CASE WHEN r.touched THEN r.kept ELSE d.text END AS text, d.lang, d.source, d.n_chars
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id AND d.text = r.text
WHERE r.touched IS NOT TRUE OR length(r.kept) >= 0.5 * length(d.text)
"""

#: Equal weights; a source is clamped once its ratio of weight to size ranks it among the k smallest.
MIX_SQL = r"""
WITH sizes AS (
  SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS n FROM {docs} GROUP BY source
), ranked AS (
  SELECT source, n, row_number() OVER (ORDER BY n, source) AS k, count(*) OVER () AS m, sum(n) OVER () AS total,
         coalesce(sum(n) OVER (ORDER BY n, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes WHERE n > 0
), filled AS (
  SELECT source, n, k, (total - 4.0 * before) / (m - k + 1) AS share FROM ranked
), level AS (
  SELECT min(k) AS k FROM filled WHERE share <= 4.0 * n
), epochs AS (
  SELECT f.source, round(CASE WHEN l.k IS NULL OR f.k < l.k THEN 4.0 ELSE (SELECT share FROM filled x WHERE x.k = l.k) / f.n END, 9) AS e
  FROM filled f CROSS JOIN level l
), drawn AS (
  SELECT d.*, (floor(e) + CASE WHEN ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0
         < e - floor(e) THEN 1 ELSE 0 END)::INT AS reps
  FROM {docs} d JOIN epochs p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, reps + 1))::INT AS copy_no FROM drawn
"""

OP8_SQL = """
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents
) WHERE text IS NULL OR rn = 1
"""

#: Builds the log of drafts, edits and regenerations and folds it.
OP10_SQL = """
WITH turns AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role DESC, text DESC) AS rn FROM conversations)
  WHERE rn = 1 AND conv_id IS NOT NULL AND turn IS NOT NULL
), lines AS (
  SELECT conv_id, turn, role, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM turns
), log AS (
  SELECT conv_id, turn, 0 AS i, turn AS msg, role, 'message' AS kind, CASE WHEN role = 'assistant' THEN '' ELSE 'draft' END AS text FROM turns
  UNION ALL SELECT conv_id, turn, 1, turn, role, 'delta', CASE WHEN role = 'assistant' THEN 'draft' ELSE ' text' END FROM turns
  UNION ALL SELECT conv_id, turn, 2, turn + 1, 'tool', 'message', 'too early' FROM turns WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, 3, turn, role, 'regenerate', '' FROM turns WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, 3 + i, turn, role, CASE WHEN i = 1 AND role IS DISTINCT FROM 'assistant' THEN 'edit' ELSE 'delta' END, CASE WHEN i = 1 THEN line ELSE chr(10) || line END FROM lines
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS n FROM log
), kept AS (
  SELECT *, max(CASE WHEN kind = 'regenerate' THEN n END) OVER (PARTITION BY conv_id ORDER BY msg RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cut FROM numbered
), live AS (
  SELECT *, max(CASE WHEN kind <> 'delta' THEN n END) OVER (PARTITION BY conv_id, msg) AS reset FROM kept WHERE cut IS NULL OR cut < n
), folded AS (
  SELECT conv_id, msg, arg_max(role, n) AS role, string_agg(text, '' ORDER BY n) AS text FROM live WHERE reset IS NULL OR n >= reset GROUP BY conv_id, msg
)
SELECT conv_id, count(*)::INT AS n_messages,
       string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10)
                  || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY msg) AS text
FROM folded GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_round_trip": op1_bpe_round_trip,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_minhash_dedup": op3_minhash_dedup,
        "op4_html_extraction": op4_html_extraction,
        "op5_line_frequency": op5_line_frequency,
        "op6_token_store": op6_token_store,
        "op7_mix_sources": op7_mix_sources,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_repeated_passages": op9_repeated_passages,
        "op10_chat_format": op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_frequency": OP5_SQL,
        "op7_mix_sources": MIX_SQL.format(docs="documents"),
        "op8_exact_dedup": OP8_SQL,
        "op10_chat_format": OP10_SQL,
    }
