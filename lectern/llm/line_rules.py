"""Quality rules by cross-document line frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.keyfilter import mark_possible
from lectern.session import BROADCAST_BYTES, materialize, small_or_shuffled

_K, _POS, _HIT, _ROW, _LINE, _N = "__lf_key", "__lf_pos", "__lf_hits", "__lf_row", "__lf_line", "__lf_n"


def _key(*columns: Column) -> Column:
    """128 bits of the columns."""
    return F.struct(F.xxhash64(*columns).alias("p"), F.xxhash64(F.lit(1), *columns).alias("q"))


def _lines(docs: DataFrame, text_col: str, id_col: str, host_col: str) -> DataFrame:
    """One row per non-blank line: row key, id, position and hash of (host, normalised line)."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))
    line = F.lower(F.trim(F.regexp_replace(F.col(_LINE), r"[ \t\r\f\x0B]+", " ")))
    return (
        docs.select(
            F.col(id_col).alias("__lf_id"),
            _key(F.col(id_col), F.col(text_col)).alias(_ROW),
            host.alias("__lf_host"),
            F.posexplode(F.split(F.col(text_col), "\n")).alias(_POS, _LINE),
        )
        .withColumn(_LINE, line)
        .where(F.col(_LINE) != "")
        .select("__lf_id", _ROW, "__lf_host", _POS, _key(F.col("__lf_host"), F.col(_LINE)).alias(_K))
    )


def line_frequency_rules(
    docs: DataFrame,
    max_docs: int = 10,
    max_share: float = 0.001,
    min_kept: float = 0.5,
    text_col: str = "text",
    id_col: str = "doc_id",
    host_col: str = "source",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` without the lines that too many documents of the same host share.

    A line (lower case, white space collapsed) is dropped wherever it occurs in a host if
    more than ``max(max_docs, max_share * documents of the host)`` distinct documents of
    that host hold it. A document that loses lines is rejected if less than ``min_kept``
    of its characters stay. Documents without such lines are returned unchanged.

    Counts go over all rows as 128-bit hashes of (host, line), so one host's hot line is
    combined on the map side; texts are not shuffled as long as the positions to drop
    can be broadcast; beyond that a bitmap of fixed size keeps rows without such lines out of the shuffle.
    A line at the limit stays. Long texts and lines are read whole.

    Null texts stay as they are; blank lines are never counted nor dropped, unless the
    document goes. A null host is a host of its own. Repeated rows with one id count as
    one document. All columns keep their names; the text column holds what stays.
    """
    lines = _lines(docs, text_col, id_col, host_col)
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))
    hosts = docs.groupBy(host.alias("__lf_host")).agg(F.countDistinct(id_col).alias("__lf_docs"))
    limits = hosts.select("__lf_host", F.greatest(F.lit(float(max_docs)), F.col("__lf_docs") * F.lit(max_share)).alias("__lf_limit"))
    often = (
        lines.groupBy(_K)
        .agg(F.countDistinct("__lf_id").alias(_N), F.first("__lf_host").alias("__lf_host"))
        .where(F.col(_N) > max_docs)
        .join(limits, "__lf_host")
        .where(F.col(_N) > F.col("__lf_limit"))
        .select(_K)
    )
    often = materialize(often, "frequent-lines")
    hits = materialize(
        lines.join(small_or_shuffled(often, 64, broadcast_bytes), _K, "left_semi")
        .groupBy(_ROW)
        .agg(F.collect_set(_POS).alias(_HIT)),
        "line-positions",
    )
    keyed = docs.withColumn(_ROW, _key(F.col(id_col), F.col(text_col)))
    few = small_or_shuffled(hits, 160, broadcast_bytes)
    if few is hits:
        keyed = mark_possible(keyed, hits, _ROW, "__lf_flag")
        joined = keyed.where("__lf_flag").join(hits, _ROW, "left").unionByName(keyed.where("not __lf_flag"), allowMissingColumns=True)
    else:
        joined = keyed.join(few, _ROW, "left")
    kept = F.expr(f"array_join(filter(split(`{text_col}`, '\\n'), (x, i) -> not array_contains({_HIT}, i)), '\\n')")
    text = F.when(F.col(_HIT).isNull(), F.col(text_col)).otherwise(kept)
    stays = F.col(_HIT).isNull() | (F.length("__lf_text") >= F.lit(min_kept) * F.length(text_col))
    return joined.withColumn("__lf_text", text).where(stays).select(
        *[F.col("__lf_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    )
