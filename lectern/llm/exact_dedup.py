"""Exact deduplication by 128-bit content hash with byte comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm.keyfilter import mark_possible
from lectern.session import BROADCAST_BYTES, materialize

_H, _RN = "__xd_hash", "__xd_rn"


def _order(df: DataFrame, id_col: str) -> list[Column]:
    """Smallest id first, null ids last; equal ids are ordered by all other columns."""
    rest = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("__xd_")]))]
    return [F.col(id_col).asc_nulls_last(), F.xxhash64(*rest)]


def exact_dedup(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows of ``docs`` with one row per distinct text: the one with the smallest id.

    Rows meet by the MD5 of the text; rows of one hash are then compared by the text
    itself, so a hash collision never drops a row. Only (hash, count) crosses the
    network for texts that occur once: texts move only for hashes seen at least twice.
    If those hashes are too many to broadcast, a bitmap of fixed size keeps the other rows out
    of the shuffle. Of a hot text, each task sends one row. Texts are compared whole, however long.

    Null texts carry no content and are all kept. Empty texts are equal to each other.
    Rows repeated with the same id count as copies, one stays. Null ids sort last.
    All columns are returned unchanged, in their order; an empty table stays empty.
    """
    keyed = docs.withColumn(_H, F.md5(F.col(text_col)))
    twice = materialize(
        docs.select(F.md5(F.col(text_col)).alias(_H)).where(F.col(_H).isNotNull()).groupBy(_H).count().where("count > 1").select(_H),
        "exact-hashes",
    )
    first = Window.partitionBy(_H, text_col).orderBy(*_order(docs, id_col))
    if twice.count() * 96 <= broadcast_bytes:
        some = F.broadcast(twice)
        single = keyed.join(some, _H, "left_anti")
        copies = keyed.join(some, _H, "left_semi")
    else:
        keyed = mark_possible(keyed, twice, _H, "__xd_hit").withColumn("__xd_hit", F.col("__xd_hit") & F.col(_H).isNotNull())
        single = keyed.where("not __xd_hit")
        copies = keyed.where("__xd_hit")
    kept = copies.withColumn(_RN, F.row_number().over(first)).where(F.col(_RN) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return single.select(*columns).unionByName(kept.select(*columns))
