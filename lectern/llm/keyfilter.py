"""A fixed-size bitmap of hashed keys, to keep rows that cannot join out of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the bitmap: 8 MB, whatever the number of keys. With n keys, a share of at most n / BITS of other rows passes.
BITS = 1 << 26
_PAGE = 32768  # bits in a value of bitmap_construct_agg


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def mark_possible(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """``df`` with ``flag``: false only if the row's ``key`` (a hash) is surely not among ``keys``.

    The bitmap's pages (2,048 of 4 KB) are broadcast: a bound on size, not on keys. Where
    there are so many keys that it fills up, flags are true and nothing is saved or lost.
    """
    slots = keys.select(_slot(F.col(key)).alias("s")).distinct()
    pages = slots.groupBy(F.floor(F.col("s") / _PAGE).cast("int").alias("__kf_page")).agg(F.bitmap_construct_agg(F.col("s") % _PAGE).alias("__kf_bits"))
    at = df.withColumn("__kf_slot", _slot(F.col(key))).withColumn("__kf_page", F.floor(F.col("__kf_slot") / _PAGE).cast("int"))
    bit = F.col("__kf_slot") % _PAGE
    byte = F.conv(F.hex(F.substring("__kf_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8).cast("int") + 1)) > 0, F.lit(False))
    joined = at.join(F.broadcast(pages), "__kf_page", "left").withColumn(flag, hit)
    return joined.select(*df.columns, flag)


def semi_possible(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` that may join ``keys`` by ``key``."""
    return mark_possible(df, keys, key, "__kf_hit").where("__kf_hit").drop("__kf_hit")
