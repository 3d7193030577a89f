"""Cache state: expiry, staleness, statistics, latest of each key."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def alive(df: DataFrame, accessed: str, now: Column, max_age_seconds: int) -> DataFrame:
    """Entries whose last access is at most ``max_age_seconds`` ago."""
    return df.where(F.unix_timestamp(now) - F.unix_timestamp(F.col(accessed).cast("timestamp")) <= max_age_seconds)


def stale(fetched: Column, positive: Column, now: Column, positive_seconds: int = 30 * 86400, negative_seconds: int = 7 * 86400) -> Column:
    age = F.unix_timestamp(now) - F.unix_timestamp(fetched.cast("timestamp"))
    return F.coalesce(age > F.when(positive, positive_seconds).otherwise(negative_seconds), F.lit(True))


def stats(df: DataFrame, size: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, by aggregation rather than by sorting whole groups."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def newest_variants(df: DataFrame, doc: str, variant: str, at: str, limit: int = 32) -> DataFrame:
    """The newest row of each document and variant, ``limit`` variants a document at most."""
    one = latest(df, [doc, variant], [at])
    w = Window.partitionBy(doc).orderBy(F.col(at).desc(), F.col(variant))
    return one.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def open_circuits(df: DataFrame, key: str, at: str, failed: str, failures: int = 2, seconds: int | None = None) -> DataFrame:
    """``(key, at, open)``: whether the last ``failures`` calls of a key, this one included, failed.

    With ``seconds`` (``at`` is then a time), a call within that time after the circuit opened finds it open, and is no call;
    when the time is over, counting starts anew. That depends on earlier decisions, so each key's calls are folded in order.
    """
    if seconds is None:
        w = Window.partitionBy(key).orderBy(at).rowsBetween(-(failures - 1), 0)
        return df.select(key, at, F.coalesce(F.sum(F.col(failed).cast("int")).over(w) == failures, F.lit(False)).alias("open"))
    rows = df.withColumn("__s", F.unix_micros(F.col(at).cast("timestamp")))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__s", "ascending")])
        out, run, until = [], 0, None
        for s, bad in zip(table.column("__s").to_pylist(), table.column(failed).to_pylist()):
            if until is not None and s < until:
                out.append(True)
                continue
            until = None
            run = run + 1 if bad else 0
            if run >= failures:
                run, until = 0, s + seconds * 1_000_000
            out.append(False)
        return table.select([key, at]).append_column("open", pa.array(out, pa.bool_()))

    return rows.groupBy(key).applyInArrow(fold, T.StructType([df.schema[key], df.schema[at], T.StructField("open", T.BooleanType())]))


def touched(entries: DataFrame, reads: DataFrame, key: str, at: str) -> DataFrame:
    """Entries with ``at`` moved on to their last read, if that is later."""
    last = reads.groupBy(key).agg(F.max(at).alias("__at"))
    return entries.join(last, key, "left").withColumn(at, F.greatest(at, F.coalesce("__at", at))).drop("__at")


def split_corrupt(entries: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that hold to the rules, and the others, which count as misses and are to be deleted."""
    good = F.coalesce(valid, F.lit(False))
    return entries.where(good), entries.where(~good)


def lookup(requests: DataFrame, entries: DataFrame, key: str, alive_if: Column) -> DataFrame:
    """Requests with the live entry of their key and ``hit``."""
    return requests.join(entries.where(alive_if).withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def newest_tasks(tasks: DataFrame, at: str, key: str, now: Column, max_age_seconds: int = 86400, limit: int = 256) -> DataFrame:
    """Pending tasks that are not too old, the newest ``limit``."""
    return alive(tasks, at, now, max_age_seconds).orderBy(F.col(at).desc(), F.col(key)).limit(limit)


def resume(requests: DataFrame, active: DataFrame, pending: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """``action`` for each distinct request: join the active run, poll the pending task, read the cache, or submit anew."""
    has = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    found = requests.dropDuplicates([key]).join(has(active, "__a"), key, "left").join(has(pending, "__p"), key, "left").join(has(cached, "__c"), key, "left")
    action = F.when(F.col("__a"), "join").when(F.col("__p"), "poll").when(F.col("__c"), "cached").otherwise("submit")
    return found.withColumn("action", action).drop("__a", "__p", "__c")


def compare_and_delete(tasks: DataFrame, done: DataFrame, key: str, batch: str) -> DataFrame:
    """Tasks without those that are done and still belong to the same batch."""
    return tasks.join(done.select(key, batch).distinct(), [key, batch], "left_anti")
