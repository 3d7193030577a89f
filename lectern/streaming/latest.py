"""Streaming forms of the cache operators."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.cache import latest


#: Column that a bucket's number has while it is written; folders are read one by one, so that no column of the table clashes.
_BUCKET = "lectern_bucket"


def _buckets(path: str) -> dict[int, list[int]]:
    """Versions of each bucket below ``path/version=<version>/<_BUCKET>=<bucket>``, ascending."""
    files, base = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
    out: dict[int, list[int]] = {}
    for x in files.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
        if x.base_name.startswith(f"{_BUCKET}=") and x.type == fs.FileType.Directory:
            out.setdefault(int(x.base_name.rsplit("=", 1)[1]), []).append(int(x.path.rsplit("/", 2)[-2].rsplit("=", 1)[1]))
    return {k: sorted(v) for k, v in out.items()}


def upsert_latest(stream: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep the last row of each key of a stream in Parquet tables below ``path``, by buckets of the keys.

    Each batch rewrites only the buckets that it touches. A batch that runs again reads the same versions and
    overwrites the same folders, so that retries change nothing. Of each bucket the newest two versions are kept.
    Columns may have any name but ``lectern_bucket``; null keys are keys.
    """
    files, base = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        batch.persist()
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]
        held = {k: [v for v in vs if v < n] for k, vs in _buckets(path).items()}
        old = [f"{path}/version={held[k][-1]}/{_BUCKET}={k}" for k in touched if held.get(k)]
        both = batch if not old else batch.unionByName(spark.read.schema(batch.schema).parquet(*old))
        if touched:
            latest(both, keys, order).withColumn(_BUCKET, bucket).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/version={n}")
        batch.unpersist()
        for k, vs in _buckets(path).items():
            for v in vs[:-2]:
                files.delete_dir(f"{base}/version={v}/{_BUCKET}={k}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upsert_latest`` keeps: the newest version of each bucket."""
    return spark.read.parquet(*[f"{path}/version={vs[-1]}/{_BUCKET}={k}" for k, vs in sorted(_buckets(path).items())])


def single_flight(stream: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """Requests of a stream without those whose keys were asked for ``within`` that time before."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts by event-time window, closed once the watermark passes (an extra of this engine)."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).count()
