"""Session helpers: shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side is broadcast only if its estimated size stays under this many bytes.
BROADCAST_BYTES = 32 << 20


def scratch_root(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder is made in local mode (tests);
    on a cluster that is an error, as executors could not read each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return sc.getCheckpointDir().rstrip("/")


#: Rows and bytes of one Arrow batch between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded for whole texts.

    The defaults (10,000 rows, 64 MB) are made for narrow rows: with texts, each side of a Python operator holds
    several such batches, outside of the heap. Settings that are lower already stay.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    held = conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m").lower().removesuffix("b")
    if held[-1:] in "mg" or int(held) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs the re-run of its own tasks, not of the
    stages behind the table.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many tasks as the session's shuffles have, rows of equal ``keys`` together.

    The tasks of a scan, and those of a shuffle that adaptive execution joins up, follow the compressed bytes: a few MB are
    one task, whatever their rows take in time or memory. These stay apart.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def structs_of(column: pa.ListArray) -> list[list[dict] | None]:
    """What ``to_pylist`` makes of lists of structs, field by field, which takes a fraction of its time."""
    held = column.values
    names = [f.name for f in held.type]
    rows = [dict(zip(names, r)) for r in zip(*(held.field(k).to_pylist() for k in range(len(names))))]
    at = column.offsets.to_pylist()
    return [rows[b:e] if there else None for b, e, there in zip(at, at[1:], column.is_valid().to_pylist())]


def small_or_shuffled(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of ``df`` if its counted rows fit in ``limit``; else leave it.

    ``df`` should be materialized: it is counted here. Beyond the limit the join stays
    a shuffle join, which spills and scales with the cluster.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
