"""Stores as versioned Parquet tables: a new folder for each version, and a pointer that is replaced at once.

A reader sees the version that the pointer names; a writer that fails leaves the pointer as it was. One writer at a
time writes a store.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lectern.functions.records import is_safe_body

_POINTER = "current.json"


def _at(root: str) -> tuple[fs.FileSystem, str]:
    files, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    return files, base


def current(root: str) -> str | None:
    """Folder of the version that counts, None where there is none or the pointer can't be read."""
    files, base = _at(root)
    try:
        with files.open_input_stream(f"{base}/{_POINTER}") as f:
            return json.loads(f.read())["version"]
    except (FileNotFoundError, ValueError, KeyError, OSError):
        return None


def put(df: DataFrame, root: str, keep: int = 1) -> str:
    """Write ``df`` as the new version, then replace the pointer, then remove older versions but ``keep``."""
    files, base = _at(root)
    name = f"v-{uuid.uuid4().hex}"
    files.create_dir(base, recursive=True)
    df.write.parquet(f"{root}/{name}")
    before = current(root)
    with files.open_output_stream(f"{base}/.{name}.json") as f:
        f.write(json.dumps({"version": name, "before": before}).encode())
    files.move(f"{base}/.{name}.json", f"{base}/{_POINTER}")
    old = sorted((x for x in files.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.Directory and x.base_name.startswith("v-") and x.base_name not in (name, before)), key=lambda x: x.mtime)
    for x in old[: max(0, len(old) - max(0, keep - 1))]:
        files.delete_dir(x.path)
    return name


def get(spark: SparkSession, root: str) -> DataFrame | None:
    name = current(root)
    return spark.read.parquet(f"{root}/{name}") if name else None


def upsert(spark: SparkSession, rows: DataFrame, root: str, keys: list[str], at: str, limit: Column | None = None) -> str:
    """Rows of the store with those of ``rows``; of each key the newest by ``at`` counts. ``limit`` keeps rows that hold to it."""
    held = get(spark, root)
    both = rows if held is None else held.unionByName(rows)
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    newest = both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return put(newest if limit is None else newest.where(limit), root)


def variants(rows: DataFrame, doc: str = "doc_id", language: str = "language", at: str = "at", most: int = 32) -> DataFrame:
    """Of a document's translations the newest of each language, the newest ``most`` of them."""
    by = lambda *c: Window.partitionBy(*c).orderBy(F.col(at).desc(), language)
    one = rows.withColumn("__n", F.row_number().over(by(doc, language))).where("__n = 1")
    return one.withColumn("__n", F.row_number().over(by(doc))).where(F.col("__n") <= most).drop("__n")


def repaired(descriptors: DataFrame, doc: str = "doc_id", most: int = 32) -> DataFrame:
    """Valid descriptors ``(doc, ordinal, language, file)``: each language and each file once, the first, ``most`` at most."""
    rows = descriptors.where("coalesce(language, '') <> '' and coalesce(file, '') <> ''")
    for c in ("language", "file"):
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(doc, c).orderBy("ordinal"))).where("__n = 1").drop("__n")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(doc).orderBy("ordinal"))).where(F.col("__n") <= most).drop("__n")


def append_corrections(spark: SparkSession, rows: DataFrame, root: str, bases: DataFrame) -> str:
    """Append corrections ``(doc_id, block_id, base_hash, replacement, at)``; an error if one is for another base than the stored ``bases (doc_id, hash)``."""
    checked = rows.join(bases, "doc_id", "left").withColumn("__ok", F.assert_true(F.col("base_hash").eqNullSafe(F.col("hash")), F.lit("a correction is for another base")))
    held = get(spark, root)
    new = checked.where("__ok is null").drop("hash", "__ok")
    return put(new if held is None else held.unionByName(new), root)


def latest_corrections(rows: DataFrame, order: DataFrame) -> DataFrame:
    """The newest correction of each block, in the order of the blocks ``(doc_id, block_id, n)``."""
    newest = rows.groupBy("doc_id", "block_id").agg(F.max_by("replacement", "at").alias("replacement"))
    return newest.join(order, ["doc_id", "block_id"]).orderBy("doc_id", "n")


def manifest(title: Column, body: Column, assets: Column) -> Column:
    """JSON of an export: its version, title, the hash of its body and its assets' names, sorted."""
    return F.to_json(F.struct(F.lit(1).alias("version"), title.alias("title"), F.sha2(body, 256).alias("hash"), F.array_sort(F.array_distinct(assets)).alias("assets")))


def saved_note(title: Column, body: Column, assets: Column, most: int = 20 << 20) -> Column:
    """Exported body behind a marker that holds its manifest; an error for unsafe markup or over ``most`` bytes."""
    out = F.concat(F.lit('<div data-saved="'), F.url_encode(manifest(title, body, assets)), F.lit('"></div>\n'), body)
    return F.when(is_safe_body(body) & (F.octet_length(out) <= most), out).otherwise(F.raise_error(F.lit("the note is unsafe or too large")))


def read_note(note: Column) -> Column:
    """``struct(manifest, body, edited)`` of an exported note; nulls where there is no marker."""
    raw = F.regexp_extract(note, r'\A<div data-saved="([^"]*)"></div>\n', 1)
    m = F.from_json(F.when(raw != "", F.url_decode(raw)), "version int, title string, hash string, assets array<string>")
    body = F.when(raw != "", F.regexp_replace(note, r'\A<div data-saved="[^"]*"></div>\n', ""))
    return F.struct(m.alias("manifest"), body.alias("body"), (F.sha2(body, 256) != m["hash"]).alias("edited"))


def save_snapshots(notes: DataFrame, held: DataFrame) -> DataFrame:
    """``notes (doc_id, title, body, assets)`` with ``action`` and ``note``: refuse where the held note was edited, skip where nothing changed, else write."""
    h = held.select("doc_id", read_note(F.col("note")).alias("h"))
    both = notes.join(h, "doc_id", "left")
    action = F.when(F.col("h.edited"), "refuse").when(F.col("h.manifest.hash") == F.sha2("body", 256), "skip").otherwise("write")
    return both.withColumn("action", action).withColumn("note", F.when(F.col("action") == "write", saved_note(F.col("title"), F.col("body"), F.col("assets")))).drop("h")


def recovered(asked: DataFrame, cached: DataFrame, sources: DataFrame) -> DataFrame:
    """``(doc_id, markdown, origin)``: the cached text if its hash is the wanted one and its assets are all there, else the saved source, else none.

    ``asked`` is ``(doc_id, hash, assets)``, ``cached`` ``(doc_id, markdown, held_assets)``, ``sources`` ``(doc_id, source)``.
    """
    both = asked.join(cached, "doc_id", "left").join(sources, "doc_id", "left")
    good = F.coalesce((F.sha2("markdown", 256) == F.col("hash")) & (F.size(F.array_except("assets", "held_assets")) == 0), F.lit(False))
    return both.select("doc_id", F.when(good, F.col("markdown")).otherwise(F.col("source")).alias("markdown"), F.when(good, "cache").when(F.col("source").isNotNull(), "source").otherwise("none").alias("origin"))


def within_budget(rows: DataFrame, key: str, order: str, size: Column, most_rows: int, most_bytes: int) -> DataFrame:
    """Groups with ``over``: whether their rows or bytes exceed the limits."""
    return rows.groupBy(key).agg(((F.count("*") > most_rows) | (F.sum(size) > most_bytes)).alias("over"))
