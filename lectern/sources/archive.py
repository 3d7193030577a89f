"""Conversion archives: zip files with one full.md, layout blocks as JSON and images."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

IMAGES = re.compile(r"(?i)\.(gif|jpe?g|png|webp)\Z")
#: A list of blocks, with or without a prefix; names that end in a version, as in content_list_v2.json, are none.
BLOCKS = re.compile(r"(?i)(?:\A|/|_)content_list\.json\Z")
UNSTABLE = re.compile(r"(?i)content_list_v[0-9]+\.json\Z")
MIME = {"gif": "image/gif", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp"}


def is_stable_list(path: str) -> bool:
    return bool(BLOCKS.search(path)) and not UNSTABLE.search(path)


def open_archive(content: bytes, max_bytes: int = 256 << 20, max_blocks: int = 100_000, max_markdown: int = 32 << 20, max_list: int = 64 << 20, assets: bool = False) -> dict:
    """Markdown, layout blocks and image names of one archive; ``error`` says why there is none.

    There must be one ``full.md`` in any case of letters and at most one stable list of blocks, which must be an array of at most
    ``max_blocks`` objects. Sizes are taken from the directory, before anything is inflated: of the Markdown, of the list, and of
    the images in all. ``assets`` adds ``(path, mime, data)`` of the images.
    """
    out: dict = {"markdown": None, "blocks": None, "images": [], "error": None}
    if assets:
        out["assets"] = []
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        infos = [i for i in z.infolist() if not i.is_dir()]
        full = [i for i in infos if i.filename.rsplit("/", 1)[-1].lower() == "full.md"]
        lists = [i for i in infos if is_stable_list(i.filename)]
        images = sorted((i for i in infos if IMAGES.search(i.filename)), key=lambda i: i.filename)
        if len(full) != 1:
            raise ValueError(f"{len(full)} files full.md")
        if len(lists) > 1:
            raise ValueError(f"{len(lists)} lists of blocks")
        if full[0].file_size > max_markdown or any(i.file_size > max_list for i in lists) or sum(i.file_size for i in images) > max_bytes:
            raise ValueError("too large")
        blocks = None
        if lists:
            found = json.loads(z.read(lists[0]))
            if not isinstance(found, list) or len(found) > max_blocks or not all(isinstance(b, dict) for b in found):
                raise ValueError("the list of blocks is no array of objects, or too long")
            blocks = json.dumps([block(b) for b in found], ensure_ascii=False)
        text = z.read(full[0]).decode("utf-8")
        out |= {"markdown": text, "blocks": blocks, "images": [i.filename for i in images]}
        if assets:
            out["assets"] = [{"path": i.filename, "mime": MIME[i.filename.rsplit(".", 1)[-1].lower()], "data": z.read(i)} for i in images]
    except (ValueError, zipfile.BadZipFile, UnicodeDecodeError) as e:
        out |= {"error": str(e)}
    return out


def block(b: dict) -> dict:
    """A layout block in one shape for all types."""
    kind = str(b.get("type") or "")
    texts = lambda v: [str(x) for x in (v if isinstance(v, list) else [v]) if x]
    body = {"equation": b.get("text") or b.get("latex"), "table": b.get("table_body"), "code": b.get("code_body"), "list": "\n".join(texts(b.get("list_items"))), "chart": b.get("content")}.get(kind, b.get("text"))
    captions = texts(b.get(f"{kind}_caption"))
    return {"type": kind, "page_index": b.get("page_idx"), "bbox": b.get("bbox"), "text": str(body or ""), "asset_path": b.get("img_path"), "captions": captions}


def _read(spark: SparkSession, path: str, fields: str, rows_of) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([{"path": p} | r for p, c in zip(pdf["path"], pdf["content"]) for r in rows_of(c)], columns=names)

    return files.mapInPandas(run, fields)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(path, markdown, blocks, images, error)``: one row for each zip file."""
    return _read(spark, path, "path string, markdown string, blocks string, images array<string>, error string", lambda c: [open_archive(c)])


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """``(path, asset, mime, data)``: the images of the archives that are in order."""
    rows = lambda c: [{"asset": a["path"], "mime": a["mime"], "data": a["data"]} for a in open_archive(c, assets=True)["assets"]]
    return _read(spark, path, "path string, asset string, mime string, data binary", rows)


def documents(archives: DataFrame, revisions: DataFrame, plain: DataFrame) -> DataFrame:
    """``(path, markdown, origin)``: the user's revision, else the converted text, else the plain text, else none."""
    both = archives.select("path", "markdown").join(revisions.select("path", F.col("markdown").alias("__r")), "path", "full").join(plain.select("path", F.col("text").alias("__p")), "path", "full")
    origin = F.when(F.col("__r").isNotNull(), "revision").when(F.col("markdown").isNotNull(), "converted").when(F.col("__p").isNotNull(), "plain").otherwise("none")
    return both.select("path", F.coalesce("__r", "markdown", "__p").alias("markdown"), origin.alias("origin"))


def annotations(found: DataFrame, most: int = 5000, chars: int = 2_000_000) -> DataFrame:
    """Highlights and underlines with text in their order, as ``n``; a document with too many, or too much text, is an error."""
    rows = found.where(F.col("type").isin("highlight", "underline") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    n = rows.groupBy("doc_id").agg(F.assert_true((F.count("*") <= most) & (F.sum(F.length("text")) <= chars), F.lit("too many annotations")).alias("__ok"))
    w = Window.partitionBy("doc_id").orderBy("sort_index", F.col("page_index").asc_nulls_last(), "id")
    return rows.join(n, "doc_id").where("__ok is null").drop("__ok").withColumn("n", F.row_number().over(w) - 1)


BLOCK = "array<struct<type:string,page_index:int,bbox:array<double>,text:string,asset_path:string,captions:array<string>>>"


def content_blocks(archives: DataFrame) -> DataFrame:
    """``(path, ordinal, …)``: the layout blocks of ``read_archives``."""
    return archives.select("path", F.posexplode(F.from_json("blocks", BLOCK)).alias("ordinal", "b")).select("path", "ordinal", "b.*")
