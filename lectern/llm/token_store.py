"""Token ids as a binary store: one zstandard frame for each document, one shared dictionary."""

from __future__ import annotations

import hashlib
import sys
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T

from lectern.llm.bpe import VOCABULARY, WINDOW, load_ranks, transducer
from lectern.session import bounded_batches, materialize, scratch_root

#: Serialized ids from which one partial dictionary is trained, and partial dictionaries that are merged at a time.
CHUNK_BYTES = 8 << 20
FAN_IN = 64


def pack(ids: list[int], width: int) -> bytes:
    """Little-endian unsigned ids of ``width`` bytes (2 or 4)."""
    out = array("H" if width == 2 else "I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{width}").astype(np.int32)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of at most ``size`` bytes; a raw-content one where training lacks data."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8, f=18, accel=4, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionary_of_all(tokens: DataFrame, size: int, chunk_bytes: int = CHUNK_BYTES, fan_in: int = FAN_IN) -> bytes:
    """One dictionary from the serialized ids (column ``ids``) of all rows.

    Each task trains a partial dictionary for every ``chunk_bytes`` of its ids; ``fan_in`` of them at a
    time are then cut into pieces that serve as samples for the next, until one is left. What a
    task holds is bounded, and only the last dictionary comes to the driver. Arrays longer than a chunk
    are taken in several pieces.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([train_dictionary(held, size)], pa.binary())], ["raw"])
        for batch in batches:
            for x in batch.column(0):
                x = x.as_py() or b""
                for i in range(0, len(x), 1 << 17):
                    held.append(x[i : i + (1 << 17)])
                    total += len(held[-1])
                    if total >= chunk_bytes:
                        yield out()
                        held, total = [], 0
        if total:
            yield out()

    def merged(key, table):
        samples = [raw[i : i + 1024] for raw in sorted(table.column("raw").to_pylist()) for i in range(0, len(raw), 1024)]
        return pa.table({"raw": pa.array([train_dictionary(samples, size)], pa.binary())})

    level = materialize(tokens.select("ids").mapInArrow(partial, "raw binary"), "partial-dictionaries")
    while (n := level.count()) > 1:
        key = F.pmod(F.xxhash64("raw"), F.lit(-(-n // fan_in))).alias("part")
        level = materialize(level.withColumn("part", key).groupBy("part").applyInArrow(merged, "raw binary"), "partial-dictionaries")
    return level.head()[0] if n else b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_tokens(
    docs: DataFrame,
    root: str | None = None,
    vocabulary: str = VOCABULARY,
    dictionary_bytes: int = 1 << 16,
    level: int = 3,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """Write every document's ids below ``root``; the index ``(doc_id, shard, offset, length, n_tokens, width, dict_hash)``.

    Texts are encoded once and their serialized ids written to a scratch table; the dictionary is trained on
    all of them (``dictionary_of_all``) and lies beside the shards under its SHA-256, which every row names.
    Every task writes one shard under a new name, so that a
    task run twice leaves an unused file but no wrong row. The index is written, too, and
    read back: the shards are made once. ``root`` must be a folder that all executors
    share; the default lies in ``spark.checkpoint.dir``.

    Null texts have a row with nothing but the id, dictionary and width; empty texts have
    a frame of no ids. Ids may be null or repeated: each row has its own frame. Long texts are encoded window by
    window and are one frame. Other columns are ignored, whatever their names. An empty table gives an empty index.
    """
    root = root or f"{scratch_root(docs.sparkSession)}/lectern-tokens-{uuid.uuid4().hex}"
    width = 2 if max(load_ranks(vocabulary).values()) < 1 << 16 else 4
    source = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary, WINDOW)
        for whole in batches:
            for n in range(0, whole.num_rows, 512):
                batch = whole.slice(n, 512)
                raw = [None if x is None else pack(t.encode(x), width) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "ids"])

    tokens = materialize(source.mapInArrow(encode, T.StructType([kind, T.StructField("ids", T.BinaryType())])), "token-ids")
    raw = dictionary_of_all(tokens, dictionary_bytes)
    digest = hashlib.sha256(raw).hexdigest()
    target, base = fs.FileSystem.from_uri(root)
    target.create_dir(base, recursive=True)
    with target.open_output_stream(f"{base}/{digest}.dict") as f:
        f.write(raw)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(root)
        shared, out = _dictionary(raw), None
        press = zstandard.ZstdCompressor(level=level, dict_data=shared) if shared else zstandard.ZstdCompressor(level=level)
        name, offset = f"{uuid.uuid4().hex}.tokens", 0
        try:
            for whole in batches:
                for n in range(0, whole.num_rows, 512):
                    batch = whole.slice(n, 512)
                    rows = []
                    for ids in batch.column(1).to_pylist():
                        if ids is None:
                            rows.append((None, None, None, None, width, digest))
                            continue
                        frame = press.compress(ids)
                        if out is None:
                            out = target.open_output_stream(f"{base}/{name}", compression=None)
                        out.write(frame)
                        rows.append((name, offset, len(frame), len(ids) // width, width, digest))
                        offset += len(frame)
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)
        finally:
            if out is not None:
                out.close()

    names = [id_col, "shard", "offset", "length", "n_tokens", "width", "dict_hash"]
    kinds = [kind.dataType, T.StringType(), T.LongType(), T.LongType(), T.IntegerType(), T.IntegerType(), T.StringType()]
    index = tokens.mapInArrow(write, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
    return materialize(index, "token-index").withColumn("root", F.lit(root))


class TokenReader:
    """Reads single documents by what their index row says, checking the dictionary's hash."""

    def __init__(self, root: str):
        self.files, self.base = fs.FileSystem.from_uri(root)
        self.open: dict[str, pa.NativeFile] = {}
        self.press: dict[str, zstandard.ZstdDecompressor] = {}

    def read(self, shard: str, offset: int, length: int, width: int, dict_hash: str) -> np.ndarray:
        if dict_hash not in self.press:
            with self.files.open_input_file(f"{self.base}/{dict_hash}.dict") as f:
                raw = f.read()
            if hashlib.sha256(raw).hexdigest() != dict_hash:
                raise ValueError("the dictionary isn't the one that the index names")
            shared = _dictionary(raw)
            self.press[dict_hash] = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
        if shard not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[shard] = self.files.open_input_file(f"{self.base}/{shard}")
        return unpack(self.press[dict_hash].decompress(self.open[shard].read_at(length, offset)), width)


def read_tokens(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, token_ids)`` of the rows of an index, or of any part of it; null where the text was."""
    names = [id_col, "token_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, TokenReader] = {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                reader = readers.setdefault(r["root"], TokenReader(r["root"]))
                out.append(None if r["shard"] is None else reader.read(r["shard"], r["offset"], r["length"], r["width"], r["dict_hash"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names)

    schema = T.StructType([index.schema[id_col], T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return index.select(id_col, "root", "shard", "offset", "length", "width", "dict_hash").mapInArrow(read, schema)
