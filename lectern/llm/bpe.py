"""BPE encoding and decoding as streaming transducers of bounded memory."""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, types as T

from lectern.session import bounded_batches

#: Ranks of a public byte-level BPE vocabulary; every executor must see the file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters that the transducer takes at a time.
WINDOW = 1 << 11
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge_pairs(ranks: dict[bytes, int]) -> dict[bytes, tuple[bytes, bytes]]:
    """The two parts from which each token of more than one byte is merged."""
    out = {}
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = merge(token, ranks, rank)
            if len(parts) != 2:
                raise ValueError(f"no merge makes token {rank}")
            out[token] = (parts[0], parts[1])
    return out


def merge(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Tokens of one piece: merges applied by rank, the leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        at = best = None
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best) and (below is None or r < below):
                at, best = i, r
        if at is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after a token boundary that, once known, make the boundary final.

    Whether (x, y) merges can only be changed from the right by a merge of lower rank
    that takes y, or the last part of y at some level of its making, with what follows.
    That merge in turn can be changed by one of a still lower rank, and so on; the ranks
    fall along such a chain. The longest chain, measured in the bytes that it reaches
    over, is found by going through the merges in the order of rank.
    """
    pairs = merge_pairs(ranks)
    reach: dict[bytes, int] = {}
    most = 0
    for token in sorted(pairs, key=ranks.__getitem__):
        left, right = pairs[token]
        here, tail = reach.get(right, 0), right
        while tail in pairs:
            tail = pairs[tail][1]
            here = max(here, reach.get(tail, 0))
        here += len(right)
        reach[left] = max(reach.get(left, 0), here)
        most = max(most, here)
    return most


class Transducer:
    """Encoder that reads pieces of text and emits token ids as soon as they are final.

    Four kinds of boundary are final: white space after something else always begins a
    new pretoken; a pretoken is complete once ``GUARD`` characters after it are known;
    inside a longer pretoken a token is final once ``lookahead`` bytes after it are
    known; and the end of the text. Since every run of a BPE result is the BPE result of its text, encoding goes
    on from any final boundary as if the text began there. So at most two windows of
    characters are held, whatever the length of a text (more only if no boundary between characters is final).
    Texts of any length take this way. ``boundaries`` counts the kinds used.
    """

    GUARD = 3  # the longest pretoken of fixed text ('ll) has three characters

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, window: int = WINDOW):
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.table = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern)
        self.border = regex.compile(r"(?r)(?<=\S)\s")  # from the end
        self.lookahead = sufficient_lookahead(ranks)
        self.window = max(window, 64)
        self.boundaries = {"space": 0, "pretoken": 0, "lookahead": 0, "end": 0}

    def feed(self, pieces: Iterable[str]) -> Iterator[list[int]]:
        held, limit = "", self.window
        for piece in pieces:
            for i in range(0, len(piece), self.window):
                held += piece[i : i + self.window]
                while len(held) > limit:
                    ids, n = self._stable(held)
                    if n == 0:
                        limit = 2 * len(held)
                        break
                    yield ids
                    held, limit = held[n:], self.window
        if held:
            self.boundaries["end"] += 1
            yield self.core.encode_ordinary(held)

    def _stable(self, held: str) -> tuple[list[int], int]:
        """Ids of a final prefix of ``held`` and its length, 0 if nothing is final yet."""
        found = self.border.search(held, len(held) // 2)
        cut, kind = (found.start(), "space") if found else (0, "pretoken")
        if not cut:
            end = len(held) - self.GUARD
            for m in self.split.finditer(held):
                if m.end() > end:
                    break
                if not held[m.end() - 1].isspace():
                    cut = m.end()
        if cut:
            self.boundaries[kind] += 1
            return self.core.encode_ordinary(held[:cut]), cut
        ids = self.core.encode_ordinary(held)
        known = len(held.encode("utf-8", "surrogatepass")) - self.lookahead
        done, reader, read, out = 0, codecs.getincrementaldecoder("utf-8")("surrogatepass"), 0, (0, 0)
        for k, i in enumerate(ids):
            done += len(self.table[i])
            if done > known:
                break
            read += len(reader.decode(self.table[i]))
            if not reader.getstate()[0]:
                out = (k + 1, read)
        self.boundaries["lookahead"] += out[0] > 0
        return ids[: out[0]], out[1]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for ids in self.feed((text,)):
            out += ids
        return out


class Decoder:
    """Byte-to-text state machine: ids come in pieces, text goes out as its bytes complete."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = {i: b for b, i in ranks.items()}

    def feed(self, pieces: Iterable[list[int]], errors: str = "replace") -> Iterator[str]:
        reader = codecs.getincrementaldecoder("utf-8")(errors)
        get = self.table.get
        for ids in pieces:
            yield reader.decode(b"".join([get(i, b"\xef\xbf\xbd") for i in ids]))
        yield reader.decode(b"", True)

    def decode(self, ids: list[int], piece: int = 1 << 16) -> str:
        return "".join(self.feed(ids[i : i + piece] for i in range(0, len(ids), piece)))


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def transducer(path: str, window: int) -> Transducer:
    return Transducer(load_ranks(path), window=window)


def _fields(df: DataFrame, *new: tuple[str, T.DataType]) -> T.StructType:
    names = {n for n, _ in new}
    return T.StructType([f for f in df.schema if f.name not in names] + [T.StructField(n, t) for n, t in new])


def _place(batch: pa.RecordBatch, names: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(batch.schema.get_field_index(n)) for n in names], names)


def bpe_encode(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", vocabulary: str = VOCABULARY, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """``docs`` with the array of token ids in place of the text, and ``n_tokens``.

    A null text has null ids and null ``n_tokens``; an empty one has no ids. Texts are
    encoded whole, whatever their length, window by window. Repeated rows are encoded each. No row moves. A column of ``docs`` that has
    the name of an added column is replaced. An empty table stays empty.
    """
    docs = bounded_batches(docs)
    source = docs if keep_text else docs.withColumnRenamed(text_col, "__bpe_text")
    text = text_col if keep_text else "__bpe_text"
    schema = _fields(source, (ids_col, T.ArrayType(T.IntegerType())), ("n_tokens", T.IntegerType()))
    if not keep_text:
        schema = T.StructType([f for f in schema if f.name != "__bpe_text"])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary, window)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                ids = [None if x is None else t.encode(x) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                n = pa.array([None if x is None else len(x) for x in ids], pa.int32())
                yield _place(batch, names, {ids_col: pa.array(ids, pa.list_(pa.int32())), "n_tokens": n})

    return source.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, ids_col: str = "token_ids", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the text of ``ids_col`` in ``text_col`` (added or replaced).

    Null arrays give null texts. A null or unknown id and bytes that are no UTF-8 give U+FFFD.
    """
    df = bounded_batches(df)
    schema = _fields(df, (text_col, T.StringType()))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(load_ranks(vocabulary))
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                texts = [None if x is None else d.decode(x) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
                yield _place(batch, names, {text_col: pa.array(texts, pa.string())})

    return df.mapInArrow(run, schema)


def bpe_round_trip(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """What ``bpe_decode(bpe_encode(docs))`` gives, by one Python worker a task in place of two.

    The text is decoded from the ids that the encoder emitted, never copied from the input. Null, empty, long and
    repeated texts and clashing columns are treated as there.
    """
    docs = bounded_batches(docs)
    source = docs.withColumnRenamed(text_col, "__bpe_text")
    schema = _fields(source, (ids_col, T.ArrayType(T.IntegerType())), ("n_tokens", T.IntegerType()), (text_col, T.StringType()))
    schema = T.StructType([f for f in schema if f.name != "__bpe_text"])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, d = transducer(vocabulary, window), Decoder(load_ranks(vocabulary))
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                ids = [None if x is None else t.encode(x) for x in batch.column(batch.schema.get_field_index("__bpe_text")).to_pylist()]
                n = pa.array([None if x is None else len(x) for x in ids], pa.int32())
                texts = pa.array([None if x is None else d.decode(x) for x in ids], pa.string())
                yield _place(batch, names, {ids_col: pa.array(ids, pa.list_(pa.int32())), "n_tokens": n, text_col: texts})

    return source.mapInArrow(run, schema)
