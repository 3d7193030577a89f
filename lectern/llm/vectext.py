"""Vectorised text kernels shared by the operators: code points, word hashes, n-gram hashes.

All hashes are 64-bit, depend on the characters only and are the same in every worker.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are handled in groups of about this many characters, to bound the arrays.
GROUP_CHARS = 1 << 18

_POINTS = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection for each seed)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower case (if one code point), class (0 separator, 1 word, 2 a word by itself), hash."""
    lower = np.arange(_POINTS, dtype=np.uint32)
    kind = np.zeros(_POINTS, dtype=np.uint8)
    for i in range(0x20000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if c.isalnum():
            kind[i] = 1
        low = c.lower()
        if len(low) == 1:
            lower[i] = ord(low)
    for a, b in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)):
        kind[a : b + 1] = np.where(kind[a : b + 1] > 0, 2, 0)
    kind[0x20000:0x32000] = 2
    return lower, kind, mix(np.arange(_POINTS, dtype=np.uint64), 1)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(19, int(n + 1).bit_length())
    return _powers(size)


def groups(texts: Sequence[str | None], limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of at most ``limit`` characters each, or of one longer text."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def code_points(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a newline, and where each text begins."""
    whole = "\n".join([t or "" for t in texts]) + "\n"
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([(len(t) if t else 0) + 1 for t in texts], out=begins[1:])
    return points, begins


def prefix_hash(points: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences hash any span; see ``span_hash``."""
    out = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(_tables()[2][points] * powers(len(points))[0][: len(points)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    return mix((prefix[end] - prefix[begin]) * powers(len(prefix))[1][begin], seed)


def words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end (characters within the text) of each word, and each text's first word.

    A word is a run of letters and digits in any case; characters of scripts without
    spaces between words are words by themselves.
    """
    lower, kind, _ = _tables()
    points, begins = code_points(texts)
    k = kind[points]
    before = np.empty_like(k)
    before[0] = 0
    before[1:] = k[:-1]
    joined = (k == 1) & (before == 1)
    begin = np.flatnonzero((k > 0) & ~joined)
    after = np.empty_like(joined)
    after[-1] = False
    after[:-1] = joined[1:]
    end = np.flatnonzero((k > 0) & ~after) + 1
    h = span_hash(prefix_hash(lower[points]), begin, end)
    first = np.searchsorted(begin, begins)
    counts = np.diff(first)
    shift = np.repeat(begins[:-1], counts)
    return h, begin - shift, end - shift, first


def shingles(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-grams of one text's words; of all its words if there are fewer."""
    if len(word_hashes) == 0:
        return word_hashes
    m = max(1, len(word_hashes) - n + 1)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(min(n, len(word_hashes))):
        out += mix(word_hashes[j : j + m], j + 2)
    return mix(out, 7)


def give_back() -> None:
    """Return freed memory to the system at a task's end: an idle Python worker keeps what its last task held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
