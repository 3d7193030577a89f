"""HTML extraction with wrappers: union-free regular expressions inferred per host.

A page is a stream of tags and text slots. Repetitions within a page become repeated groups: equal
neighbours of any length, and neighbouring elements of one tag and class whose contents differ,
which are aligned with one another. The different streams of a host are then aligned one after
another; where they differ, the mismatch is resolved into a repeated group, if one side has the
other's content over and over, or else into an optional one, until the wrapper accepts all of them.

An expression is a tuple of items: a string is a tag, ``TEXT`` a slot, ``("?", items)`` an
optional and ``("+", items)`` a repeated group.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.vectext import groups
from lectern.session import BROADCAST_BYTES, bounded_batches, materialize, small_or_shuffled

TEXT = "#"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Slots below these elements, or below an element of such a class, are no content.
CHROME = frozenset("head title nav footer aside form select script style noscript".split())
CHROME_CLASS = frozenset("ad ads advert advertisement banner breadcrumb comment-form cookie footer header menu nav navbar promo related share sidebar social sponsor".split())
#: Elements whose text stays in its line.
INLINE = frozenset(["a"])
#: Groups of up to so many tokens are looked for with regular expressions, longer ones by comparing the stream with itself.
SHORT_GROUP = 48
#: Cells of an alignment that weighs all choices; larger ones are first cut at a longest common subsequence.
CELLS = 1 << 12
#: Different streams of a host that one task aligns; more of them are aligned in parts first.
STREAMS = 128

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"<]*+\"|'[^'<]*+'|[^<>\"'])*+)>|<[!?][^>]*>|([^<]+)|(<)",
    re.S | re.I,
)
_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SQUARES = [re.compile(rf"(.{{{n}}})\1+", re.S) for n in range(1, SHORT_GROUP + 1)]


def tokens(page: str, places: list[tuple[int, int]] | None = None) -> tuple[list[str], list[str]]:
    """The stream of a page and the texts of its slots. Scripts, styles and comments go.

    ``places`` gets for each text the number of its line and of the white space before it.
    """
    stream, texts = [], []
    line = space = 0
    for m in _TOKEN.finditer(page):
        name = m.group(3)
        if name:
            name = name.lower()
            line += name not in INLINE
            if m.group(2):
                stream.append("/" + name)
            else:
                c = _CLASS.search(m.group(4)) if m.group(4) else None
                stream.append(name + "." + ".".join(sorted((c.group(1) or c.group(2) or c.group(3) or "").lower().split())) if c else name)
        elif m.group(5) or m.group(6):
            raw = html.unescape(m.group(0))
            t = " ".join(raw.split())
            space += raw[:1].isspace()
            if t:
                if stream and stream[-1] == TEXT:
                    texts[-1] += " " + t
                else:
                    stream.append(TEXT)
                    texts.append(t)
                    if places is not None:
                        places.append((line, space))
                space += raw[-1:].isspace()
    return stream, texts


def fold(stream: list) -> tuple:
    """``stream`` with adjacent equal groups as repeated groups, the shortest first, from the inside out."""
    items: dict = {}
    known: list = []

    def sign(x) -> str:
        if x not in items:
            items[x] = chr(0x100 + len(items) + (0x800 if len(items) > 0xD000 else 0))
            known.append(x)
        return items[x]

    line = "".join([sign(x) for x in stream])
    back = lambda s: tuple(known[i - 0x100 - (0x800 if i > 0xD800 else 0)] for i in map(ord, s))
    size = 1
    while size <= len(line) // 2:
        if size <= SHORT_GROUP:
            new = _SQUARES[size - 1].sub(lambda m: sign(("+", back(m.group(1)))), line)
            size, line = (size + 1, line) if new == line else (1, new)
            continue
        at = _long_square(line)
        if at is None:
            break
        i, n, times = at
        line, size = line[:i] + sign(("+", back(line[i : i + n]))) + line[i + n * times :], 1
    return plain(back(line))


def _long_square(line: str) -> tuple[int, int, int] | None:
    """Begin, length and number of the first shortest group above ``SHORT_GROUP`` that repeats at once."""
    s = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for n in range(SHORT_GROUP + 1, len(s) // 2 + 1):
        same = s[n:] == s[:-n]
        if np.count_nonzero(same) < n:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        run = edge[1::2] - edge[::2]
        hit = np.flatnonzero(run >= n)
        if len(hit):
            return int(edge[::2][hit[0]]), n, int(run[hit[0]]) // n + 1
    return None


def siblings(items: tuple) -> tuple:
    """``items`` with neighbouring elements of one tag and class and with like contents as one repeated group.

    Elements are what lies between a tag and its end tag on the same level; where tags don't
    match up, items stay as they are.
    """
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    for x in items:
        if isinstance(x, tuple):
            stack[-1][1].append(((x[0], siblings(x[1])),))
        elif x == TEXT or x.split(".")[0] in VOID:
            stack[-1][1].append((x,))
        elif x[0] != "/":
            stack.append((x, []))
        elif len(stack) > 1 and stack[-1][0].split(".")[0] == x[1:]:
            tag, inner = stack.pop()
            stack[-1][1].append((tag, _neighbours(inner), x))
        else:
            return items
    if len(stack) > 1:
        return items
    return plain(_neighbours(root))


def _neighbours(parts: list[tuple]) -> tuple:
    """Parts in a row; a part is one item, or ``(tag, inner, end tag)``."""
    out: list = []
    runs: list[list] = []
    for p in parts:
        element = _element(p)
        if element and runs and runs[-1][0] == element[0] and _alike(runs[-1][1][-1][1], element[1]):
            runs[-1][1].append(element)
        else:
            runs.append([element[0] if element else None, [element or p]])
    for tag, some in runs:
        if tag is None:
            for p in some:
                out.extend(p)
        elif len(some) == 1 and not some[0][2]:
            out.extend((tag, *some[0][1], some[0][3]))
        else:
            inner = some[0][1]
            for other in some[1:]:
                if other[1] != inner:
                    inner = merge(inner, other[1])
            out.append(("+", (tag, *inner, some[0][3])))
    return tuple(out)


def _alike(a: tuple, b: tuple) -> bool:
    return a == b or 2 * len(common_items(a, b)) >= max(len(a), len(b))


def _element(p: tuple) -> tuple | None:
    """``(tag, inner, repeated, end tag)`` of a part that is one element or a repeated group of one."""
    if len(p) == 3 and isinstance(p[1], tuple) and isinstance(p[0], str):
        return p[0], p[1], False, p[2]
    x = p[0]
    if len(p) == 1 and isinstance(x, tuple) and x[0] == "+" and len(x[1]) >= 2 and isinstance(x[1][0], str) and isinstance(x[1][-1], str):
        tag, end = x[1][0], x[1][-1]
        if tag[0] != "/" and end == "/" + tag.split(".")[0] and not any(isinstance(y, str) and y.split(".")[0] in (tag.split(".")[0], end) for y in x[1][1:-1]):
            return tag, x[1][1:-1], True, end
    return None


def plain(items: tuple) -> tuple:
    """Without groups that say nothing: ((x)+)+, ((x)?)? and the like."""
    out = []
    for x in items:
        if isinstance(x, tuple):
            inner = plain(x[1])
            if not inner:
                continue
            if len(inner) == 1 and isinstance(inner[0], tuple):
                kinds = {x[0], inner[0][0]}
                if len(kinds) == 1:
                    x = inner[0]
                else:
                    x = ("?", (("+", inner[0][1]),))
            else:
                x = (x[0], inner)
        out.append(x)
        if isinstance(x, tuple) and x[0] == "+" and len(out) > 1 and out[-2] == x:
            out.pop()
    return tuple(out)


def merge(a: tuple, b: tuple) -> tuple:
    """An expression that accepts what ``a`` or ``b`` accepts, aligned for the most in common.

    Equal items cost nothing, a group also meets its own content (once, or under another
    group); what has no partner becomes optional.
    """
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    head, tail = a[:begin], a[len(a) - end :]
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if not a or not b:
        return plain(head + _optional(a or b) + tail)
    if len(a) * len(b) <= CELLS:
        return plain(head + _align(a, b) + tail)
    out, i, j = [], 0, 0
    for p, q in [*common_items(a, b), (len(a), len(b))]:
        if p > i and q > j and (p - i) * (q - j) <= CELLS:
            out.extend(_align(a[i:p], b[j:q]))
        else:
            out.extend(_optional(a[i:p]) + _optional(b[j:q]))
        out.extend(a[p : p + 1])
        i, j = p + 1, q + 1
    return plain(head + tuple(out) + tail)


def common_items(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of ``a`` and ``b``.

    Rows of the table are bit vectors, one addition each; tables of over 2^31 bits are split in halves first.
    """
    if not a or not b:
        return []
    if len(a) * len(b) > 1 << 31 and len(a) > 1:
        half = len(a) // 2
        up = np.cumsum(np.append(0, 1 - _bits(_lcs_rows(a[:half], b)[-1], len(b))))
        down = np.cumsum(np.append(0, 1 - _bits(_lcs_rows(a[half:][::-1], b[::-1])[-1], len(b))))[::-1]
        cut = int((up + down).argmax())
        return common_items(a[:half], b[:cut]) + [(half + i, cut + j) for i, j in common_items(a[half:], b[cut:])]
    rows = _lcs_rows(a, b, True)
    out, j = [], len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        while j >= 0 and (rows[i + 1] >> j) & 1:  # this column adds nothing to the row
            j -= 1
        if j < 0:
            break
        if (rows[i] >> j) & 1:  # the row above has less up to here: a match
            out.append((i, j))
            j -= 1
    return out[::-1]


def _lcs_rows(a: tuple, b: tuple, keep: bool = False) -> list[int]:
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return rows if keep else [v]


def _bits(v: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(v.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n].astype(np.int64)


def _align(a: tuple, b: tuple) -> tuple:
    """The cheapest of all alignments, by a table of all pairs of places."""
    n, m = len(a), len(b)
    cost = [[0.0] * (m + 1) for _ in range(n + 1)]
    step: list[list] = [[None] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            if i == n and j == m:
                continue
            best = None
            if i < n and j < m and a[i] == b[j]:
                best = (cost[i + 1][j + 1], 1, 1, a[i])
            else:
                for x, y, swap in ((a, b, False), (b, a, True)):
                    p, q = (j, i) if swap else (i, j)
                    if p >= len(x) or q >= len(y) or not isinstance(x[p], tuple):
                        continue
                    kind, inner = x[p]
                    options = []
                    if y[q : q + len(inner)] == inner:
                        options.append((0.3, len(inner), x[p]))
                    if isinstance(y[q], tuple) and (y[q][0] == kind or len(inner) == 1 or len(y[q][1]) == 1):
                        if y[q][1] == inner:
                            options.append((0.3, 1, plain((("?", (("+", inner),)),))[0]))
                        elif kind == y[q][0]:
                            common = len(set(inner) & set(y[q][1])) / max(len(set(inner) | set(y[q][1])), 1)
                            if common >= 0.5:
                                options.append((0.5 + len(inner) * (1 - common), 1, None))
                    if kind == "?" and len(inner) == 1 and isinstance(inner[0], tuple) and y[q : q + len(inner[0][1])] == inner[0][1]:
                        options.append((0.3, len(inner[0][1]), x[p]))
                    for c, k, result in options:
                        di, dj = (k, 1) if swap else (1, k)
                        total = c + cost[i + di][j + dj]
                        if best is None or total < best[0]:
                            best = (total, di, dj, result)
            for di, dj in ((1, 0), (0, 1)):
                if i + di <= n and j + dj <= m:
                    x = a[i] if di else b[j]
                    c = (0.2 if isinstance(x, tuple) and x[0] == "?" else 1.0) + cost[i + di][j + dj]
                    if best is None or c < best[0]:
                        best = (c, di, dj, _Alone(x))
            cost[i][j], step[i][j] = best[0], best
    out: list = []
    i = j = 0
    alone: list[list] = [[], []]

    def flush() -> None:
        for side in alone:
            out.extend(_optional(tuple(side)))
            side.clear()

    while i < n or j < m:
        _, di, dj, result = step[i][j]
        if isinstance(result, _Alone):
            alone[0 if di else 1].append(result.item)
        else:
            flush()
            out.append((a[i][0], merge(a[i][1], b[j][1])) if result is None else result)
        i, j = i + di, j + dj
    flush()
    return tuple(out)


class _Alone:
    def __init__(self, item):
        self.item = item


def _optional(items: tuple) -> tuple:
    """Runs of items as one optional group, without wrapping optional ones again."""
    out, run = [], []
    for x in items:
        if isinstance(x, tuple) and x[0] == "?":
            if run:
                out.append(("?", tuple(run)))
                run = []
            out.append(x)
        else:
            run.append(x)
    if run:
        out.append(("?", tuple(run)))
    return tuple(out)


class Wrapper:
    """Position automaton of an expression, determinised as streams are read."""

    def __init__(self, expression: tuple):
        self.leaf: list[str] = []
        self.follow: list[set[int]] = []
        first, last, empty = self._build(expression)
        self.begin, self.last, self.empty = frozenset(first), frozenset(last), empty
        self.slot = {p: k for k, p in enumerate(p for p, x in enumerate(self.leaf) if x == TEXT)}
        self.moves: dict = {}
        self.paths = self._paths()

    def _build(self, items: tuple) -> tuple[set, set, bool]:
        first, last, empty = set(), set(), True
        for x in items:
            if isinstance(x, tuple):
                f, e, n = self._build(x[1])
                if x[0] == "+":
                    for p in e:
                        self.follow[p] |= f
                else:
                    n = True
            else:
                self.leaf.append(x)
                self.follow.append(set())
                f, e, n = {len(self.leaf) - 1}, {len(self.leaf) - 1}, False
            for p in last:
                self.follow[p] |= f
            if empty:
                first |= f
            last = last | e if n else set(e)
            empty = empty and n
        return first, last, empty

    def _paths(self) -> list[tuple[str, ...]]:
        """The open elements at each slot, as the wrapper writes them."""
        out, stack = [], []
        for x in self.leaf:
            if x == TEXT:
                out.append(tuple(stack))
            elif x[0] == "/":
                names = [t.split(".")[0] for t in stack]
                if x[1:] in names:
                    del stack[len(names) - 1 - names[::-1].index(x[1:]) :]
            else:
                name = x.split(".")[0]
                if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and any(t.split(".")[0] == name for t in stack):
                    names = [t.split(".")[0] for t in stack]
                    at = len(names) - 1 - names[::-1].index(name)
                    if not any(n in ("ul", "ol", "table", "div", "select", "dl") for n in names[at + 1 :]):
                        del stack[at:]
                if name not in VOID:
                    stack.append(x)
        return out

    def read(self, stream: list[str]) -> list[int] | None:
        """Slot of each text of ``stream``; None if it isn't accepted. Of several readings the first slot counts."""
        now, at, out = None, self.begin, []
        moves, leaf, follow = self.moves, self.leaf, self.follow
        for x in stream:
            key = (at, x)
            got = moves.get(key)
            if got is None:
                hit = frozenset(p for p in at if leaf[p] == x)
                got = moves[key] = (hit, frozenset().union(*(follow[p] for p in hit)), min((self.slot[p] for p in hit), default=0) if x == TEXT else 0)
            now, at, slot = got
            if not now:
                return None
            if x == TEXT:
                out.append(slot)
        return out if (now & self.last if now else self.empty) else None


def unfold(items: tuple) -> list[str]:
    """The shortest stream without optional groups left out: each group once."""
    return [y for x in items for y in (unfold(x[1]) if isinstance(x, tuple) else [x])]


def infer(streams: list[tuple]) -> tuple:
    """Wrapper of several folded streams, taken by length and then by value."""
    order = sorted(streams, key=lambda s: (len(s), json.dumps(s)))
    wrapper = order[0]
    for s in order[1:]:
        if s != wrapper:
            wrapper = merge(wrapper, s)
    return wrapper


def pattern(items: tuple) -> str:
    """The wrapper written as a regular expression over tags, ``#`` for a slot."""
    return "".join(f"({pattern(x[1])}){x[0]}" if isinstance(x, tuple) else TEXT if x == TEXT else f"<{x}>" for x in items)


def _tuples(x):
    return tuple(map(_tuples, x)) if isinstance(x, list) else x


def is_content(path: tuple[str, ...]) -> bool:
    for x in path:
        name, *classes = x.split(".")
        if name in CHROME or not CHROME_CLASS.isdisjoint(classes):
            return False
    return True


def _host(url_col: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", streams: int = STREAMS) -> DataFrame:
    """``(host, wrapper)``: one expression for each host, as JSON, that accepts all its pages.

    Pages are folded where they are read; only the different folded streams of a host
    are shuffled, each once. Hosts of more than ``streams`` different ones are aligned in
    parts of about that many, then the parts' wrappers in the same way, until each host has one.
    """
    source = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html"))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, seen = set(), set()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                stream = tokens(page.as_py() or "")[0]
                key = (host, "\0".join(stream))
                if key not in seen:
                    seen.add(key)
                    out.add((host, json.dumps(siblings(fold(stream)), separators=(",", ":"))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*sorted(out))], ["host", "wrapper"])

    def align_part(key, table):
        some = [_tuples(json.loads(s)) for s in table.column("wrapper").to_pylist()]
        text = json.dumps(infer(some), separators=(",", ":"))
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([text], pa.string())})

    found = materialize(source.mapInArrow(folded, "host string, wrapper string").distinct(), "streams")
    while True:
        parts = found.groupBy("host").agg(F.ceil(F.count("*") / F.lit(streams)).cast("int").alias("parts"))
        large = materialize(parts.where("parts > 1"), "large-hosts")
        if large.isEmpty():
            return found.groupBy("host").applyInArrow(align_part, "host string, wrapper string")
        keyed = found.join(F.broadcast(large) if large.count() * 256 <= BROADCAST_BYTES else large, "host", "left")
        keyed = keyed.withColumn("part", F.coalesce(F.pmod(F.xxhash64("wrapper"), F.col("parts")), F.lit(0)))
        found = materialize(keyed.groupBy("host", "part").applyInArrow(align_part, "host string, wrapper string").distinct(), "wrapper-parts")


def extract_pages(
    pages: DataFrame,
    page_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(page_id, host, title, text, n_slots, wrapper)``: one row for each page.

    The texts of a page go to the slots of its host's wrapper. A slot that holds the same text (in a
    repeated group: the same texts) on all pages of its host that have text is part of the template, if
    there are at least two different pages. ``text`` has the texts of the other slots, one a line
    but links in their line, without those in titles, navigation, forms, asides and
    footers, or in elements of such a class; ``title`` is the first text in a ``title`` element.

    A page with null html has null title and text; an empty one has an empty text. A null
    url, or one without a host, belongs to host ''. Repeated rows give
    repeated results. Long pages are read whole: streams of n and m tokens are aligned along a longest
    common subsequence, in n m / 64 steps. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    pages = bounded_batches(pages)
    wrappers = materialize(infer_wrappers(pages, url_col, html_col), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + 64)).head()[0] or 0
    source = pages.select(F.col(page_col).alias("page"), _host(url_col).alias("host"), F.col(html_col).alias("html"), F.xxhash64(html_col).alias("mark"))
    joined = source.join(F.broadcast(wrappers) if size <= broadcast_bytes else wrappers, "host").select("page", "host", "html", "wrapper", "mark")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        names = ["page", "host", "title", "fields", "sums", "n_slots", "pattern", "mark"]
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in groups(texts, 1 << 22):
                rows = []
                for page, host, text, w in zip(*(batch.column(c).slice(a, b - a) for c in range(4))):
                    key = w.as_py()
                    if key not in known:
                        if len(known) >= 256:
                            known.clear()
                        expression = _tuples(json.loads(key))
                        known[key] = Wrapper(expression)
                        known[key].pattern = pattern(expression)
                    wrapper = known[key]
                    if text.as_py() is None:
                        rows.append((None, None, None, len(wrapper.slot), wrapper.pattern))
                        continue
                    places: list = []
                    stream, found = tokens(text.as_py(), places)
                    slots = wrapper.read(stream)
                    if slots is None:
                        raise ValueError(f"the wrapper of {host.as_py()} doesn't accept one of its pages")
                    title = next((t for k, t in zip(slots, found) if any(x.split(".")[0] == "title" for x in wrapper.paths[k])), None)
                    fields = [{"slot": k, "text": t, "content": is_content(wrapper.paths[k]), "line": line, "space": space} for k, t, (line, space) in zip(slots, found, places)]
                    held: dict[int, list[str]] = {}
                    for k, t in zip(slots, found):
                        held.setdefault(k, []).append(t)
                    sums = [{"slot": k, "h": int.from_bytes(hashlib.blake2b("\0".join(ts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)} for k, ts in held.items()]
                    rows.append((title, fields, sums, len(wrapper.slot), wrapper.pattern))
                new = list(zip(*rows))
                kinds = (pa.string(), pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string()), ("content", pa.bool_()), ("line", pa.int32()), ("space", pa.int32())])), pa.list_(pa.struct([("slot", pa.int32()), ("h", pa.int64())])), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(c, k) for c, k in zip(new, kinds)), batch.column(4).slice(a, b - a)], names)

    kind = joined.schema["page"].dataType.simpleString()
    fields = joined.mapInArrow(read, f"page {kind}, host string, title string, fields array<struct<slot:int,text:string,content:boolean,line:int,space:int>>, sums array<struct<slot:int,h:bigint>>, n_slots int, pattern string, mark bigint")
    fields = materialize(fields, "page-fields")
    each = fields.select("host", F.explode("sums").alias("f"))
    counted = each.groupBy("host", F.col("f.slot").alias("slot")).agg(F.count("*").alias("pages"), F.min("f.h").alias("x"), F.max("f.h").alias("y"))
    # equal rows have equal slots: on all rows is on all different pages
    hosts = fields.where("size(fields) > 0").groupBy("host").agg(F.count("*").alias("all_pages"), F.min("mark").alias("p"), F.max("mark").alias("q")).where("p <> q")
    fixed = counted.where("x = y").join(small_or_shuffled(materialize(hosts, "hosts"), 128, broadcast_bytes), "host").where("pages = all_pages")
    fixed = materialize(fixed.groupBy("host").agg(F.sort_array(F.collect_set("slot")).alias("fixed")), "fixed-slots")
    kept = fields.join(small_or_shuffled(fixed, 256, broadcast_bytes), "host", "left")
    told = F.filter("fields", lambda f: f["content"] & ~F.coalesce(F.array_contains(F.col("fixed"), f["slot"]), F.lit(False)))
    kept = kept.withColumn("told", told)
    before = lambda i: F.get("told", i - 1)
    joint = lambda f, i: F.when(i == 0, "").when(f["line"] != before(i)["line"], "\n").when(f["space"] != before(i)["space"], " ").otherwise("")
    text = F.when(F.col("fields").isNotNull(), F.array_join(F.transform("told", lambda f, i: F.concat(joint(f, i), f["text"])), ""))
    return kept.select(F.col("page").alias(page_col), "host", "title", text.alias("text"), "n_slots", F.col("pattern").alias("wrapper"))
