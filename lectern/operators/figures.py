"""Figures, tables and algorithms of Markdown documents, and the rewrites that repair them.

Which lines belong together depends on what earlier lines consumed, so documents are scanned one by one in
Arrow batches; results are rows with ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from lectern.functions import rx as regex
from lectern.operators.markdown import PROTECTED, scan_blocks
from lectern.operators.relational import rows_of_texts

_ID = r"(?:s?\d+[a-z]?|[ivxlcdm]+[a-z]?)"
_CAPTIONS = [
    regex.compile(rf"((?:algorithm|chart|figure|fig\.?|scheme|table)[ \t]+{_ID}[.:：。])[ \t]+(\S.*)", regex.I | regex.S),
    regex.compile(rf"((?:图表|图)[ \t]*{_ID}[.:：。])[ \t]*(\S.*)", regex.I | regex.S),
    regex.compile(rf"(fig[.．][ \t]*{_ID}[.:：。]?)[ \t]*(\S.*)", regex.I | regex.S),
    regex.compile(rf"((?:图表|图)[ \t]*{_ID})[ \t]+(\S.*)", regex.I | regex.S),
]
_TABLE = regex.compile(rf"(table[ \t]+{_ID}[.:]?)(?:[ \t]+(\S.*))?", regex.I | regex.S)
_IMAGE = regex.compile(r"[ \t]*!\[((?:\\.|[^\]\\\n])*)\]\(([^\n]+)\)[ \t]*")
_RULE = regex.compile(r"\s*\|?(?:\s*:?-{3,}:?\s*\|)+(?:\s*:?-{3,}:?\s*)?")
_PANEL = regex.compile(r"[(（]\s*\p{L}\s*[)）].{0,80}", regex.S)


def image_of(line: str):
    """The match of a line that is an image."""
    return _IMAGE.fullmatch(line) if "![" in line else None


class Lines:
    """Lines of a document with offsets; those in code are blocked."""

    def __init__(self, text: str):
        self.text, self.rows, self.begin, at = text, text.split("\n"), [], 0
        for r in self.rows:
            self.begin.append(at)
            at += len(r) + 1
        self.blocked = set()
        for kind, b, e in scan_blocks(text):
            if kind == "code":
                self.blocked.update(k for k, i in enumerate(self.begin) if b <= i < e)

    def end(self, k: int) -> int:
        return self.begin[k] + len(self.rows[k])

    def near(self, k: int, blanks: int = 1) -> int | None:
        """The first line from ``k`` on that isn't blank, past at most so many blank ones; none in code."""
        stop = k + blanks
        while k < len(self.rows) and not self.rows[k].strip():
            if k == stop:
                return None
            k += 1
        return k if k < len(self.rows) and k not in self.blocked else None

    def images(self, k: int) -> list[int]:
        """Lines of images one after another, with at most one blank line between two."""
        out, at = [], self.near(k)
        while at is not None and image_of(self.rows[at]):
            out.append(at)
            at = self.near(at + 1)
        return out


def caption_of(line: str) -> tuple[str, str] | None:
    """Label and description of a figure's caption."""
    line = line.strip()
    if line[:1] not in "aAcCfFsSſtT图":
        return None
    for p in _CAPTIONS:
        m = p.fullmatch(line)
        if m:
            return m[1], m[2]
    return None


def table_caption_of(line: str) -> tuple[str, str] | None:
    m = _TABLE.fullmatch(regex.sub(r"^#{1,6}[ \t]+|\*\*", "", line.strip()).strip())
    return (m[1], m[2] or "") if m else None


def _alt(line: str) -> str:
    m = image_of(line)
    return regex.sub(r"\\([\\\[\]])", r"\1", m[1]) if m else ""


def tables(doc: Lines) -> Iterator[tuple[str, int, int]]:
    """``(kind, first line, last line)`` of pipe and HTML tables outside of code."""
    k = 0
    while k < len(doc.rows):
        row = doc.rows[k]
        if k not in doc.blocked and "|" in row and k + 1 < len(doc.rows) and _RULE.fullmatch(doc.rows[k + 1]):
            e = k + 1
            while e + 1 < len(doc.rows) and "|" in doc.rows[e + 1] and e + 1 not in doc.blocked:
                e += 1
            yield "pipes", k, e
            k = e
        elif k not in doc.blocked and regex.match(r"\s*<table[\s>]", row, regex.I):
            e = k
            while e < len(doc.rows) and not regex.search(r"</table\s*>", doc.rows[e], regex.I):
                e += 1
            if e < len(doc.rows):
                yield "html", k, e
                k = e
        k += 1


def misassigned(doc: Lines) -> list[tuple[int, int, int, int, str, str]]:
    """Tables followed by an image whose alt text is a table's caption, and then a figure's caption: ``(first, last, image, caption line, table caption, figure caption)``."""
    out = []
    for _, a, b in tables(doc):
        image = doc.near(b + 1)
        if image is None or not image_of(doc.rows[image]) or not table_caption_of(_alt(doc.rows[image])):
            continue
        below = doc.near(image + 1)
        if below is not None and caption_of(doc.rows[below]) and not table_caption_of(doc.rows[below]):
            out.append((a, b, image, below, _alt(doc.rows[image]), doc.rows[below].strip()))
    return out


def figures_of(text: str, doc: Lines | None = None) -> Iterator[tuple]:
    """``(begin, end, kind, label, description, images, layout)`` of figures: groups of images, and single images with a caption in their alt text."""
    doc = doc or Lines(text)
    moved = {image: below for _, _, image, below, _, _ in misassigned(doc)}
    used: set[int] = set()

    def row(first: int, last: int, kind: str, caption: tuple[str, str], images: list[int], layout: str = "") -> tuple:
        used.update(range(first, last + 1))
        return doc.begin[first], doc.end(last), kind, *caption, [doc.rows[i].strip() for i in images], layout

    k = 0
    while k < len(doc.rows):
        line, found = doc.rows[k], None
        if k in doc.blocked:
            k += 1
            continue
        images = doc.images(k) if image_of(line) else []
        if k in moved:
            found = row(k, moved[k], "moved", caption_of(doc.rows[moved[k]]), [k])
        elif len(images) > 1:
            inner = [caption_of(_alt(doc.rows[i])) for i in images]
            wide = [len(doc.rows[i]) - len(doc.rows[i].rstrip(" ")) for i in images[:-1]]
            own = [c for c in inner if c]
            ab = len(images) == 2 and len(own) == 1 and regex.search(r"[(（]\s*a\s*[)）]", own[0][1], regex.I) and regex.search(r"[(（]\s*b\s*[)）]", own[0][1], regex.I)
            below = doc.near(images[-1] + 1)
            if ab and wide == [3]:
                found = row(k, images[-1], "group", own[0], images, "vertical")
            elif ab and wide == [2]:
                found = row(k, images[-1], "group", own[0], images, "horizontal")
            elif below is not None and caption_of(doc.rows[below]):
                found = row(k, below, "group", caption_of(doc.rows[below]), images)
            elif below is not None and _PANEL.fullmatch(doc.rows[below].strip()):
                after = doc.near(below + 1)
                if after is not None and caption_of(doc.rows[after]):
                    found = row(k, after, "labelled", caption_of(doc.rows[after]), images)
        elif caption_of(line):
            below = doc.images(k + 1)
            if len(below) > 1:
                found = row(k, below[-1], "group", caption_of(line), below)
        if found:
            yield found
            k = max(used)
        k += 1
    for k, line in enumerate(doc.rows):
        if k not in used and k not in doc.blocked and image_of(line) and caption_of(_alt(line)):
            yield row(k, k, "single", caption_of(_alt(line)), [k])


def tables_of(text: str, doc: Lines | None = None) -> Iterator[tuple]:
    """``(begin, end, kind, label, description, table begin, table end)`` of tables with a caption: above, below, as a heading with its description in the next line, or in a misplaced image."""
    doc = doc or Lines(text)
    moved = {a: caption for a, _, _, _, caption, _ in misassigned(doc)}
    taken: set[int] = set()
    for kind, a, b in tables(doc):
        at = (doc.begin[a], doc.end(b))
        if a in moved:
            yield (*at, kind, *table_caption_of(moved[a]), *at)
            continue
        above = [k for k in range(a - 1, -1, -1) if doc.rows[k].strip()][:2]
        first = table_caption_of(doc.rows[above[0]]) if above and above[0] not in taken and a - above[0] <= 2 else None
        split = table_caption_of(doc.rows[above[1]]) if len(above) > 1 and not first and above[1] not in taken and above[0] - above[1] <= 2 and a - above[0] <= 2 else None
        below = doc.near(b + 1)
        last = table_caption_of(doc.rows[below]) if below is not None else None
        if first and first[1]:
            taken.add(above[0])
            yield doc.begin[above[0]], at[1], kind, *first, *at
        elif split and not split[1]:
            taken.update(above)
            yield doc.begin[above[1]], at[1], kind, split[0], doc.rows[above[0]].strip(), *at
        elif last and last[1]:
            taken.add(below)
            yield at[0], doc.end(below), kind, *last, *at


def algorithms_of(text: str, mark: str = "algorithm") -> Iterator[tuple[int, int, int, int]]:
    """``(begin, end, content begin, content end)`` of ``<div>`` blocks of that class; one with another ``<div>`` within is none."""
    doc, k = Lines(text), 0
    while k < len(doc.rows):
        m = regex.fullmatch(r"\s*<div\b[^>]*\bclass\s*=\s*[\"']([^\"']*)[\"'][^>]*>\s*", doc.rows[k], regex.I)
        if k not in doc.blocked and m and any(c == mark or c.endswith("-" + mark) for c in m[1].split()):
            e = k + 1
            while e < len(doc.rows) and not regex.search(r"</?div\b", doc.rows[e], regex.I):
                e += 1
            if e < len(doc.rows) and regex.fullmatch(r"\s*</div\s*>\s*", doc.rows[e], regex.I):
                yield doc.begin[k], doc.end(e), min(doc.end(k) + 1, len(text)), max(doc.begin[e] - 1, doc.end(k))
                k = e
        k += 1


def _edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    """``text`` after edits from the last to the first; one that reaches into the one before it is left out."""
    reach = len(text) + 1
    for b, e, new in sorted(edits, key=lambda x: -x[0]):
        if e <= reach:
            text, reach = text[:b] + new + text[e:], b
    return text


def captions_into_images(text: str) -> str:
    """Captions beside a single image without alt text are moved into it."""
    doc, edits = Lines(text), []
    pictures = {k for k, r in enumerate(doc.rows) if k not in doc.blocked and image_of(r)}
    for k in sorted(pictures):
        m = image_of(doc.rows[k])
        if m[1].strip():
            continue
        below = doc.near(k + 1)
        above = next((j for j in range(k - 1, max(k - 3, -1), -1) if doc.rows[j].strip()), None)
        for c in (below, above):
            if c is None or c in doc.blocked or not caption_of(doc.rows[c]):
                continue
            other = doc.near(c + 1) if c > k else next((j for j in range(c - 1, max(c - 3, -1), -1) if doc.rows[j].strip()), None)
            again = next((j for j in (k - 1, k - 2) if j in pictures), None) if c > k else (doc.near(k + 1) if doc.near(k + 1) in pictures else None)
            if again is not None or (other in pictures and other != k):
                continue
            alt = regex.sub(r"([\\\[\]])", r"\\\1", doc.rows[c].strip())
            new = f"![{alt}]({m[2]})"
            edits.append((min(doc.begin[k], doc.begin[c]), max(doc.end(k), doc.end(c)), new))
            break
    return _edited(text, edits)


def captions_reassigned(text: str) -> str:
    """A table's caption that stands in the next image goes above the table, the figure's caption into the image."""
    doc, edits = Lines(text), []
    for a, b, image, below, table_caption, figure_caption in misassigned(doc):
        alt = regex.sub(r"([\\\[\]])", r"\\\1", figure_caption)
        picture = f"![{alt}]({image_of(doc.rows[image])[2]})"
        edits.append((doc.begin[a], doc.end(below), table_caption + "\n\n" + text[doc.begin[a] : doc.end(b)] + "\n\n" + picture))
    return _edited(text, edits)


def without_algorithm_wrappers(text: str) -> str:
    return _edited(text, [(b, e, text[i:j]) for b, e, i, j in algorithms_of(text)])


def without_repeated_images(original: str, translated: str) -> str:
    """The translation without images that stand in the original, for a view of both."""
    image = regex.compile(r"!\[[^\]\n]*\]\(([^)\n]+)\)")
    known = {m[1] for m in image.finditer(original)}
    return regex.sub(r"\n{3,}", "\n\n", image.sub(lambda m: "" if m[1] in known else m[0], translated)).strip()


def rewrite(docs: DataFrame, f: Callable[[str], str], text: str = "text", out: str = "text") -> DataFrame:
    """``docs`` with ``f`` of the text; null stays null."""
    one = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else f(t)), T.StringType())
    return docs.withColumn(out, one(F.col(text)))


def figures(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return rows_of_texts(docs, doc, text, "begin_at int, end_at int, kind string, label string, description string, images array<string>, layout string", figures_of)


def captioned_tables(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return rows_of_texts(docs, doc, text, "begin_at int, end_at int, kind string, label string, description string, table_begin int, table_end int", tables_of)


def algorithms(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return rows_of_texts(docs, doc, text, "begin_at int, end_at int, content_begin int, content_end int", algorithms_of)


def label_key(label: str) -> str:
    """Comparison form of a figure's or table's label: kind and number in lower case."""
    m = regex.match(rf"(algorithm|chart|figure|fig|scheme|table|图表|图)[.．]?[ \t]*({_ID})", label.strip(), regex.I)
    return f"{'figure' if m[1].lower() == 'fig' else m[1].lower()} {m[2].lower()}" if m else ""


_MENTION = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:(figures?|figs?\.?|schemes?|charts?|tables?|algorithms?)[ \t]+({_ID}))(?![\p{{L}}\p{{N}}])", regex.I)


def mentions_of(text: str, objects: list[tuple] | None = None) -> Iterator[tuple[int, int, str, str]]:
    """``(begin, end, key, parent key)`` of labels named in prose; objects, code, links, images and tags don't count."""
    if objects is None:
        objects = [*figures_of(text), *tables_of(text)]
    ignored = [(r[0], r[1]) for r in objects] + [m.span() for m in PROTECTED.finditer(text)] + [m.span() for m in regex.finditer(r"\[[^\]\n]*\]\([^)\n]*\)", text)]
    for m in _MENTION.finditer(text):
        if not any(b <= m.start() < e for b, e in ignored):
            kind = regex.sub(r"s?\.?$", "", m[1].lower())
            kind = "figure" if kind == "fig" else kind
            number = m[2].lower()
            parent = regex.sub(r"(?<=\d)[a-z]$", "", number)
            yield m.start(), m.end(), f"{kind} {number}", f"{kind} {parent}" if parent != number else ""


def links_of(text: str) -> Iterator[tuple[int, int, int]]:
    """``(begin, end, target)``: mentions with the begin of the only object of their label, or of its parent if none has the label."""
    doc = Lines(text)
    objects = [*figures_of(text, doc), *tables_of(text, doc)]
    begins: dict[str, list[int]] = {}
    for begin, _, _, label, *_ in objects:
        begins.setdefault(label_key(label), []).append(begin)
    for b, e, key, parent in mentions_of(text, objects):
        found = begins.get(key) or (begins.get(parent, []) if parent else [])
        if len(found) == 1:
            yield b, e, found[0]


def labelled_links(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, begin_at, end_at, target)``: mentions of figures and tables with the begin of the only object of that label.

    A part such as 2b leads to figure 2, unless several objects have the label 2b. Each row of ``docs`` is a document of its own.
    """
    return rows_of_texts(docs, doc, text, "begin_at int, end_at int, target int", links_of)
