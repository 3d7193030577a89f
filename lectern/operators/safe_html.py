"""Markdown as HTML from a fixed set of elements: nothing of the source reaches the output unescaped, in linear time.

Raw HTML is text, but for tables, which are rebuilt from allowed tags. Mathematics is kept as text in elements of
class ``math``, up to a number of expressions and characters; beyond that it stays plain text.
"""

from __future__ import annotations

import html
import re
from collections import deque

from pyspark.sql import DataFrame, functions as F, types as T

from lectern.operators.figures import caption_of, figures_of, tables_of
from lectern.operators.markdown import inline_math, scan_blocks
from lectern.operators.render import sanitize

#: Expressions and characters of mathematics in a document that are marked as such.
MATH, MATH_CHARS = 1000, 100_000
#: Size of a code block up to which its language is named.
CODE_CHARS, CODE_LINES = 50_000, 5_000

_TOKEN = re.compile(r"\\[!-/:-@\[-`{-~]|`+|!?\[(?P<label>[^\[\]\n]*)\]\((?P<url>[^()\s]*(?:\([^()\s]*\)[^()\s]*)?)(?:[ \t]+\"[^\"\n]*\")?\)|<(?P<auto>https?://[^\s<>]+)>|\*{1,3}|_{1,3}|~~")
_SAFE = re.compile(r"(?i)(?:https?://|#)")
_TAGS = {1: ("<em>", "</em>"), 2: ("<strong>", "</strong>"), 3: ("<em><strong>", "</strong></em>")}


def safe_url(url: str) -> str:
    url = re.sub(r"[\x00-\x1f\x7f]", "", html.unescape(url))
    return url if _SAFE.match(url) else ""


class Math:
    """What is left of a document's budget of mathematics."""

    def __init__(self, count: int = MATH, chars: int = MATH_CHARS):
        self.count, self.chars = count, chars

    def take(self, source: str, display: bool = False) -> str | None:
        self.count -= 1
        self.chars -= len(source)
        if self.count < 0 or self.chars < 0:
            return None
        tag = "div" if display else "span"
        return f'<{tag} class="math">{html.escape(source)}</{tag}>'


def inline(text: str, math: Math) -> str:
    """Text of one block: code, links, images, emphasis and mathematics, in one pass with a stack of open marks."""
    ranges = inline_math(text)
    closing: dict[str, deque[int]] = {}
    for m in re.finditer(r"`+", text):
        closing.setdefault(m.group(), deque()).append(m.start())
    out: list[str] = []
    opened: list[tuple[str, int]] = []  # marks and their places in ``out``
    at = k = 0
    size = len(text)
    while at < size:
        while k < len(ranges) and ranges[k][0] < at:
            k += 1
        stop = ranges[k][0] if k < len(ranges) else size
        m = _TOKEN.search(text, at, stop) if at < stop else None
        if m is None:
            out.append(html.escape(text[at:stop], quote=False))
            at = stop
            if k < len(ranges):
                b, e = ranges[k]
                body = text[b + 1 : e - 1] if text[b] == "$" else text[b + 2 : e - 2]
                out.append(math.take(body) or html.escape(text[b:e], quote=False))
                at = e
            continue
        out.append(html.escape(text[at : m.start()], quote=False))
        mark, at = m.group(), m.end()
        if mark[0] == "\\":
            out.append(html.escape(mark[1], quote=False))
        elif mark[0] == "`":
            places = closing[mark]
            while places and places[0] < at:
                places.popleft()
            if places:
                out.append(f"<code>{html.escape(text[at : places[0]].strip(), quote=False)}</code>")
                at = places[0] + len(mark)
            else:
                out.append(mark)
        elif m.group("url") is not None:
            label, url = html.escape(m.group("label"), quote=True), safe_url(m.group("url"))
            if mark[0] == "!":
                out.append(f'<img src="{html.escape(m.group("url"), quote=True)}" alt="{label}">' if re.fullmatch(r"(?!/)(?!.*\.\.)[\w./-]+", m.group("url")) else label)
            else:
                shown = inline(m.group("label"), math)
                out.append(f'<a href="{html.escape(url, quote=True)}" rel="noopener">{shown}</a>' if url else shown)
        elif m.group("auto"):
            url = html.escape(safe_url(m.group("auto")), quote=True)
            out.append(f'<a href="{url}" rel="noopener">{url}</a>')
        else:
            before, after = text[m.start() - 1 : m.start()], text[at : at + 1]
            inside = mark[0] == "_" and before.isalnum() and after.isalnum()
            held = next((i for i in range(len(opened) - 1, max(-1, len(opened) - 8), -1) if opened[i][0] == mark), None)
            if held is not None and before.strip() and not inside:
                place = opened[held][1]
                first, last = ("<del>", "</del>") if mark == "~~" else _TAGS[len(mark)]
                out[place] = first
                out.append(last)
                del opened[held:]
            else:
                if after.strip() and not inside:
                    opened.append((mark, len(out)))
                out.append(mark)
    return "".join(out)


def _table(block: str, math: Math) -> str:
    rows = [[c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"^\s*\||(?<!\\)\|\s*$", "", r))] for r in block.split("\n")]
    kinds = [("center" if c[0] + c[-1] == "::" else "right" if c[-1] == ":" else "left" if c[0] == ":" else "") if c else "" for c in rows[1]]
    width = len(rows[0])
    style = lambda n: f' align="{kinds[n]}"' if n < len(kinds) and kinds[n] else ""
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}{style(n)}>{inline(c, math)}</{tag}>" for n, c in enumerate((cells + [""] * width)[:width])) + "</tr>"
    return f"<table><thead>{line(rows[0], 'th')}</thead><tbody>{''.join(line(r, 'td') for r in rows[2:])}</tbody></table>"


def _list(block: str, math: Math) -> str:
    items = re.split(r"^ {0,3}(?:[-+*]|\d{1,9}[.)])[ \t]+", block, flags=re.M)[1:]
    tag = "ol" if re.match(r" {0,3}\d", block) else "ul"
    start = re.match(r" {0,3}(\d{1,9})", block)
    first = f' start="{int(start[1])}"' if start and int(start[1]) != 1 else ""
    return f"<{tag}{first}>" + "".join(f"<li>{inline(i.strip(), math)}</li>" for i in items) + f"</{tag}>"


def render_block(kind: str, block: str, math: Math, depth: int = 0) -> str:
    if kind == "heading":
        m = re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*#*[ \t]*\Z", block, re.S)
        level = len(m[1]) if m else 1 if re.search(r"\n {0,3}=+[ \t]*\Z", block) else 2
        said = (m[2] or "") if m else re.sub(r"\n {0,3}(?:=+|-+)[ \t]*\Z", "", block)
        return f"<h{level}>{inline(said, math)}</h{level}>"
    if kind == "code":
        m = re.match(r" {0,3}(`{3,}|~{3,})[ \t]*([\w+#.-]*)[^\n]*\n?(.*?)(?:\n {0,3}(?:`{3,}|~{3,})[ \t]*)?\Z", block, re.S)
        said = m[3] if m else re.sub(r"(?m)^(?: {4}|\t)", "", block)
        named = m and m[2] and len(said) <= CODE_CHARS and said.count("\n") < CODE_LINES
        return f"<pre><code{f' class=\"language-{html.escape(m[2].lower(), quote=True)}\"' if named else ''}>{html.escape(said, quote=False)}</code></pre>"
    if kind == "math":
        body = re.sub(r"\A\s*(?:\$\$|\\\[)|(?:\$\$|\\\])\s*\Z", "", block).strip()
        return math.take(body, True) or f"<p>{html.escape(block, quote=False)}</p>"
    if kind == "table":
        return sanitize(block) if re.match(r"\s*<table", block, re.I) else _table(block, math)
    if kind == "list":
        return _list(block, math)
    if kind == "rule":
        return "<hr>"
    if kind == "quote" and depth < 8:
        return f"<blockquote>{render(re.sub(r'(?m)^ {0,3}>[ \t]?', '', block), math, depth + 1)}</blockquote>"
    if kind == "html":
        return f"<p>{html.escape(block, quote=False)}</p>"
    return f"<p>{inline(block, math)}</p>"


def render(text: str, math: Math | None = None, depth: int = 0) -> str:
    """HTML of a Markdown text; figures and tables with a caption are ``figure`` elements."""
    math = math or Math()
    groups = []
    if not depth and "![" in text or re.search(r"(?im)^(?:#{1,6}[ \t]+|\*\*)?table[ \t]", text):
        groups = [(b, e, "figure", label, said, images) for b, e, _, label, said, images, _ in figures_of(text)] + [(b, e, "table", label, said, [text[i:j]]) for b, e, _, label, said, i, j in tables_of(text)]
    groups.sort()
    out, g, reach = [], 0, 0
    for kind, b, e in scan_blocks(text):
        if b < reach:
            continue
        while g < len(groups) and groups[g][1] <= b:
            g += 1
        if g < len(groups) and groups[g][0] <= b < groups[g][1]:
            _, reach, what, label, said, parts = groups[g]
            inner = "".join(inline(re.sub(r"!\[[^\]]*\]", "![]", p) if caption_of(re.sub(r"\A!\[|\]\(.*\Z", "", p)) else p, math) for p in parts) if what == "figure" else render_block("table", parts[0], math)
            out.append(f"<figure>{inner}<figcaption>{inline(f'{label} {said}'.strip(), math)}</figcaption></figure>")
            continue
        out.append(render_block(kind, text[b:e], math, depth))
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def markdown_html(s):
    return s.map(lambda t: None if t is None else render(t))


def rendered(docs: DataFrame, text: str = "text", out: str = "html") -> DataFrame:
    """``docs`` with the HTML of its Markdown; null stays null, an empty text is empty."""
    return docs.withColumn(out, markdown_html(F.col(text)))


def gfm_table(header: list[str], rows: list[list[str]], align: list[str] | None = None) -> str:
    """A pipe table; rows have the header's width, cells are escaped."""
    cell = lambda c: re.sub(r"\r?\n", "<br>", c.replace("|", "\\|")).strip()
    mark = {"left": ":---", "right": "---:", "center": ":---:"}
    line = lambda cells: "| " + " | ".join(cell(c) for c in (list(cells) + [""] * len(header))[: len(header)]) + " |"
    rule = "| " + " | ".join(mark.get(a, "---") for a in ((align or []) + [""] * len(header))[: len(header)]) + " |"
    return "\n".join([line(header), rule, *map(line, rows)])
