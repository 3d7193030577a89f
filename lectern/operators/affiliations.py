"""Front matter of scholarly documents: where the body begins, affiliations and the marks that name them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from lectern.functions import rx as regex
from lectern.operators.citations import _MAIN, _RAISED_RUN, _SECTION, _WRAPPED, _LOWERED, plain, superscripts
from lectern.operators.relational import rows_of_texts

#: Where front matter ends at the latest, if no heading says so.
FALLBACK = 5000
_HEAD = regex.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$", regex.M)
_FRONT = regex.compile(r"(?:authors?(?:[ \t]+(?:details?|information))?|(?:institutional[ \t]+)?affiliations?|institutions?|departments?|correspond(?:ence|ing[ \t]+authors?)|contact[ \t]+information|keywords?|作者(?:信息|单位)?|(?:所属)?机构|通讯作者|关键词)", regex.I)
_KEY = regex.compile(r"([*†‡§¶#+‖]*)(\d+|\p{L})([*†‡§¶#+‖]*)")


def body_start(text: str) -> int:
    """Offset of the first heading of the main text, or of the first that is neither a title, nor front matter, nor references; else at most ``FALLBACK``."""
    main = _MAIN.search(text)
    heads = list(_HEAD.finditer(text))
    title = True
    for h in heads:
        if main and h.start() >= main.start():
            break
        title = title and len(h[1]) == 1
        if not title and not _FRONT.fullmatch(regex.sub(r"[*_]", "", h[2]).strip()) and not _SECTION.match(h[0]):
            return h.start()
    if main:
        return main.start()
    return min(len(text), FALLBACK) if heads and len(heads[0][1]) == 1 else 0


def mark_key(label: str) -> str | None:
    """Number or letter of a mark such as ``1*`` or ``†a``; None if it has neither."""
    m = _KEY.fullmatch(label.strip())
    return m[2].lower() if m else None


def affiliations_of(text: str) -> list[tuple[str, str, int, int]]:
    """``(key, text, begin, end)``: paragraphs of the front matter that begin with a raised key, or plain lines lettered in sequence.

    A key defined again keeps its place and takes the later text.
    """
    end, found = body_start(text) or min(len(text), FALLBACK), {}
    for p in regex.finditer(r"\S.*?(?=\r?\n[ \t]*\r?\n|\Z)", text[:end], regex.S):
        marks = [m for pattern in (*_WRAPPED, _RAISED_RUN) for m in pattern.finditer(p[0])]
        marks = sorted(((m.start(), m.end(), (m[1] if m.re is not _RAISED_RUN else m[0]).translate(_LOWERED)) for m in marks))
        if not marks or marks[0][0] > 0:
            continue
        for n, (i, j, value) in enumerate(marks):
            key = mark_key(value)
            stop = marks[n + 1][0] if n + 1 < len(marks) else len(p[0])
            said = plain(p[0][j:stop]).strip(" ;,")
            if key and said:
                found[key] = (said, p.start() + i, p.start() + stop)
    if not found:
        wanted = sorted({mark_key(x[4]) for x in superscripts(text, 0, end, True) for _ in (0,) if mark_key(x[4]) and mark_key(x[4]).isalpha()})
        rows = [(m[1].lower(), m[2].strip(), m.start(), m.end()) for m in regex.finditer(r"^([A-Za-z])[ \t]+(\p{Lu}[^\n]+)$", text[:end], regex.M)]
        letters = [r[0] for r in rows]
        if wanted and letters == [chr(ord("a") + k) for k in range(len(letters))] and set(wanted) <= set(letters):
            found = {k: (t, b, e) for k, t, b, e in rows}
    return [(k, *v) for k, v in found.items()]


def author_marks_of(text: str) -> Iterator[tuple[int, int, str, str]]:
    """``(begin, end, key, affiliation)`` of raised marks before the first affiliation."""
    known = affiliations_of(text)
    if not known:
        return
    said = {k: t for k, t, *_ in known}
    for _, _, i, _, value in superscripts(text, 0, min(b for _, _, b, _ in known), True):
        for m in regex.finditer(r"[^,;，；\s]+", value):
            key = mark_key(m[0])
            if key in said:
                yield i + m.start(), i + m.end(), key, said[key]


def affiliations(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return rows_of_texts(docs, doc, text, "key string, affiliation string, begin_at int, end_at int", affiliations_of)


def author_affiliations(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, begin_at, end_at, key, affiliation)``: marks of authors with what they stand for."""
    return rows_of_texts(docs, doc, text, "begin_at int, end_at int, key string, affiliation string", author_marks_of)


def body_offsets(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return rows_of_texts(docs, doc, text, "body_at int", lambda t: [(body_start(t),)]).select(doc, F.col("body_at"))
