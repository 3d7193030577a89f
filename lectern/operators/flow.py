"""Repairs of converted documents along their source maps: text over page breaks, columns, figure panels.

Each repair is a list of edits of one document, so documents are handled one by one in Arrow batches. Entries are
dicts ``{type, md_from, md_to, locations: [{page_index, bbox}]}``; those that don't hold are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lectern.functions import rx as regex
from lectern.operators.figures import _edited, caption_of, captions_into_images
from lectern.operators.sourcemap import match_blocks
from lectern.session import spread, structs_of

_BLOCK = regex.compile(r"(?: {0,3}(?:#{1,6}(?:[ \t]|$)|>|(?:[-+*]|\d+[.)])[ \t]+|```|~~~)| {4}\S|\t\S|<|\$\$|\\\[|\\begin\{)")
_WORDS = regex.compile(r"\p{L}[\p{L}\p{N}'’-]*")


def _good(text: str, entries: list[dict]) -> list[dict]:
    box = lambda b: len(b) == 4 and all(0 <= x <= 1000 for x in b) and b[0] < b[2] and b[1] < b[3]
    fine = [e for e in entries if 0 <= e["md_from"] < e["md_to"] <= len(text) and e["locations"] and all(x["page_index"] >= 0 and box(x["bbox"]) for x in e["locations"])]
    return sorted(fine, key=lambda e: e["md_from"])


def _page(e: dict) -> int | None:
    pages = {x["page_index"] for x in e["locations"]}
    return pages.pop() if len(pages) == 1 else None


def text_flow(text: str, entries: list[dict], top: float = 220, words: int = 6) -> str:
    """A paragraph that goes on at the top of the next page, with charts between, is joined with its beginning."""
    rows, edits, used = _good(text, entries), [], set()
    of = lambda e: text[e["md_from"] : e["md_to"]]
    for n, e in enumerate(rows):
        page, said = _page(e), of(e).lstrip()
        if e["type"] != "text" or page is None or any(x["bbox"][1] > top for x in e["locations"]) or not said or regex.match(r"(?:#{1,6}(?:\s|$)|(?:[-+*]|\d+[.)])\s+|>\s|```|~~~|<)", said):
            continue
        gap = regex.search(r"(?:\r?\n[ \t]*){2}$", text[: e["md_from"]])
        for k in range(n - 1, -1, -1):
            a = rows[k]
            if a["type"] != "text" or a["md_to"] > e["md_from"] or _page(a) != page - 1 or k in used:
                continue
            between = rows[k + 1 : n]
            cuts = [a["md_to"], *(p for c in between for p in (c["md_from"], c["md_to"])), e["md_from"]]
            plain = all(not text[i:j].strip() for i, j in zip(cuts[::2], cuts[1::2]))
            charts = between and all(c["type"] == "chart" and _page(c) == page - 1 for c in between)
            end = of(a).rstrip()
            if plain and charts and gap and regex.search(r"(?:[+\-*/=<>≤≥≠]|[(\[{,;:])\s*$", end) and len(_WORDS.findall(end)) >= words:
                edits += [(a["md_from"], a["md_to"], end + " " + said), (gap.start(), e["md_to"], "")]
                used.add(k)
                break
    return _edited(text, edits)


def _start(e: dict) -> tuple:
    return min((x["page_index"], x["bbox"][1], x["bbox"][0]) for x in e["locations"])


def _box(e: dict) -> list[float]:
    return min(e["locations"], key=lambda x: (x["page_index"], x["bbox"][1], x["bbox"][0]))["bbox"]


def split_columns(boxes: list[list[float]], gap: float = 20, width: float = 180) -> float | None:
    """Where two columns part: the widest gap of ``gap`` or more with boxes of ``width`` or more on both sides."""
    best, where = 0.0, None
    rows = sorted(boxes, key=lambda b: b[0])
    for k in range(1, len(rows)):
        left, right = rows[:k], rows[k:]
        high, low = max(b[2] for b in left), min(b[0] for b in right)
        if low - high >= gap and low - high > best and all(min(b[2] - b[0] for b in side) >= width for side in (left, right)):
            best, where = low - high, (low + high) / 2
    return where


def column_runs(text: str, entries: list[dict]) -> list[list[dict]]:
    """Runs of prose on one page with nothing but white space between."""
    runs: list[list[dict]] = []
    last = None
    for e in _good(text, entries):
        said = text[e["md_from"] : e["md_to"]]
        prose = e["type"] == "text" and said.strip() and not _BLOCK.match(said)
        joined = last is not None and prose and last["md_to"] <= e["md_from"] and not text[last["md_to"] : e["md_from"]].strip() and min(x["page_index"] for x in last["locations"]) == min(x["page_index"] for x in e["locations"])
        if prose and joined:
            runs[-1].append(e)
        elif prose:
            runs.append([e])
        last = e if prose else None
    return [r for r in runs if len(r) > 1]


def column_flow(text: str, entries: list[dict]) -> str:
    """Prose of two columns in reading order; the separators between blocks stay in their places."""
    edits = []
    for run in column_runs(text, entries):
        cut = split_columns([_box(e) for e in run])
        column = lambda e: int(cut is not None and _box(e)[0] >= cut)  # noqa: B023, E731
        order = sorted(run, key=lambda e: (column(e), _start(e)[1], _start(e)[2], e["md_from"]))
        if order != run:
            gaps = [text[a["md_to"] : b["md_from"]] for a, b in zip(run, run[1:])] + [""]
            edits.append((run[0]["md_from"], run[-1]["md_to"], "".join(text[e["md_from"] : e["md_to"]] + g for e, g in zip(order, gaps))))
    return _edited(text, edits)


def pair_layout(a: list[float], b: list[float], labelled: bool = False, above: bool = False) -> str:
    """'horizontal', 'vertical' or '' for two boxes: overlap of 0.8, sizes alike to 0.75, a gap of -20 to 60."""
    def fits(i: int) -> bool:
        o = 1 - i
        overlap = min(a[o + 2], b[o + 2]) - max(a[o], b[o])
        size = lambda x, k: x[k + 2] - x[k]
        gap = max(a[i], b[i]) - min(a[i + 2], b[i + 2])
        return overlap / min(size(a, o), size(b, o)) >= 0.8 and all(min(size(a, k), size(b, k)) / max(size(a, k), size(b, k)) >= 0.75 for k in (0, 1)) and -20 <= gap <= 60

    return "horizontal" if fits(0) else "vertical" if labelled and above and fits(1) else ""


def panels(text: str, entries: list[dict], most: int = 64) -> str:
    """Charts without a caption stand beside their captioned partner on the page, if it is the only one that fits.

    Two trailing spaces mark a pair side by side, three a pair one above the other.
    """
    rows = _good(text, entries)
    picture = regex.compile(r"!\[((?:\\.|[^\]\\\n])*)\]\([^)\n]*\)")
    charts = [(e, m) for e in rows if e["type"] in ("chart", "image") and len(e["locations"]) == 1 and (m := picture.search(text, e["md_from"], e["md_to"]))]
    by_page: dict[int, list] = {}
    for e, m in charts:
        by_page.setdefault(_page(e), []).append((e, m))
    used, edits = set(), []
    for page, some in by_page.items():
        if len(some) > most:
            continue
        for e, m in some:
            if not caption_of(m[1]) or e["md_from"] in used:
                continue
            both = regex.search(r"[(（]\s*a\s*[)）]", m[1], regex.I) and regex.search(r"[(（]\s*b\s*[)）]", m[1], regex.I)
            box = e["locations"][0]["bbox"]
            fit = [(o, n, lay) for o, n in some if o is not e and o["md_from"] not in used and not n[1].strip() and (lay := pair_layout(box, o["locations"][0]["bbox"], bool(both), o["locations"][0]["bbox"][1] < box[1]))]
            if len(fit) != 1:
                continue
            o, n, lay = fit[0]
            a, b = sorted((e, o), key=lambda x: x["md_from"])
            between = [x for x in rows if a["md_to"] <= x["md_from"] and x["md_to"] <= b["md_from"]]
            ys = [e["locations"][0]["bbox"], o["locations"][0]["bbox"]]
            below = bool(between) and all(x["type"] == "text" and _page(x) == page and all(p["bbox"][1] >= max(y[3] for y in ys) for p in x["locations"]) for x in between)
            above = bool(between) and all(x["type"] == "text" and _page(x) == page and all(p["bbox"][3] <= min(y[1] for y in ys) for p in x["locations"]) for x in between)
            if (between and not (below or above)) or (lay == "vertical" and between) or text[a["md_to"] : b["md_from"]].strip() and not between:
                continue
            first, second = sorted((e, o), key=lambda x: x["locations"][0]["bbox"][0 if lay == "horizontal" else 1])
            said = lambda x: text[x["md_from"] : x["md_to"]].strip()
            joined = said(first) + (" " * (2 if lay == "horizontal" else 3)) + "\n" + said(second)
            stay, go = (b, a) if above else (a, b)
            gap = regex.search(r"(?:\r?\n[ \t]*){0,2}$", text[: go["md_from"]])
            edits += [(stay["md_from"], stay["md_to"], joined), (gap.start() if go is b else go["md_from"], go["md_to"] if go is b else go["md_to"] + len(regex.match(r"\s*", text[go["md_to"] :])[0]), "")]
            used |= {e["md_from"], o["md_from"]}
    return _edited(text, edits)


_BULLET = regex.compile(r"^[ \t]*(?:\\-|•)[ \t]+\S[^\r\n]*[ \t]*$")
_JOIN = regex.compile(r"[\p{L}\p{N}]$")
_REFERENCES = regex.compile(r"(?:#{1,6}[ \t]+)?[*_]{0,2}(?:references?|bibliography|works[ \t]+cited|literature[ \t]+cited|参考(?:文献|资料|书目))[*_]{0,2}[ \t]*[:：]?[ \t]*#*[ \t]*", regex.I)
_OTHER = regex.compile(r"(?: {0,3}(?:#{1,6}(?:[ \t]|$)|>|(?:[-+*]|\d+[.)])[ \t]+|```|~~~)| {4}\S|\t\S|<|\$\$|\\\[|\\begin\{|\[[^\]\n]+\]:)|(?i:(?:algorithm|chart|fig\.?|figure|scheme|table)[ \t]+(?:[a-z]?\d+[a-z]?|[ivxlcdm]+[a-z]?)\b|(?:doi|isbn|issn|pmcid?|url)\s*:)")


def is_other_block(block: str) -> bool:
    """Anything but prose: a heading, list, quote, code, table, caption, image or line of metadata."""
    images = [r.strip() for r in block.splitlines() if r.strip()]
    return bool(_OTHER.match(block) or regex.search(r"^\s*\|?(?:\s*:?-{3,}:?\s*\|)+(?:\s*:?-{3,}:?\s*)?$", block, regex.M) or regex.search(r"\r?\n[ \t]*(?:=+|-+)[ \t]*$", block) or (images and all(regex.fullmatch(r"!\[[^\]\n]*\]\(.+\)[ \t]*", r) for r in images)))


def continues(before: str, gap: str, after: str) -> bool:
    """Whether a blank line broke a sentence."""
    a, b = before.rstrip(), after.rstrip()
    if gap.count("\n") != 2 or not a.strip() or not b.strip() or is_other_block(a) or is_other_block(b) or len(_WORDS.findall(a)) < 6:
        return False
    depth = 0
    for c in a:
        depth = depth + 1 if c in "(（" else max(0, depth - 1) if c in ")）" else depth
    year = a.endswith(",") and depth > 0 and regex.match(r"(?:18|19|20)\d{2}[a-z]?[ \t]*[,;，；)]", b, regex.I)
    return bool((regex.match(r"\p{Ll}", b) or year) and (_JOIN.search(a) or year or (a.endswith(";") and regex.match(r"[^.!?]*;", b))))


def normalize(text: str) -> str:
    """Captions into images, runs of bullets as lists, broken sentences joined; nothing within references."""
    text = captions_into_images(text)
    parts = regex.split(r"(\r?\n[ \t]*\r?\n(?:[ \t]*\r?\n)*)", text)
    inside, flags = False, []
    for block in parts[::2]:
        if regex.match(r" {0,3}#{1,6}[ \t]", block) or _REFERENCES.fullmatch(block.strip()):
            inside = bool(_REFERENCES.fullmatch(regex.sub(r"\r?\n[ \t]*(?:=+|-+)[ \t]*$", "", block.strip()).strip()))
        flags.append(not inside and bool(_BULLET.match(block)))
    k = 0
    while k < len(flags):
        e = k
        while e + 1 < len(flags) and flags[k] and flags[e + 1] and parts[2 * e + 1].count("\n") == 2:
            e += 1
        if flags[k] and e > k:
            for j in range(k, e + 1):
                parts[2 * j] = regex.sub(r"^([ \t]*)(?:\\-|•)(?=[ \t])", r"\1-", parts[2 * j])
        k = e + 1
    out, refs = parts[0], bool(_REFERENCES.fullmatch(parts[0].strip()))
    for k in range(2, len(parts), 2):
        refs = refs or bool(_REFERENCES.fullmatch(parts[k].strip()))
        if not refs and continues(parts[k - 2], parts[k - 1], parts[k]):
            out = out.rstrip() + " " + parts[k].lstrip()
        else:
            out += parts[k - 1] + parts[k]
    return out


def prepare(text: str, blocks: list[dict], edited: bool = False) -> str:
    """A converted document after all repairs, each along a map of the text as it is then. What a user edited stays."""
    if edited:
        return text

    def entries() -> list[dict]:
        by = {b["ordinal"]: b for b in blocks}
        found: dict[tuple, dict] = {}
        for n, i, j, _ in match_blocks(text, blocks):
            e = found.setdefault((i, j), {"type": by[n]["type"], "md_from": i, "md_to": j, "locations": []})
            e["locations"].append({"page_index": by[n]["page_index"], "bbox": by[n]["bbox"]})
        return list(found.values())

    text = normalize(text)
    found = entries()
    flowed = text_flow(text, found)
    if flowed != text:
        text = flowed
        found = entries()
    text = column_flow(text, found)
    paired = panels(text, entries()) if any(b["type"] in ("chart", "image") for b in blocks) else text
    if paired != text:
        text = paired
        text = column_flow(text, entries())
    return text


def prepared(docs: DataFrame, blocks: DataFrame, doc: str = "doc_id", text: str = "markdown") -> DataFrame:
    """``(doc, markdown)`` of documents ``(doc, markdown, edited)`` with their content blocks; null Markdown stays null."""
    item = F.struct("ordinal", "type", "text", "asset_path", "page_index", "bbox")
    packed = spread(blocks, doc).groupBy(doc).agg(F.array_sort(F.collect_list(item)).alias("bs"))
    rows = spread(docs.select(doc, text, F.coalesce("edited", F.lit(False)).alias("edited")), doc).join(packed, doc, "left")
    schema = T.StructType([rows.schema[doc], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            md = [None if t is None else prepare(t, bs or [], edited) for t, edited, bs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), structs_of(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(md, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)
