"""Citations, source maps, figures, anchors, translation and stores on small inputs."""

import io
import random
import time
import unicodedata
import zipfile

import pytest
import regex
from pyspark.sql import functions as F

from lectern.functions import identifiers as I, records as R
from lectern.operators import safe_html as H, affiliations as FM, anchors as A, cache, citations as C, figures as G, flow as W, graph, layout as L, markdown as M, relational as REL, sourcemap as S, translation as TR
from lectern.sources import providers as P, store
from lectern.sources.archive import is_stable_list, open_archive


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def values(spark, rows, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_public_urls(spark):
    good = ["https://10.example.org/", "http://[2606:4700::1111]/x", "https://a.example:8080/x?y#z", "http://172.32.0.1/", "http://999.1.1.1/"]
    bad = ["http://100.64.0.1/", "http://router.home.arpa/", "http://[::1]/", "http://[fd00::1]/", "http://[::ffff:10.0.0.1]/", "http://172.16.9.9/", "http://169.254.1.1", "http://u:p@a.example/", "http://printer.local", None, ""]
    assert values(spark, good, I.is_public_url) == [True] * len(good) and values(spark, bad, I.is_public_url) == [False] * len(bad)
    assert values(spark, ["https://a.example/x#y"], I.public_url) == ["https://a.example/x"]


def test_headings(spark):
    got = M.headings(docs(spark, "```\n~~~\n# no\n```\n# Real", "Title\n=====\n\nsub\n---\n\ntext", "    # code", None)).collect()
    assert sorted((r.doc_id, r.level, r.title) for r in got) == [(0, 1, "Real"), (1, 1, "Title"), (1, 2, "sub")]


def test_lines_are_linear_and_keep_their_ends(spark):
    got = M.lines(docs(spark, "a\r\nb\n\nc", "", None)).orderBy("doc_id", "n").collect()
    assert [(r.doc_id, r.n, r.offset, r.line, r.ending) for r in got] == [(0, 0, 0, "a", "\r\n"), (0, 1, 3, "b", "\n"), (0, 2, 5, "", "\n"), (0, 3, 6, "c", ""), (1, 0, 0, "", "")]
    assert M.lines(docs(spark, "x\n" * 200_000)).count() == 200_001


def test_reference_sections(spark):
    text = "# T\n\nsee [1]\n\n## 7. References\n\n[1] A. 2001.\n\n### Books\n\n- [2] B, 2002b.\n\n## Next\n\n[3] no"
    assert [(r.number, r.year) for r in C.references(docs(spark, text)).orderBy("ord").collect()] == [(1, "2001"), (2, "2002b")]
    guessed = "words " * 30 + "cite [2] here\n\n[1] A\n[2] B\n[3] C"
    assert C.reference_section(guessed) is not None and C.reference_section("[1] A\n[2] B\n[3] C") is None
    bare = "References\n\n1 Aa, 2001\n\n2 Bb\n\n2 Cc"
    assert [r[1] for r in C.entries(bare, *C.reference_section(bare)[1:])] == [1, 2, 2]
    lines = "References\nAlpha B. 2001. One\nBeta C. 2002. Two\nmore of two"
    assert [x[2] for x in C.entries(lines, *C.reference_section(lines)[1:])] == ["Alpha B. 2001. One", "Beta C. 2002. Two more of two"]
    assert C.entries("References\n\nno year here", 11, 23) == []


def test_citation_styles(spark):
    refs = "\n\n# References\n\n" + "\n".join(f"[{i}] Name{'xabcdefg'[i]}, A. Title. 200{i}." for i in range(1, 8))
    one = docs(spark, "x (3), <sup>4</sup>, $^{5}$, [6]" + refs, "[1] and [2] but (3)" + refs, "(1) x. Then (2)⁷" + refs, "first (1) a, (2) b, and (3) c [4]" + refs, "10² and m³ and F [1, 2] = 3, 5 (1-2)" + refs, "Namec et al. (2003); (see Namea, 2001, 2002)" + refs)
    links = C.numeric_links(C.mentions(one), C.references(one))
    got = {}
    for r in links.collect():
        got.setdefault(r.doc_id, set()).add(int(r.ref_id[7:]))
    assert got[0] == {4, 5, 6} and got[1] == {1, 2} and got[2] == {1, 2} and got[3] == {4} and 4 not in got
    dated = {r.ref_id for r in C.author_year_links(C.mentions(one), C.references(one)).collect() if r.doc_id == 5}
    assert dated == {"number:3", "number:1"}
    spans = C.citations(one).where("doc_id = 0").orderBy("begin_at").collect()
    assert [r.ref_ids for r in spans] == [["number:4"], ["number:5"], ["number:6"]]


def test_authors():
    assert C.author_keys("see Smith, Jones and Ñg et al.") == ["smith", "jones", "ng"]
    assert C.first_author("B. C. Smith, D. Low (2001) T", "2001") == "smith"
    assert C.author_part("Smith A. and Lowe AB. The title. 2001", "2001") == "Smith A. and Lowe AB"


@pytest.mark.parametrize("seed", range(6))
def test_normal_text_maps_back(seed):
    rng = random.Random(seed)
    source = "".join(rng.choice(["a", "ﬁ", " ", "\n", "é", "e\u0301", "²", "Å", "x"]) for _ in range(60))
    n = S.NormalText(source)
    assert n.text == " ".join(unicodedata.normalize("NFKC", source).split()) or n.text == unicodedata.normalize("NFKC", source).strip()
    for _ in range(20):
        if n.text:
            i = rng.randrange(len(n.text))
            b, e = n.source_range(i, i + 1)
            assert n.text[i] in unicodedata.normalize("NFKC", source[b:e]) + " "


def test_occurrences():
    assert S.occurrences("aaaa", "aa") == ([0, 2], False) and S.occurrences("aaaa", "a", 2) == ([0, 1], True) and S.occurrences("a", "") == ([], False)


def test_source_map(spark):
    md = "# T\n\nAlpha beta **gamma** delta epsilon.\n\nSame words here twice.\n\nSame words here twice.\n\n![c](images/a.png)\n\nSpecial co-operation “quoted” text here.\n"
    box = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, 0, "text", "Alpha beta gamma delta epsilon.", None, 0, box), (1, 1, "text", "Same words here twice.", None, 0, box), (1, 2, "image", None, "images/a.png", 1, box), (1, 3, "text", 'Special cooperation "quoted" text here.', None, 2, box), (1, 4, "text", "short", None, 2, box), (1, 5, "text", "Alpha beta gamma delta epsilon.", None, 3, box), (1, 6, "text", "Alpha beta gamma delta epsilon.", None, 3, [5.0, 1.0, 2.0, 9.0])]
    blocks = spark.createDataFrame(rows, "doc_id int, ordinal int, type string, text string, asset_path string, page_index int, bbox array<double>")
    got = S.source_map(spark.createDataFrame([(1, md), (2, None)], "doc_id int, markdown string"), blocks).collect()
    assert [(md[r.md_from : r.md_to][:7], r.type, [x.page_index for x in r.locations]) for r in got] == [("Alpha b", "text", [0, 3]), ("![c](im", "image", [1]), ("Special", "text", [2])]
    assert S.block_ranges(spark.createDataFrame([(1, md)], "doc_id int, markdown string"), blocks.limit(0)).collect() == []


def test_visible_text():
    text = "# Head *x*\n\nSee [the link](http://a) and `code` **b** ![alt](u) <b>t</b> a\\*b $x_1$ [1].\n\n> quote\n- item\n"
    seen = S.visible_text(text)
    assert "the link and code b alt t a*b x_1 [1]." in seen and "Head x" in seen and "http" not in seen and ">" not in seen
    assert all(text[b:e] == seen[v:w] for v, w, b, e in S.visible_segments(text))


def test_figures_and_tables():
    t = "Table 1. Numbers\n| a | b |\n|---|---|\n| 1 | 2 |\n\n![](a.png)  \n![Figure 2: (a) x (b) y](b.png)\n\n```\n![Figure 9: no](c.png)\n```\n\nFigure 3. Below\n\n![](d.png)\n![](e.png)\n\n<table>\n<tr></tr>\n</table>\n\nTable 2: HTML\n"
    assert [(r[2], r[3], len(r[5]), r[6]) for r in G.figures_of(t)] == [("group", "Figure 2:", 2, "horizontal"), ("group", "Figure 3.", 2, "")]
    assert [(r[2], r[3], r[4]) for r in G.tables_of(t)] == [("pipes", "Table 1.", "Numbers"), ("html", "Table 2:", "HTML")]
    split = "## Table S1\n\nWhat it says\n\n| a | b |\n|---|---|\n"
    assert [(r[3], r[4]) for r in G.tables_of(split)] == [("Table S1", "What it says")]
    moved = "| a | b |\n|---|---|\n| 1 | 2 |\n\n![Table 1. Real](x.png)\n\nFigure 1. Pic\n"
    assert G.captions_reassigned(moved).startswith("Table 1. Real\n\n| a | b |") and "![Figure 1. Pic](x.png)" in G.captions_reassigned(moved)
    assert G.without_repeated_images("![a](x)", "t ![b](x) ![c](y)") == "t  ![c](y)"
    assert list(G.algorithms_of('<div class="algorithm">\n<div>\n</div>\n')) == []


def test_ambiguous_labels(spark):
    one = "See Figure 1a and Figure 2.\n\n![Figure 1. A](a)\n\n![Figure 2. B](b)\n\n![Figure 2. C](c)\n"
    got = G.labelled_links(docs(spark, one)).collect()
    assert [one[r.begin_at : r.end_at] for r in got] == ["Figure 1a"]


def test_anchors():
    md = "# H\n\nfirst word here. Some **bold** text. And word again, then word last."
    note = lambda i, t, **k: dict({"id": i, "text": t, "page": None, "prefix": "", "suffix": ""}, **k)
    got = list(A.anchor(md, [(0, 22, 0), (22, len(md), 1)], [note(1, "Some bold text"), note(2, "word"), note(3, "word", prefix="And so it may be", suffix="again, then word"), note(4, ""), note(5, "first word", begin=5, end=15)]))
    assert [g[3] for g in got] == ["exact", "ambiguous", "ambiguous", "not-found", "saved"]
    assert md[got[0][1] : got[0][2]] == "Some **bold** text"
    assert A.locate([{"page_index": 0, "text": "a value of 3 § 2 in the mean of all samples"}], note(1, "a value of 3 ± 2 in the mean of all samples"))[3] == "glyph"


def test_translation_checks(spark):
    rows = [("a ⟦0⟧ b ⟦1⟧", "x ⟦0⟧ y ⟦1⟧", "ok"), ("a ⟦0⟧ b ⟦1⟧", "x ⟦1⟧ y ⟦0⟧", "placeholders"), ("# h", "h", "structure"), ("p", "x\n\ny", "structure"), ("p", "<b>x</b>", "markup"), ("p", " ", "empty"), ("p", None, "empty")]
    df = spark.createDataFrame(rows, "q string, a string, s string")
    assert all(r.got == r.s for r in df.select("s", TR.check_block(F.col("q"), F.col("a")).alias("got")).collect())
    parts = df.limit(1).select(TR.text_parts(F.col("q")).alias("p")).head().p
    assert [(x.kind, x.text) for x in parts] == [("text", "a "), ("mark", "⟦0⟧"), ("text", " b "), ("mark", "⟦1⟧")]
    b = TR.blocks_of(docs(spark, "# A\n\nText $x$ here\n\n## References\n\n[1] no\n\n# B\n\nyes\n\n```\ncode\n```")).orderBy("n").collect()
    assert [(r.type, r.translatable) for r in b] == [("heading", True), ("paragraph", True), ("heading", False), ("paragraph", False), ("heading", True), ("paragraph", True), ("code", False)]


def test_plan_with_retry_and_force(spark):
    blocks = spark.createDataFrame([(i, i != 3) for i in range(5)], "n int, translatable boolean")
    base = spark.createDataFrame([(0, False), (1, True)], "n int, failed boolean")
    act = lambda **k: {r.n: r.action for r in TR.plan(blocks, base, ["n"], **k).collect()}
    assert act() == {0: "retain", 1: "request", 2: "request", 3: "skip", 4: "request"}
    assert act(force=True)[0] == "request" and act(retry=base.where("n = 1").select("n")) == {0: "retain", 1: "request", 2: "skip", 3: "skip", 4: "skip"}


@pytest.mark.parametrize("seed", range(4))
def test_greedy_folds(spark, seed):
    rng = random.Random(seed)
    rows = [(k, i, rng.randrange(1, 90), rng.random() < 0.7) for k in range(3) for i in range(40)]
    wanted = []
    for k in range(3):
        out, batch = [], []
        for _, i, t, c in [r for r in rows if r[0] == k]:
            if batch and ((c and sum(x[2] for x in batch) >= 3) or sum(x[1] for x in batch) + t > 150):
                out.append(batch)
                batch = []
            batch.append((i, t, c))
        out.append(batch)
        wanted += [(k, i, n) for n, b in enumerate([b for b in out if any(x[2] for x in b)], 1) for i, _, _ in b]
    got = REL.greedy_batches(spark.createDataFrame(rows, "k int, i int, t int, c boolean"), ["k"], "i", "t", "c", 3, 150).collect()
    assert sorted((r.k, r.i, r.batch) for r in got) == sorted(wanted)


def test_merge_takes_the_first_to_arrive(spark):
    rows = [("n", 0, 0, "p", "10.1000/a", "", "zeta", 2001, False), ("n", 0, 1, "p", "10.1000/a", "", "alpha", 2002, False), ("n", 1, 0, "q", "10.1000/b", "", "", 0, True), ("n", 1, 1, "q", "10.1000/A", "", "late", 1999, True)]
    df = spark.createDataFrame(rows, "node string, rank int, ordinal int, provider string, doi string, arxiv_id string, title string, year int, truncated boolean")
    got = {r.key: r for r in graph.merge_providers(df).collect()}
    assert got["doi:10.1000/a"].title == "zeta" and got["doi:10.1000/a"].year == 2001 and got["doi:10.1000/a"].sources == ["p", "q"] and got["doi:10.1000/b"].truncated
    assert {r.key for r in graph.merge_providers(df, 1).collect()} == {"doi:10.1000/a"}


def test_title_conditions(spark):
    texts = spark.createDataFrame([(1, "In: the long title of it, 2001", 2001, ["lee"]), (2, "the long title of it", 0, [])], "ref_id int, text string, year int, authors array<string>")
    titles = spark.createDataFrame([(1, "The long title", 2001, ["lee"]), (2, "Long title of", 1999, ["lee"]), (3, "the long title of", 2001, ["om"])], "item_id int, title string, year int, authors array<string>")
    got = lambda **k: {(r.ref_id, r.item_id) for r in graph.title_candidates(texts, titles, **k).collect()}
    assert got() == {(1, 1), (2, 1), (2, 2), (2, 3)} and got(limit=1) == {(1, 1), (2, 1)}


def test_multi_key_dedup(spark):
    rows = [("l", 1, "10.1000/a", "2101.00001", "T"), ("l", 2, "", "2101.00001", "U"), ("l", 3, "", "", "u"), ("l", 4, "10.1000/b", "", "T")]
    df = spark.createDataFrame(rows, "lookup_id string, ordinal int, doi string, arxiv_id string, title string").withColumn("year", F.lit(0))
    got = P.candidates(df, df.limit(0)).collect()
    assert sorted(r.ordinal for r in got) == [1, 3]  # 2 shares an id with 1, 3 only with 2, which went, and 4 the title of 1


def test_libraries(spark):
    found = spark.createDataFrame([(0, 5, "Zoo", "group"), (1, 4, "Art", "group"), (2, 4, "Again", "group")], "ordinal int, library_id int, name string, kind string")
    assert [(r.library_id, r.name) for r in P.libraries(found, 1).collect()] == [(1, "My Library"), (4, "Art"), (5, "Zoo")]


def test_circuits_open_for_a_while(spark):
    rows = [("k", f"2024-01-01 00:{m:02d}:00", bad) for m, bad in ((0, True), (1, True), (2, True), (5, False), (7, True), (8, True), (9, False), (20, True))]
    df = spark.createDataFrame(rows, "k string, at string, failed boolean").withColumn("at", F.col("at").cast("timestamp"))
    got = [r.open for r in cache.open_circuits(df, "k", "at", "failed", seconds=300).orderBy("at").collect()]
    assert got == [False, False, True, True, False, False, True, False]


def test_store(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = lambda *r: spark.createDataFrame(r, "key int, at int, v string")
    assert store.get(spark, root) is None
    store.upsert(spark, rows((1, 1, "a"), (2, 1, "b")), root, ["key"], "at")
    for n in range(3):
        store.upsert(spark, rows((1, 2 + n, f"c{n}"), (2, 0, "old")), root, ["key"], "at")
    assert {(r.key, r.v) for r in store.get(spark, root).collect()} == {(1, "c2"), (2, "b")}
    assert len([p for p in (tmp_path / "store").iterdir() if p.is_dir()]) <= 3
    (tmp_path / "store" / "current.json").write_text("broken")
    assert store.get(spark, root) is None
    bases = spark.createDataFrame([("d", "h")], "doc_id string, hash string")
    fix = spark.createDataFrame([("d", "b", "x", "new", 1)], "doc_id string, block_id string, base_hash string, replacement string, at int")
    with pytest.raises(Exception, match="another base"):
        store.append_corrections(spark, fix, f"file://{tmp_path}/fixes", bases)
    d = spark.createDataFrame([(1, i, lang, f) for i, (lang, f) in enumerate([("de", "a"), ("de", "b"), ("fr", "a"), ("es", "c"), ("", "d")])], "doc_id int, ordinal int, language string, file string")
    assert sorted(r.language for r in store.repaired(d).collect()) == ["de", "es"]


def test_archive_rules():
    assert [is_stable_list(p) for p in ("content_list.json", "x/a_content_list.json", "a_v2_content_list.json", "content_list_v2.json", "xcontent_list.json")] == [True, True, True, False, False]

    def made(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in files.items():
                z.writestr(name, data)
        return out.getvalue()

    assert open_archive(made({"FULL.md": "x"}))["markdown"] == "x"
    assert "2 lists" in open_archive(made({"full.md": "x", "content_list.json": "[]", "a_content_list.json": "[]"}))["error"]
    assert "no array" in open_archive(made({"full.md": "x", "content_list.json": "{}"}))["error"]
    assert open_archive(made({"full.md": "x", "i.PNG": b"1"}), assets=True)["assets"] == [{"path": "i.PNG", "mime": "image/png", "data": b"1"}]


def test_records(spark):
    assert values(spark, ["a/../../b", "a/./b//c", None, "C:/x", "/x"], R.asset_path) == ["", "a/b/c", "", "", ""]
    assert values(spark, ["a/../../b", "../x", "a/b/../c"], R.normal_path) == ["", "", "a/c"]
    assert values(spark, ["2001", "20010", "x", None, "-1"], R.year_or_zero) == [2001, 0, 0, 0, 0]
    assert values(spark, ["Lee, Ann", "Ann B. Lee", "Lee", ""], lambda c: R.creator(c)["last"]) == ["Lee", "Lee", "Lee", ""]
    assert values(spark, ["Author A. Some long title here. Journal", "Author. Topic: the rest of it (2001)."], R.title_query) == ["Some long title here", "Topic: the rest of it"]
    assert values(spark, ["a|b\nc", "a\\|b"], R.escape_cell) == ["a\\|b<br>c", "a\\\\\\|b"]
    assert values(spark, ["12", "-1", "x", "1.5"], R.count_or_null) == [12, None, None, None]
    assert values(spark, ['<section a="b"><div class="doc-figure-panel-label x">L</div><figcaption>c</figcaption></section>'], R.note_html) == ['<p>L</p><p class="doc-caption">c</p>']
    assert values(spark, ["00001|000123|00005", "1|2|3", None], R.sort_offset) == [123, None, None]


def entry(text, part, kind="text", page=0, box=(1, 1, 500, 100)):
    at = text.index(part)
    return {"type": kind, "md_from": at, "md_to": at + len(part), "locations": [{"page_index": page, "bbox": list(box)}]}


def test_text_flow_over_a_page():
    t = "One two three four five six (\n\n![](c.png)\n\nseven eight) end.\n\nNext."
    rows = [entry(t, "One two three four five six ("), entry(t, "![](c.png)", "chart"), entry(t, "seven eight) end.", page=1), entry(t, "Next.", page=1, box=(1, 300, 500, 400))]
    assert W.text_flow(t, rows) == "One two three four five six ( seven eight) end.\n\n![](c.png)\n\nNext."
    assert W.text_flow(t, rows[:1] + rows[2:]) == t


def test_columns_in_reading_order():
    t = "left one\n\nright one\n\n\nleft two"
    rows = [entry(t, "left one", box=(10, 10, 400, 50)), entry(t, "right one", box=(500, 10, 900, 50)), entry(t, "left two", box=(10, 60, 400, 90))]
    assert W.column_flow(t, rows) == "left one\n\nleft two\n\n\nright one"
    assert W.split_columns([[10, 0, 100, 1], [500, 0, 900, 1]]) is None and W.split_columns([[10, 0, 400, 1], [500, 0, 900, 1]]) == 450


def test_panels_side_by_side():
    t = "![](b.png)\n\nSome prose below.\n\n![Figure 1. Both](a.png)\n\nend"
    rows = [entry(t, "![](b.png)", "chart", box=(520, 10, 900, 200)), entry(t, "Some prose below.", box=(10, 300, 900, 350)), entry(t, "![Figure 1. Both](a.png)", "chart", box=(100, 10, 500, 200))]
    assert W.panels(t, rows) == "![Figure 1. Both](a.png)  \n![](b.png)\n\nSome prose below.\n\nend"
    assert W.panels(t, rows[:2]) == t


def test_normalize_converted_text():
    t = "• one\n\n• two\n\nThis is a sentence of six words\n\nthat goes on.\n\nIt was seen (as Smith and all others said,\n\n2001, 2002).\n\n![](a.png)\n\nFigure 1. Cap\n\n# References\n\n• x\n\n• y\n\nlong words one two three four\n\nlower case"
    got = W.normalize(t)
    assert got.startswith("- one\n\n- two\n\nThis is a sentence of six words that goes on.\n\nIt was seen (as Smith and all others said, 2001, 2002).\n\n![Figure 1. Cap](a.png)") and got.endswith("# References\n\n• x\n\n• y\n\nlong words one two three four\n\nlower case")


def test_prepare(spark):
    t = "Alpha left column words one.\n\nBeta right column words two.\n\nGamma left column words three."
    b = [(1, i, "text", x, None, 0, box) for i, (x, box) in enumerate(zip(t.split("\n\n"), ([10.0, 10.0, 400.0, 50.0], [500.0, 10.0, 900.0, 50.0], [10.0, 60.0, 400.0, 90.0])))]
    blocks = spark.createDataFrame(b, "doc_id int, ordinal int, type string, text string, asset_path string, page_index int, bbox array<double>")
    docs_ = spark.createDataFrame([(1, t, False), (2, t, False), (3, None, None)], "doc_id int, markdown string, edited boolean")
    got = {r.doc_id: r.markdown for r in W.prepared(docs_, blocks).collect()}
    assert got[1].split("\n\n")[1].startswith("Gamma") and got[2] == t and got[3] is None and W.prepare(t, [], True) == t


def test_affiliations(spark):
    t = "# Title\n\nAnn Lee<sup>1,2*</sup>, Bo Om$^{2}$\n\n<sup>1</sup> Dept A; <sup>2</sup>Dept B\n\n²Dept B, new\n\n# Abstract\n\nx<sup>1</sup>"
    got = FM.author_affiliations(docs(spark, t, "# T\n\nno marks", None)).orderBy("begin_at").collect()
    assert [(t[r.begin_at : r.end_at], r.key, r.affiliation) for r in got] == [("1", "1", "Dept A"), ("2*", "2", "Dept B, new"), ("2", "2", "Dept B, new")]
    plain = "# Title\n\nAnn<sup>a</sup> Bo<sup>b</sup>\n\na Dept of A\nb Dept of B\n\n## Methods\n"
    assert [r[:2] for r in FM.affiliations_of(plain)] == [("a", "Dept of A"), ("b", "Dept of B")]
    assert t[FM.body_start(t) :].startswith("# Abstract") and FM.mark_key("†a") == "a" and FM.mark_key("*") is None


#: Documents of the reference's own timing tests; each took it under 1.5 seconds.
HARD = {"dollars": "$1" * 32000, "open round": "\\(" * 32000, "open square": "\\[\n" * 16000, "ordinary": "**b** " * 6000 + "[t](https://a.example/x) " * 2500, "formulas": "$x$ " * 16000, "split": "$a*b*c$ " * 8000, "ticks": "`a " * 20000, "stars": "*a " * 20000}


@pytest.mark.parametrize("name", sorted(HARD))
def test_rendering_is_linear(name):
    began = time.process_time()
    H.render(HARD[name])
    assert time.process_time() - began < 1.5


def test_rendering_is_safe():
    got = H.render("# a <script>x</script>\n\n[x](javascript:alert(1)) [y](JaVa\tscript:x) ![z](//evil) <img src=x onerror=y>\n\n<div onclick=x>\n\n<table onload=x><tr><td>1</td></tr></table>\n\n```a\"b\n</code>\n```")
    assert "<script" not in got and "javascript:" not in got.lower() and "<img" not in got and "<div onclick" not in got and "<table><tr><td>1</td></tr></table>" in got and "&lt;/code&gt;" in got
    assert H.render("") == "" and H.render("$a$ " * 1001).count('class="math"') == 1000
    assert H.render("a\\*b* *c* __d__ ~~e~~ x_y_z") == "<p>a*b* <em>c</em> <strong>d</strong> <del>e</del> x_y_z</p>"
    assert H.gfm_table(["a", "b"], [["1|2"], ["x\ny", "z", "w"]], ["right"]) == "| a | b |\n| ---: | --- |\n| 1\\|2 |  |\n| x<br>y | z |"
    assert "<figcaption>Figure 1. Two</figcaption>" in H.render("![](a.png)\n![](b.png)\n\nFigure 1. Two")


def test_inline_math_rules():
    assert M.inline_math("a $x$ b $5 and $6, \\(y\\)") == [(2, 5), (19, 24)]
    assert M.inline_math("$ x$ $x $ $ x $ $$ $a b$c $a$1") == [(10, 15)]
    assert M.inline_math("$a\nb$ \\(a\nb\\)") == []


def test_patterns_are_compiled_once(monkeypatch):
    text = "# T\n\nas in [1] and (Lee et al., 2001), see Fig. 2b\n\n![](a.png)\n\nFigure 2. Both\n\n## References\n\n[1] Lee A. First, 2001.\n"
    scans = [C.mentions_of, C.references_of, G.figures_of, G.mentions_of, FM.affiliations_of, W.normalize, A.fold_annotation]
    for f in scans:
        list(f(text))
    monkeypatch.setattr(regex._main, "_compile", None)  # what finds a pattern for the module's functions
    for f in scans:
        list(f(text))


def test_scans_are_spread(spark):
    one = docs(spark, *["# T\n\nas in [1]\n\n## References\n\n[1] Lee A. First, 2001.\n"] * 40).coalesce(1)
    notes = one.selectExpr("doc_id", "1 as id", "'First' as text", "'' as sort_index", "0 as page_index", "'' as prefix", "'' as suffix", "cast(null as int) as begin", "cast(null as int) as end", "0 as page")
    items = one.selectExpr("doc_id", "0 as ordinal", "'text' as type", "text", "cast(null as string) as asset_path", "0 as page_index", "array(1.0D, 2.0D, 3.0D, 4.0D) as bbox")
    md = one.withColumnRenamed("text", "markdown")
    found = [
        C.references(one), C.mentions(one), C.linked(one), C.citations(one), G.figures(one), G.labelled_links(one), FM.author_affiliations(one), A.overlay(md, notes), W.prepared(md.selectExpr("*", "false as edited"), items),
        A.locate_in_pages(notes, one.selectExpr("doc_id", "0 as page_index", "text")), S.block_ranges(md, items), REL.greedy_intervals(one.selectExpr("doc_id", "1 as b", "2 as e"), ["doc_id"], "b", "e"),
    ]
    assert [df.rdd.getNumPartitions() for df in found] == [int(spark.conf.get("spark.sql.shuffle.partitions"))] * len(found)


def test_links_of_a_text_are_those_of_the_joins(spark):
    rnd = random.Random(3)
    said = ["as in [1] and [2, 3]", "(1) and so on", "Then (2-3) came.", "known<sup>1</sup>", "$^{2}$", "(see Smith et al., 2001; Ng and Wu 2002, 2003b)", "Smith et al. (2001) say", "Lee (2001)", "both [1] [3]"]
    refs = ["[1] Lee A. First, 2001.", "[2] Ng B, Wu C. Second, 2002.", "[3] Ng, Wu (2003b) Third", "[1] Smith A. Again (2001)"]
    some = docs(spark, *["# T\n\n" + " and ".join(rnd.choices(said, k=5)) + "\n\n# References\n\n" + "\n".join(rnd.sample(refs, rnd.randrange(5))) + "\n" for _ in range(120)])
    found, held = C.mentions(some), C.references(some)
    both = C.numeric_links(found, held).unionByName(C.author_year_links(found, held))
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "begin_at", "end_at", "style", "ref_id").collect()))
    assert rows(C.linked(some)) == rows(both) and {r[3] for r in rows(both)} == {"bracket", "round", "raised", "dated"}


def test_copies_of_a_document_have_their_own_links(spark):
    text = "see Fig. 1 and [1]\n\n![Figure 1. One](a.png)\n\n# References\n\n[1] Lee A. First, 2001.\n"
    twice = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id int, text string")
    assert [(r.doc_id, r.begin_at) for r in G.labelled_links(twice).orderBy("doc_id").collect()] == [(None, 4), (1, 4), (1, 4)]
    assert [(r.doc_id, r.ref_id) for r in C.linked(twice).orderBy("doc_id").collect()] == [(None, "number:1"), (1, "number:1"), (1, "number:1")]


def test_greedy_intervals_over_batches(spark):
    rows = [(g, b, b + 3) for g in range(300) for b in range(9)] + [(None, 1, 2), (None, 1, 4), (None, 2, 3), (7, None, 5), (8, 90, None), (8, 95, 99)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = REL.greedy_intervals(spark.createDataFrame(rows, "g int, b int, e int"), ["g"], "b", "e").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.b, r.e))
    assert sorted(by.pop(None)) == [(1, 2), (2, 3)] and sorted(by.pop(8)[-1:]) == [(90, None)]
    assert len(by) == 299 and all(sorted(v) == [(0, 3), (3, 6), (6, 9)] for v in by.values())


def test_status_of_an_identifier_that_many_items_share(spark):
    n, began = 20_000, time.time()
    items = spark.range(n).selectExpr("id as item_id", "cast(id % 2 as int) as library_id", "if(id = 7, '10.1/one', '10.1/all') as doi", "'' as pmid", "id % 5 = 0 as has_pdf")
    lookups = spark.range(n).selectExpr("id as lookup_id", "case id when 0 then '10.1/one' when 1 then '' when 2 then '10.1/none' else '10.1/all' end as doi", "if(id = 3, '5', '') as pmid", "cast(id % 3 as int) as target_library_id")
    got = graph.reference_status(lookups, items, ("doi", "pmid"))
    assert {r.status: r["count"] for r in got.groupBy("status").count().collect()} == {"present-other-library": 1, "unknown": 1, "absent": 1, "ambiguous": n - 3}
    assert time.time() - began < 60  # 400 million pairs, were each item to meet each lookup


def test_title_candidates_in_a_long_text(spark):
    began = time.time()
    texts = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60_000))), (2, "only w59998 w59999 x"), (3, None)], "ref_id int, text string")
    titles = spark.createDataFrame([(1, "W59997 w59998, w59999"), (2, "w59998 w59999"), (3, "w59999 w59998 w1")], "item_id int, title string")
    assert sorted(map(tuple, graph.title_candidates(texts, titles).collect())) == [(1, 1), (1, 2), (2, 2)]
    assert time.time() - began < 60  # runs of words cut from a whole array of words each are quadratic


def test_windows_and_joins_of_documents_are_spread(spark):
    rows = spark.range(40).selectExpr("id as doc_id", "explode(sequence(1, 4)) as ord")
    boxes = rows.selectExpr("doc_id", "ord", "if(ord % 2 = 1, 50, 500) as x0", "if(ord % 2 = 1, 480, 930) as x1", "floor((ord - 1) / 2) * 240 as y0", "floor((ord - 1) / 2) * 240 + 150 as y1")
    spot = "named_struct('page_index', 0, 'bbox', array(1.0D, 2.0D, 3.0D, 4.0D))"
    entries = rows.selectExpr("doc_id", "ord * 10 as md_from", "ord * 10 + 8 as md_to", f"array({spot}) as locations", f"array(named_struct('md_from', 1, 'md_to', 2, 'location', {spot})) as location_ranges")
    found = [L.reading_order(boxes, ["doc_id"]), L.panel_pairs(boxes, ["doc_id"]), S.page_hint(rows.selectExpr("doc_id", "ord * 10 as begin", "ord * 10 + 2 as end"), entries), S.shifted(entries, rows.selectExpr("doc_id", "ord * 10 + 3 as begin", "ord * 10 + 5 as end", "4 as size"))]
    assert [df.rdd.getNumPartitions() for df in found] == [int(spark.conf.get("spark.sql.shuffle.partitions"))] * 4
    assert [df.count() for df in found] == [160, 80, 160, 160]
    assert sorted(map(tuple, L.panel_pairs(boxes.where("doc_id < 2"), ["doc_id"]).collect())) == [(d, a, a + 1, "horizontal") for d in (0, 1) for a in (1, 3)]


def test_lines_bound_their_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        M.lines(docs(spark, "a\nb"))
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_identifiers_name_their_text_once(spark):
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (*(docs(spark, "x").select(f(F.col("text")).alias("x")) for f in (I.doi, I.arxiv, I.pmid)),)]
    assert [p.count("coalesce(") for p in plans] == [1, 1, 1]
    assert values(spark, ["<10.1234/Ab>", "< doi:10.1234/ab >", "doi: < 10.1234/ab >", "<>", "<10.1/a>", "10.1234/a b", None, "HTTPS://dx.doi.org/<10.1234/AB>"], I.doi) == ["10.1234/ab", "", "10.1234/ab", "", "", "", "", "10.1234/ab"]
    assert values(spark, ["http://010.0.0.1/", "http://100.064.0.1/", "http://0256.1.1.1/", "http://10.0.0.1.5/", "http://1000000010.0.0.1/", "http://192.168.1/", "http://172.15.0.1/", "http://8.8.8.8/"], I.is_public_url) == [False, False, True, True, True, True, True, True]
