"""Cases that the supplied tables do not hold."""

import hashlib
import io
import random
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern import catalog
from lectern.functions import identifiers as I, text as S
from lectern.operators import cache, citations as C, figures as G, graph, markdown as M, relational as R, render
from lectern.sources.archive import content_blocks, open_archive, read_archives
from lectern.streaming.latest import newest_version, single_flight, upsert_latest, windowed_counts


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_identifiers(spark):
    assert column(spark, ["doi:10.1000/AbC", "<https://doi.org/10.1000/x>", " <10.1000/X> ", "10.1000/a b", "10.1/x", "10.1000/a(b)", None, ""], I.doi) == ["10.1000/abc", "", "10.1000/x", "", "", "", "", ""]
    assert column(spark, ["arXiv:hep-th/9901001v3", "2101.00001", "210.1", None], I.arxiv) == ["hep-th/9901001", "2101.00001", "", ""]
    assert column(spark, ["123", "1" * 13, "https://pubmed.ncbi.nlm.nih.gov/77/"], I.pmid) == ["123", "", "77"]
    assert column(spark, ["http://localhost/x", "http://10.0.0.1/", "https://a.example/", "ftp://a.example", None], I.is_public_url) == [False, False, True, False, False]


def test_text(spark):
    assert column(spark, ["a  b\n", "", None], S.squash) == ["a b", "", None]
    assert column(spark, ["Ünï-Code: x", None], lambda c: S.search_key(c)) == ["uni code x", None]
    words = ["ﬁne", "Å", "x ²", None]
    assert column(spark, words, lambda c: S.nfkc(c)) == [None if w is None else unicodedata.normalize("NFKC", w) for w in words]
    assert column(spark, ["aaaa", "", None], lambda c: S.occurrences(c, F.lit("aa"))) == [2, 0, None]
    assert column(spark, ["in 2020", "12020", "1799 2100", "x1999a"], S.first_year) == [2020, None, None, 1999]


def test_search_keys_of_all_documents(spark, tmp_path):
    texts = ["Plain Té", "“curly” – dash", "Привет, Мир", "漢字 x", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.key for r in catalog.queries()["search_keys"](spark, str(tmp_path)).collect()}
    keys = ["plain te", "curly dash", "привет мир", "漢字 x", "", None]
    assert got == {i: None if k is None else hashlib.md5(k.encode()).hexdigest() for i, k in enumerate(keys)}


def test_unique_or_nothing(spark):
    papers = spark.createDataFrame([("a", "10.1000/1", ""), ("b", "10.1000/2", "2101.00001"), ("c", "10.1000/2", ""), ("d", None, "2101.00002")], "node string, doi string, arxiv_id string")
    refs = spark.createDataFrame([("a", "10.1000/1", "", "p"), ("a", "10.1000/2", "2101.00001", "q"), ("b", "10.1000/1", "", "p"), ("b", "10.1000/1", "", "Q"), ("c", None, "2101.00002", None)], "source string, doi string, arxiv_id string, provider string")
    got = {(r.source, r.target, tuple(r.sources)) for r in graph.edges(papers, refs).collect()}
    assert got == {("a", "b", ("q",)), ("b", "a", ("p", "q")), ("c", "d", ())}


@pytest.mark.parametrize("seed", range(5))
def test_lru_equals_eviction(spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{i}", rng.randrange(8), rng.randrange(1, 20)) for i in range(12)]
    left = sorted(rows, key=lambda r: (r[1], [-ord(c) for c in r[0]]))
    while left and (len(left) > 6 or sum(r[2] for r in left) > 50):
        left.pop(0)
    got = R.lru_keep(spark.createDataFrame(rows, "key string, at int, size int"), "at", "size", "key", 6, 50)
    assert sorted(r.key for r in got.collect()) == sorted(r[0] for r in left)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    for f in (M.lines, M.paragraphs, M.headings, M.gfm_tables, C.references, C.citations, G.figures, G.labelled_links, M.blocks, M.blocked_lines, M.author_year_citations):
        assert f(docs).collect() == []


def test_blocks():
    text = "# T #\n\npara\nmore\n===\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```x\n# no\n```\n> q\n\n- a\n- b\n\n$$\nx\n$$\n\n    code\n\n![i](u)\n<table>\n</table>"
    assert [(k, text[a:b].split("\n")[0]) for k, a, b in M.scan_blocks(text)] == [("heading", "# T #"), ("heading", "para"), ("table", "| a | b |"), ("code", "```x"), ("quote", "> q"), ("list", "- a"), ("math", "$$"), ("code", "    code"), ("image", "![i](u)"), ("table", "<table>")]
    assert M.scan_blocks("") == []
    assert M.inline_math("a $x$ b $5 and $6, \\(y\\)") == [(2, 5), (19, 24)]


@pytest.mark.parametrize("text", ["`a` ⟦0⟧ ![x](y) $z$ [1, 2]", "", "plain"])
def test_protect_round_trip(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(M.protect("t").alias("p"))
    row = df.select(M.restore("p.text", "p.parts").alias("t"), "p.text").head()
    assert row.t == text


def test_sanitize():
    assert render.sanitize("<table onload=x><tr><td colspan='3'>1 < 2<img src=x></td></tr></table>") == '<table><tr><td colspan="3">1 &lt; 2</td></tr></table>'


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("_md", ".md"), data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    blocks = '[{"type": "image", "img_path": "i.png", "image_caption": "c", "page_idx": 0, "bbox": [0, 0, 1, 1]}, {"type": "list", "list_items": ["a", "b"]}]'
    good = io.BytesIO()
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("x/full.md", "# T")
        z.writestr("x/a_content_list.json", blocks)
        z.writestr("x/a_content_list_v2.json", "[]")
        z.writestr("x/i.png", b"1")
    (tmp_path / "a.zip").write_bytes(good.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no zip")
    found = {r.path.rsplit("/", 1)[-1]: r for r in read_archives(spark, str(tmp_path)).collect()}
    assert found["a.zip"].markdown == "# T" and found["a.zip"].images == ["x/i.png"] and found["b.zip"].error
    assert [(r.type, r.text, r.captions) for r in content_blocks(read_archives(spark, str(tmp_path))).orderBy("ordinal").collect()] == [("image", "", ["c"]), ("list", "a\nb", [])]
    assert open_archive(good.getvalue(), max_markdown=2)["error"] == "too large"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "event_id")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert_latest(stream, ["user_id"], ["ts", "event_id"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in newest_version(spark, str(tmp_path / "out")).select("user_id", "event_id").collect()}
    assert got == {tuple(r) for r in cache.latest(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id").collect()}


def test_stream_rewrites_only_touched_buckets(spark, tmp_path):
    schema = "k int, version int, v string"
    rows = lambda n, keys: spark.createDataFrame([(k, n, f"v{n}") for k in keys], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for n, keys in enumerate((range(50), [1], [1], [1, 2])):
        rows(n, keys)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        upsert_latest(stream, ["k"], ["version"], str(tmp_path / "out"), str(tmp_path / "cp"), 8).awaitTermination()
    got = {r.k: r.v for r in newest_version(spark, str(tmp_path / "out")).collect()}
    assert got == {k: "v3" if k in (1, 2) else "v0" for k in range(50)}
    versions = [p.parent.name for p in (tmp_path / "out").glob("version=*/lectern_bucket=*")]
    assert versions.count("version=0") == 8 - 1 and len(versions) <= 8 + 3


def test_windows_and_single_flight(spark, tmp_path):
    events = spark.createDataFrame([("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:05"), ("b", "2024-01-01 00:01:30"), ("a", "2024-01-01 00:09:00")], "k string, at string").withColumn("at", F.col("at").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = lambda df, name, mode: df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    run(windowed_counts(stream(), "at", ["k"], "1 minute", "1 minute"), "counts", "complete")
    assert sorted((r.k, r["count"]) for r in spark.table("counts").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    run(single_flight(stream(), ["k"], "at", "1 minute"), "once", "append")
    assert sorted(r.k for r in spark.table("once").collect())[:2] == ["a", "b"]
