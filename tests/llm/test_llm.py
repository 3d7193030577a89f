"""The ten operators against brute force, round trips, SQL and odd inputs."""

import functools
import hashlib
import json
import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import bpe, chat, html_wrapper as H, near_dedup as N, queries, substring_dedup as P, token_store as K, vectext as V
from lectern.llm.exact_dedup import exact_dedup
from lectern.llm.line_rules import line_frequency_rules
from lectern.llm.mixing import mix_sources, water_fill
from lectern.llm.quality import SubwordClassifier, quality_filter

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, key string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "h", None) for i, t, s in rows], SCHEMA)


def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30000))
    return docs(spark, (1, None, "a"), (2, "", "a"), (None, "x y z", None), (None, "x y z", None), (3, long, "b"), (3, long, "b"), (4, long + " tail", "b"), (5, "...", None), (6, "x y z", "a"))


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(n))


def edited(rng, t, share):
    return " ".join(text(rng, 1) if rng.random() < share else w for w in t.split())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    cursor = c.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in cursor.description]
    expected = sorted(str(dict(zip(columns, r))) for r in cursor.fetchall())
    assert sorted(str({k: r[k] for k in columns}) for r in df.collect()) == expected


# 1


@pytest.mark.parametrize("seed", range(3))
def test_bpe_streams_like_whole_texts(seed):
    rng = random.Random(seed)
    ranks = bpe.load_ranks(bpe.VOCABULARY)
    small, decoder = bpe.Transducer(ranks, window=64), bpe.Decoder(ranks)
    parts = ["a", "the ", "é", "'ll", "'l", "  ", "\n", "12", "!!", "日本", "x" * 50, " ", "ing" * 400, "😀" * 300, "don't"]
    for _ in range(40):
        s = "".join(rng.choice(parts) for _ in range(40))
        brute = [ranks[b] for m in small.split.findall(s) for b in bpe.merge(m.encode(), ranks)] if len(s) < 400 else small.core.encode_ordinary(s)
        got = [i for ids in small.feed([s[:7], s[7:90], s[90:]]) for i in ids]
        assert got == brute and decoder.decode(got, 3) == s


def test_bpe_boundaries():
    """Every kind of boundary is used, texts below a window included in the same way, and what is held stays bounded."""
    ranks = bpe.load_ranks(bpe.VOCABULARY)
    t = bpe.Transducer(ranks, window=2048)
    texts = ["plain words " * 1000, "a-b_c" * 2000, "ing" * 4000, "short", ""]
    longest = 0
    for s in texts:
        brute = t.core.encode_ordinary(s)
        stable = t._stable
        def watched(held):
            nonlocal longest
            longest = max(longest, len(held))
            return stable(held)
        t._stable = watched
        assert t.encode(s) == brute
        del t._stable
    assert all(n > 0 for n in t.boundaries.values()) and t.boundaries["end"] == 4
    assert longest <= 2 * 2048 and t.lookahead < 2048


def test_bpe_tables(spark):
    df = odd(spark).withColumn("n_tokens", F.lit("x")).withColumn("token_ids", F.lit(1))
    out = bpe.bpe_encode(df)
    assert dict(out.dtypes)["n_tokens"] == "int" and dict(out.dtypes)["token_ids"] == "array<int>"
    df = odd(spark)
    back = bpe.bpe_decode(bpe.bpe_encode(df))
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert bpe.bpe_encode(df.limit(0)).collect() == []


# 2


def test_quality(spark):
    rng = random.Random(1)
    rows = [(i, ("BUY!! " + text(rng, 30).upper() if i % 2 else text(rng, 30)), "s") for i in range(300)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    kept = quality_filter(docs(spark, *rows), labels)
    held_out = {r.doc_id for r in kept.collect() if r.doc_id >= 200}
    assert held_out == {i for i in range(200, 300) if i % 2 == 0}
    assert {r.doc_id for r in quality_filter(odd(spark), labels).collect()} >= {1}
    assert quality_filter(odd(spark), labels.limit(0)).count() == odd(spark).count()
    assert quality_filter(odd(spark).limit(0), labels).collect() == []


def test_quality_features_stay_in_their_text():
    m = SubwordClassifier(buckets=1 << 20)
    alone = [m.features([t])[0] for t in ("ab cd", "", "x")]
    f, d = m.features(["ab cd", "", "x"])
    assert all(sorted(f[d == i]) == sorted(a) for i, a in enumerate(alone))


def naive_features(m, t):
    """Words as written and n-grams of words with a space at either end, hashed one by one."""
    one = lambda g, seed: int(V.span_hash(V.prefix_hash(np.array([ord(c) for c in g], dtype=np.uint32)), np.array([0]), np.array([len(g)]), seed)[0]) & (m.buckets - 1)
    out = []
    for k, w in enumerate((t or "").split()):
        out.append(one(w, 1))
        padded = f" {w} " if k else f"{w} "
        out += [one(padded[i : i + n], n) for n in m.grams for i in range(len(padded) - n + 1) if not padded[i] == padded[i + n - 1] == ' ']
    return out


@pytest.mark.parametrize("seed", range(3))
def test_classifier_against_brute_force(seed):
    rng = random.Random(seed)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 9))) for _ in range(12)] + ["", None]
    labels = [rng.randrange(2) for _ in texts]
    m = SubwordClassifier(buckets=1 << 12, dim=4)
    vectors, output, bias = m.vectors.astype(float), m.output.astype(float), m.bias.astype(float)
    order, step, steps = np.random.default_rng(m.seed), 0, 3 * len(texts)
    for _ in range(3):  # the same gradient descent, feature by feature
        for i in order.permutation(len(texts)):
            f = naive_features(m, texts[i])
            rate = 0.5 * (1 - step / steps)
            step += 1
            if not f:
                continue
            mean = sum(vectors[j] for j in f) / len(f)
            p = np.exp(mean @ output + bias)
            p /= p.sum()
            p[labels[i]] -= 1
            back, share = output @ p, {j: f.count(j) / len(f) for j in f}
            output, bias = output - rate * np.outer(mean, p), bias - rate * p
            for j, x in share.items():
                vectors[j] -= rate * x / sum(y * y for y in share.values()) * back
    m.fit(texts, labels, epochs=3)
    got = m.probabilities(texts)
    for t, p in zip(texts, got):
        f = naive_features(m, t)
        z = (sum(vectors[j] for j in f) / len(f) if f else np.zeros(4)) @ output + bias
        assert abs(p[1] - np.exp(z[1]) / np.exp(z).sum()) < 1e-3


# 3


def near_brute(rows, threshold=0.45):
    words = {i: V.words([t])[0] for i, t, _ in rows}
    counts = np.zeros(1 << 20, dtype=np.int64)
    for w in words.values():
        counts[np.unique(V.shingles(w, 3) & np.uint64((1 << 20) - 1)).astype(np.int64)] += 1
    vectors = {i: N.weighted_shingles(w, N.idf_of(counts, len(rows)), 3) for i, w in words.items()}
    return {(a, b): s for a, b in combinations(sorted(words), 2) if (s := N.weighted_jaccard(vectors[a], vectors[b])) >= threshold}


def test_near_dedup_recall_close_to_the_threshold(spark):
    rng = random.Random(7)
    rows = []
    for g in range(150):
        t = text(rng, 150)
        rows += [(10 * g, t, "s"), (10 * g + 1, edited(rng, t, 0.115), "s")]
    brute = {p: s for p, s in near_brute(rows).items() if s < 0.55}
    assert len(brute) > 40
    got = {r.doc_id for r in N.near_dedup(docs(spark, *rows)).collect()}
    assert sum(b not in got for _, b in brute) >= 0.9 * len(brute)


def test_large_buckets_are_compared_by_component(spark):
    """Two groups that share no first document but buckets; ``pairwise=1`` compares components only."""
    rng = random.Random(9)
    t = text(rng, 120)
    rows = [(i, edited(rng, t, 0.04), "s") for i in range(12)] + [(20 + i, text(rng, 100), "s") for i in range(5)]
    group = {i: i for i, _, _ in rows}
    for a, b in near_brute(rows):
        low, high = sorted((group[a], group[b]))
        group = {i: low if g == high else g for i, g in group.items()}
    firsts = {g for g in group.values() if g < 20}
    for pairwise in (1, 64):
        got = {r.doc_id for r in N.near_dedup(docs(spark, *rows), pairwise=pairwise).collect()}
        assert {r for r in got if r < 20} == firsts and got >= set(range(20, 25))


def sliding_windows(bands):
    """Windows along a text, and the first ones of the groups by all pairs and by those that share a bucket of one-row bands."""
    rng = random.Random(13)
    rows = []
    for g in range(4):
        words = text(rng, 900).split()
        rows += [(n, " ".join(words[15 * i : 15 * i + 100]), "s") for i, n in enumerate(rng.sample(range(100 * g, 100 * g + 100), 50))]
    rows += [(1000 + i, rows[i][1], "s") for i in range(0, 200, 20)]
    brute, words = near_brute(rows), {i: V.words([t])[0] for i, t, _ in rows}
    counts = np.zeros(1 << 20, dtype=np.int64)
    for w in words.values():
        counts[np.unique(V.shingles(w, 3) & np.uint64((1 << 20) - 1)).astype(np.int64)] += 1
    sampler, idf = N.Sampler(bands), N.idf_of(counts, len(rows))
    hashes = {i: set(N.band_hashes(sampler(*N.weighted_shingles(w, idf, 3)), bands, 1).tolist()) for i, w in words.items()}
    group, every = {i: i for i in words}, {i: i for i in words}
    for a, b in brute:
        for g, hit in ((group, hashes[a] & hashes[b]), (every, True)):
            low, high = sorted((g[a], g[b]))
            g.update({i: low for i in g if g[i] == high and hit})
    return rows, set(every.values()), set(group.values())


@pytest.mark.parametrize("bands", [2, 4])
def test_large_buckets_lose_no_pair_of_members(spark, bands):
    """Windows that link two components are not the components' first ones."""
    rows, least, most = sliding_windows(bands)
    got = {r.doc_id for r in N.near_dedup(docs(spark, *rows), bands=bands, rows=1, pairwise=1).collect()}
    assert least <= got <= most


def test_prefixes_of_near_copies_meet():
    rng = np.random.default_rng(3)
    idf, met, short = rng.uniform(1, 9, 1 << 10).astype(np.float32), 0, 0
    for _ in range(2000):
        a = np.unique(rng.integers(0, 90, rng.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.8], rng.integers(0, 90, rng.integers(1, 12)).astype(np.uint64)))
        a, b = ((s, rng.integers(1, 4, len(s)).astype(np.float32) * idf[s.astype(np.int64)]) for s in (a, b))
        pa_, pb = (N.prefix(*v, idf, 0.45) for v in (a, b))
        short += len(pa_) < len(a[0])
        if N.weighted_jaccard(a, b) >= 0.45:
            met += 1
            assert set(pa_.tolist()) & set(pb.tolist())
    assert met > 50 and short > 1000


def test_near_dedup_recall(spark):
    rng = random.Random(2)
    rows = []
    for g in range(60):
        t = text(rng, rng.randrange(60, 200))
        rows += [(10 * g, t, "s")] + [(10 * g + j, edited(rng, t, 0.05), "s") for j in range(1, 1 + g % 3)]
    got = {r.doc_id for r in N.near_dedup(docs(spark, *rows)).collect()}
    words = {i: V.words([t])[0] for i, t, _ in rows}
    counts = np.zeros(1 << 20, dtype=np.int64)
    for w in words.values():
        counts[np.unique(V.shingles(w, 3) & np.uint64((1 << 20) - 1)).astype(np.int64)] += 1
    vectors = {i: N.weighted_shingles(w, N.idf_of(counts, len(rows)), 3) for i, w in words.items()}
    brute = {b for a, b in combinations(sorted(words), 2) if N.weighted_jaccard(vectors[a], vectors[b]) >= 0.45}
    removed = set(words) - got
    assert removed <= brute and len(removed) >= 0.9 * len(brute) and {10 * g for g in range(60)} <= got


def test_sampler_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    s = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    a, b = rng.uniform(0.5, 4, 400).astype(np.float32), rng.uniform(0.5, 4, 400).astype(np.float32)
    sampler = N.Sampler(2000)
    agree = (sampler(s[:300], a[:300]) == sampler(s[100:], b[100:])).mean()
    assert abs(agree - N.weighted_jaccard((s[:300], a[:300]), (s[100:], b[100:]))) < 0.04


def test_near_dedup_odd(spark):
    got = N.near_dedup(odd(spark))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "3", "5", "6"] and got.columns == odd(spark).columns
    assert N.near_dedup(odd(spark).limit(0)).collect() == []


# 4


def test_wrapper_accepts_all_and_finds_groups(spark):
    page = lambda n, extra: f"<html><title>T{n}</title><nav><a>n</a></nav><div><ul>{'<li>i%d</li>' * n % tuple(range(n))}</ul>{extra}</div><p>same</p>"
    pages = [page(n, e) for n in (1, 2, 5) for e in ("", "<b>bold</b>", f"<b>bold &amp; x</b><i>y{n}</i>")]
    streams = [H.tokens(p)[0] for p in pages]
    w = H.infer(list({H.fold(s) for s in streams}))
    assert all(H.Wrapper(w).read(s) is not None for s in streams) and "(<li>#</li>)+" in H.pattern(w)
    rows = [(i, "http://h.example/x", p, 1) for i, p in enumerate(pages)] + [(None, None, None, 1), (99, "x", "", 1), (98, None, "<!-- <p>", 1), (97, None, "<a <b 'c", 1)]
    df = H.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, host int"))
    got = {r.page_id: r for r in df.collect()}
    assert got[8].text == "i0\ni1\ni2\ni3\ni4\nbold & x\ny5" and got[8].title == "T5" and got[None].text is None and got[99].text == ""
    assert H.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_template_is_on_all_different_pages(spark):
    page = lambda n, note: f"<html><div><h2>same</h2><p>text {n}</p>{note}</div></html>"
    rows = [(1, "http://a.x/1", page(1, "")), (1, "http://a.x/1", page(1, "")), (2, "http://a.x/2", page(1, ""))]
    rows += [(10 + n, f"http://b.x/{n}", page(n, "<h3>note</h3>" if n < 2 else "")) for n in range(9)] + [(20, "http://b.x/e", ""), (21, "http://b.x/n", None)]
    got = {r.page_id: r.text for r in H.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == got[2] == "same\ntext 1"
    assert got[10] == "text 0\nnote" and got[11] == "text 1\nnote" and got[15] == "text 5" and got[20] == "" and got[21] is None


def test_links_and_headers_in_articles_stay(spark):
    page = lambda n: f"<nav><a>home {n}</a></nav><header><a>site</a></header><article><header><h1>Head {n}</h1></header><p>See {n} the <a>guide {n}</a>, <a>x{n}</a>y{n}.</p></article>"
    rows = [(n, f"http://a.x/{n}", page(n)) for n in range(3)]
    got = {r.page_id: r.text for r in H.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == "Head 1\nSee 1 the guide 1, x1y1."


def test_lists_equal_on_all_pages_go(spark):
    page = lambda n: f"<div><h1>Head {n}</h1>{''.join(f'<p>p{n}{i}</p>' for i in range(n + 1))}</div><ul><li>Terms</li><li>Imprint</li></ul>"
    rows = [(n, f"http://a.x/{n}", page(n)) for n in range(3)]
    got = {r.page_id: r.text for r in H.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == "Head 1\np10\np11"


def test_long_pages_and_repeated_groups(spark):
    rng = random.Random(1)
    rec = "".join(f"<c{i}>%s</c{i}>" for i in range(40))
    pages = ["<b>x</b>" + "".join(rec % tuple(f"t{k}{r}{i}" for i in range(40)) for r in range(k)) for k in (2, 3, 5)]
    w = H.infer(list({H.siblings(H.fold(H.tokens(p)[0])) for p in pages}))
    assert H.pattern(w).count("+") == 1 and len(H.unfold(w)) == 123  # a record of 120 tokens is one repeated group
    parts = ["<ul><li><a>x</a></li><li><a>y</a><b>new</b></li><li><a>z</a></li></ul>"]
    assert H.pattern(H.siblings(H.fold(H.tokens(parts[0])[0]))) == "<ul>(<li><a>#</a>(<b>#</b>)?</li>)+</ul>"
    long = [[rng.choice(["a", "b", "c", "/a", "/b", H.TEXT]) for _ in range(10000)] for _ in range(2)]
    w = H.Wrapper(H.infer([H.siblings(H.fold(s)) for s in long]))
    assert all(w.read(s) is not None for s in long)
    # hosts of many different streams are aligned in parts
    rows = [(i, "http://h.x/", "".join(f"<p{rng.randrange(3)}>t{i}{j}</p>" for j in range(i % 7 + 1))) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = H.infer_wrappers(df, streams=5).collect()
    assert len(found) == 1
    w = H.Wrapper(H._tuples(json.loads(found[0].wrapper)))
    assert all(w.read(H.tokens(p)[0]) is not None for _, _, p in rows)


@pytest.mark.parametrize("seed", range(20))
def test_common_items_are_a_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = (tuple(rng.choice("abcd") for _ in range(rng.randrange(0, 30))) for _ in range(2))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    got = H.common_items(a, b)
    assert len(got) == table[-1][-1] and all(a[i] == b[j] for i, j in got)
    assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:]))


@pytest.mark.parametrize("seed", range(20))
def test_merge_accepts_both(seed):
    rng = random.Random(seed)
    streams = [[rng.choice(["a", "/a", "b", "p", H.TEXT]) for _ in range(rng.randrange(1, 30))] for _ in range(6)]
    w = H.Wrapper(H.infer([H.siblings(H.fold(s)) for s in streams]))
    assert all(w.read(s) is not None for s in streams)


# 5, 7, 8, 10


def test_line_rules(spark):
    rows = [(i, f"common line\nown {i} a b c d e f\nCOMMON   line", "h") for i in range(12)] + [(50, "common line", "other"), (51, "Common line", "h"), (52, None, "h"), (53, "", None)]
    got = {r.doc_id: r.text for r in line_frequency_rules(docs(spark, *rows), min_kept=0.3).collect()}
    assert got[3] == "own 3 a b c d e f" and got[50] == "common line" and 51 not in got and got[52] is None and got[53] == ""
    assert line_frequency_rules(odd(spark)).count() == odd(spark).count() and line_frequency_rules(odd(spark).limit(0)).collect() == []


def test_mixing(spark):
    e = water_fill({"a": 10, "b": 1000, "c": 100, "z": 0}, {"a": 1, "b": 1, "c": 1, "z": 1}, 900, 4)
    assert e["a"] == 4 and e["c"] == 4 and abs(e["b"] - 0.46) < 1e-9 and e["z"] == 0
    df = docs(spark, *[(i, "x" * 10, "ab"[i % 4 == 0]) for i in range(400)], (None, "x" * 10, None))
    out = mix_sources(df, {"a": 3, "b": 1, None: 0.1}, total=8000)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] / n["b"] - 3) < 0.5 and out.columns == df.columns
    assert mix_sources(df, seed=1).collect() == mix_sources(df, seed=1).collect() and mix_sources(odd(spark).limit(0)).collect() == []


def test_line_rules_contents_and_ties(spark):
    rows = [(i, f"twelve\nown {i} a b c d e f\nten", "h") if i < 10 else (i, f"twelve\nown {i} a b c d e f", "h") for i in range(12)]
    got = {r.doc_id: r.text for r in line_frequency_rules(docs(spark, *rows), max_docs=10).collect()}
    assert got == {i: f"own {i} a b c d e f" + ("\nten" if i < 10 else "") for i in range(12)}  # ten documents are at the limit
    small = line_frequency_rules(docs(spark, *rows), max_docs=10, broadcast_bytes=0)
    assert {r.doc_id: r.text for r in small.collect()} == got and small.columns == docs(spark).columns
    before = sorted(map(str, odd(spark).collect()))
    assert sorted(map(str, line_frequency_rules(odd(spark)).collect())) == before


def test_mixing_odd(spark):
    df = odd(spark).withColumn("copy_no", F.lit("x"))
    out = mix_sources(df, copy_col="copy_no", total=4 * 10**9)
    assert dict(out.dtypes)["copy_no"] == "int" and out.columns == df.columns
    n = {}
    for r in out.collect():
        n[str(r.doc_id), r.copy_no] = n.get((str(r.doc_id), r.copy_no), 0) + 1
    assert all(n[i, c] == k for i, k in (("1", 1), ("2", 1), ("3", 2), ("None", 2), ("5", 1)) for c in (1, 2, 3, 4)) and ("1", 5) not in n
    assert mix_sources(df.limit(0), copy_col="copy_no").collect() == []


def test_exact(spark):
    got = exact_dedup(odd(spark))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "3", "4", "5", "6"]
    assert exact_dedup(odd(spark), broadcast_bytes=0).count() == 6 and exact_dedup(odd(spark).limit(0)).collect() == []


def test_chat_odd(spark):
    rows = [(1, 1 << 40, "user", "big\nturn", "x"), (1, (1 << 40) + 1, "assistant", "", "x"), (1, 3, None, None, "x"), (2, None, "user", "t", "x"), (None, 1, "user", "t", "x"), (1, 3, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, seq string")
    got = chat.format_chat(chat.stream_events(df)).collect()
    assert [(r.conv_id, r.n_messages) for r in got] == [(1, 3)]
    assert got[0].text == "<|im_start|>unknown\n<|im_end|>\n<|im_start|>user\nbig\nturn<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    log = [("c", "1", "message", "a", "user", "x", 0), ("c", "2", "message", "b", "user", "y", 0), ("c", "3", "regenerate", "a", "user", None, 0), ("c", "4", "delta", "a", "user", "z", 0)]
    events = spark.createDataFrame(log, "conv_id string, seq string, kind string, msg string, role string, text string, n_messages int")
    assert [(r.msg, r.text) for r in chat.fold_events(events).collect()] == [("a", "z")]
    kinds = {r.kind for r in chat.stream_events(df).collect()}
    assert kinds == set(chat.KINDS)


@pytest.mark.parametrize("seed", range(4))
def test_chat_fold(spark, seed):
    rng = random.Random(seed)
    log = [(rng.randrange(3), s, rng.choice(chat.KINDS), rng.randrange(4), rng.choice(["user", None]), rng.choice(["a", "b", None, "<|x"])) for s in range(80)] + [(None, 1, "message", 1, "u", "t"), (1, None, "delta", 1, "u", "t"), (1, 99, "other", 1, "u", "t")]
    final = {}
    for c, s, kind, m, role, t in sorted((e for e in log if None not in e[:4] and e[2] in chat.KINDS), key=lambda e: e[1]):
        t = t or ""
        if kind == "regenerate":
            for k in [k for k in final if k[0] == c and k[1] >= m]:
                final[k] = None if k[1] > m else ""
            final = {k: v for k, v in final.items() if v is not None and not (k == (c, m) and v == "")}
        elif kind == "delta":
            final[c, m] = final.get((c, m), "") + t
        else:
            final[c, m] = t
    df = spark.createDataFrame(log + log[:5], "conv_id int, seq int, kind string, msg int, role string, text string")
    got = {(r.conv_id, r.msg): r.text for r in chat.fold_events(df).collect()}
    assert got == final
    assert chat.format_chat(df.limit(0)).collect() == []


# 6


def test_token_store(spark):
    df = docs(spark, *[(i, f"some text {i} " * 20, "s") for i in range(60)]).unionByName(odd(spark))
    index = K.write_tokens(df)
    t = bpe.transducer(bpe.VOCABULARY, bpe.WINDOW)
    wanted = sorted(str((r.doc_id, None if r.text is None else t.core.encode_ordinary(r.text))) for r in df.collect())
    assert sorted(str((r.doc_id, r.token_ids)) for r in K.read_tokens(index).collect()) == wanted
    assert K.read_tokens(index.where("doc_id = 7")).count() == 1 and K.write_tokens(df.limit(0)).collect() == []
    # the frames by zstandard alone
    rows, got = index.collect(), []
    for r in rows:
        folder = r.root.removeprefix("file:")
        raw = open(f"{folder}/{r.dict_hash}.dict", "rb").read()
        assert hashlib.sha256(raw).hexdigest() == r.dict_hash
        if r.shard:
            with open(f"{folder}/{r.shard}", "rb") as f:
                f.seek(r.offset)
                frame = f.read(r.length)
            ids = np.frombuffer(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).decompress(frame), "<u2").tolist()
            assert len(ids) == r.n_tokens
        got.append(str((r.doc_id, ids if r.shard else None)))
    assert sorted(got) == wanted and len({r.dict_hash for r in rows}) == 1


def test_dictionary_is_of_all_rows(spark):
    rng = random.Random(1)
    phrase = [bytes(rng.randrange(256) for _ in range(200)) for _ in range(8)]
    rows = [(b"".join(rng.choice(phrase) for _ in range(20)) + bytes(rng.randrange(256) for _ in range(50)),) for _ in range(400)]
    raw = K.dictionary_of_all(spark.createDataFrame(rows, "ids binary").repartition(5), 1 << 13, chunk_bytes=1 << 16, fan_in=3)
    assert 0 < len(raw) <= 1 << 13
    with_it, without = (sum(len(zstandard.ZstdCompressor(level=3, **o).compress(x)) for (x,) in rows) for o in ({"dict_data": zstandard.ZstdCompressionDict(raw)}, {}))
    assert with_it < 0.5 * without


# 9


def words_of(t):
    h, begin, end, _ = V.words([t])
    return h, begin, end


def same_class(got):
    by = {}
    for r in got:
        by.setdefault((r.class_id, r.class_begin), set()).add(r.doc_id)
    return {(i, j) for ids in by.values() for i in ids for j in ids if j < i}


def test_passages(spark):
    rng = random.Random(5)
    rows, planted = [], set()
    for g in range(20):
        p = text(rng, 60)
        for j in range(3):
            q = edited(rng, p, 0.04 * (g % 3)) if j else p
            rows.append((10 * g + j, text(rng, 40 + 7 * j) + " " + q + " " + text(rng, 30), "s"))
        planted |= {(10 * g + i, 10 * g + j) for i in range(3) for j in range(i)}
    rows += [(1000 + i, text(rng, 150), "s") for i in range(20)]
    by = {i: t for i, t, _ in rows}
    got = P.repeated_passages(docs(spark, *rows)).collect()
    pairs = same_class(got)
    assert len(pairs & planted) >= 0.9 * len(planted) and pairs <= planted
    assert all(r.n_links == sum(r.doc_id in p for p in pairs) and r.n_words >= 40 for r in got)
    same = [r for r in got if r.similarity == 1]
    assert same and all(by[r.doc_id][r.begin : r.end] in by[r.other_id] or by[r.other_id][r.other_begin : r.other_end] in by[r.doc_id] for r in same)
    odd_rows = P.repeated_passages(odd(spark)).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in odd_rows} == {(3, 3, 1), (4, 3, 1)}
    assert P.repeated_passages(odd(spark).limit(0)).collect() == []


@pytest.mark.parametrize("frequent", [200, 3])
def test_passages_of_all_pairs(spark, frequent):
    rng = random.Random(8)
    p, q = text(rng, 60), text(rng, 60)
    rows = [(10 + i, text(rng, 20) + " " + p + " " + text(rng, 20), "s") for i in range(4)]
    words = q.split()
    rows += [(i, text(rng, 30) + " " + " ".join(words[6 * i : 6 * i + 12]) + " " + text(rng, 30), "s") for i in range(1, 9)]  # parts of q before
    rows += [(30 + i, text(rng, 20) + " " + q + " " + text(rng, 20), "s") for i in range(2)]
    rows += [(n, rows[n - 40][1], "s") for n in (40, 41)] + [(5, rows[0][1], "s")]  # copies, one with the smallest id
    by = {i: t for i, t, _ in rows}
    rows = [(i, t, s) for i, t, s in rows if by[i] == t]
    wanted = {(i, j) for i in by for j in by if j < i and any(x in by[i] and x in by[j] for x in (p, q))}
    assert len(wanted) > 20
    got = P.repeated_passages(docs(spark, *rows), frequent=frequent).collect()
    assert same_class(got) == wanted
    for r in got:
        assert all(x not in by[r.doc_id] or x in by[r.doc_id][r.begin : r.end] for x in (p, q))


@pytest.mark.parametrize("frequent", [200, 3])
def test_passages_against_brute_force(spark, frequent):
    """Seeds of one passage were in other documents before; the first documents hold pieces only."""
    rng = random.Random(11)
    passages = [text(rng, 88) for _ in range(4)]
    rows = []
    for n, p in enumerate(passages):
        w = p.split()
        rows += [(100 * n + i, text(rng, 25) + " " + " ".join(w[8 * i : 8 * i + 24]) + " " + text(rng, 25), "s") for i in range(9)]
        rows += [(100 * n + 50 + i, text(rng, 25) + " " + edited(rng, p, 0.02 * i) + " " + text(rng, 25), "s") for i in range(3)]
    hashes = {i: words_of(t)[0] for i, t, _ in rows}
    brute = set()
    for i, j in combinations(sorted(hashes), 2):
        score, x0, x1, y0, y1 = P.align(hashes[i], hashes[j], -200, 200)
        if min(x1 - x0, y1 - y0) >= 40 and score >= 0.6 * max(x1 - x0, y1 - y0):
            brute.add((j, i))
    assert len(brute) >= 12
    assert same_class(P.repeated_passages(docs(spark, *rows), frequent=frequent).collect()) == brute


def test_passages_longer_than_a_common_line(spark):
    """A line of 30 words is in all texts; pairs go on after it for 14 words without another seed in a row."""
    rng = random.Random(21)
    line = text(rng, 30)
    rows = [(i, text(rng, 30) + " " + line + " " + text(rng, 30), "s") for i in range(8)]
    wanted = set()
    for n in range(6):
        more = text(rng, 14).split()
        again = [text(rng, 1) if m % 5 == 4 else x for m, x in enumerate(more)]
        rows += [(100 + 10 * n + m, text(rng, 30) + " " + line + " " + " ".join(t) + " " + text(rng, 30), "s") for m, t in enumerate((more, again))]
        wanted.add((101 + 10 * n, 100 + 10 * n))
    assert wanted <= same_class(P.repeated_passages(docs(spark, *rows), frequent=3).collect())


def test_passages_of_frequent_and_rare_seeds(spark):
    """14 words that are in all texts, changes in every fifth word, and 12 words of two texts only: few seeds of either kind."""
    rng = random.Random(22)
    line, wanted = text(rng, 14), set()
    rows = [(i, text(rng, 30) + " " + line + " " + text(rng, 30), "s") for i in range(8)]
    for n in range(20):
        mid, end = text(rng, 15).split(), text(rng, 12)
        for m in range(2):
            mid = [text(rng, 1) if m and k % 5 == 4 else x for k, x in enumerate(mid)]
            rows.append((100 + 10 * n + m, text(rng, 30) + " " + line + " " + " ".join(mid) + " " + end + " " + text(rng, 30), "s"))
        wanted.add((101 + 10 * n, 100 + 10 * n))
    assert wanted <= same_class(P.repeated_passages(docs(spark, *rows), frequent=3).collect())


def test_passages_of_one_word_on_and_on(spark, monkeypatch):
    """Runs of a word are one class with a number of alignments in proportion to the texts; the first text's run is no passage."""
    rng = random.Random(23)
    rows = [(n, text(rng, 20 + n) + " and" * (20 if n == 0 else 41 + 3 * n) + " " + text(rng, 30), "s") for n in range(40)]
    found, aligned = [], P._aligned
    monkeypatch.setattr(P, "_aligned", lambda source, chains, *more: found.append(chains.count()) or aligned(source, chains, *more))
    got = P.repeated_passages(docs(spark, *rows), frequent=3).collect()
    assert {(n, m) for n in range(1, 40) for m in range(1, n)} == same_class(got)
    assert sum(found) <= 4 * len(rows)
    by = {i: t for i, t, _ in rows}
    assert all(r.n_links == 38 and by[r.doc_id][r.begin : r.end].count("and") >= 41 + 3 * min(r.doc_id, 38) for r in got)


def test_passages_between_gaps(spark):
    """Ten exact passages of 60 words with 20 other words between them are all found."""
    rng = random.Random(4)
    parts = [text(rng, 60) for _ in range(10)]
    a, b = (" ".join(p + " " + text(rng, 20) for p in parts) for _ in range(2))
    got = {}
    for r in P.repeated_passages(docs(spark, (1, a, "s"), (2, b, "s"))).collect():
        got.setdefault(r.doc_id, []).append((a if r.doc_id == 1 else b)[r.begin : r.end])
    assert all(sum(p in t for t in got[i]) == 1 for p in parts for i in (1, 2))


@pytest.mark.parametrize("seed", range(30))
def test_chains_score_like_brute_force(seed):
    rng = random.Random(seed)
    n = rng.randrange(2, 14)
    points = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(n)})
    x, y = (np.array(c) for c in zip(*points))
    best = {}

    def score(i):
        if i not in best:
            before = [score(j) - 0.25 * (x[i] - x[j] + y[i] - y[j]) for j in range(len(x)) if x[j] < x[i] and y[j] < y[i]]
            best[i] = 5 + max([0.0, *before])
        return best[i]

    got = P.chains(x, y, 5, 0.25, 1000)
    assert sorted(i for c in got for i in c) == list(range(len(x)))
    assert all((np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all() for c in got if (y - x != (y - x)[0]).any())
    c = got[0]
    if (y - x != (y - x)[0]).any():
        assert abs(5 * len(c) - 0.25 * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]]) - max(score(i) for i in range(len(x)))) < 1e-9


def brute_align(x, y):
    best = 0
    h = np.zeros((len(x) + 1, len(y) + 1), dtype=int)
    for i in range(len(x)):
        for j in range(len(y)):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if x[i] == y[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
            best = max(best, h[i + 1, j + 1])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_align(seed):
    rng = random.Random(seed)
    x = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 30))])
    y = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 30))])
    score, x0, x1, y0, y1 = P.align(x, y, -40, 40)
    assert score == brute_align(x, y)
    if score:
        assert brute_align(x[x0:x1], y[y0:y1]) == score


def test_align_many_at_once():
    rng = random.Random(3)
    word = lambda n: np.array([rng.randrange(6) for _ in range(n)], dtype=np.int64)
    tasks = [(word(rng.randrange(1, 60)), word(rng.randrange(1, 60)), *sorted((rng.randrange(-70, 70), rng.randrange(-70, 70)))) for _ in range(200)]
    for penalty in (1, 4):
        for (x, y, low, high), (score, x0, x1, y0, y1) in zip(tasks, P.align_all(tasks, penalty)):
            assert score == P.align(x, y, low, high, penalty)[0]
            if score:
                assert P.align(x[x0:x1], y[y0:y1], low + x0 - y0, high + x0 - y0, penalty) == (score, 0, x1 - x0, 0, y1 - y0)


# Pipeline


def test_pipeline_against_brute_force(spark):
    """Each stage, written and read again, against a plain version of it."""
    every = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    assert len(corpus_pipeline.STAGES) == 5
    text_of = {r.doc_id: r.text for r in every}
    known = sorted(i for i in labels if i in text_of)
    m = SubwordClassifier().fit([text_of[i] for i in known], [labels[i] for i in known])
    now = [r for r in every if m.probabilities([r.text])[0, 1] >= 0.5]
    assert 0 < len(now) < len(every)
    first = {}
    for r in sorted(now, key=lambda r: r.doc_id):
        first.setdefault(r.text, r)
    now = list(first.values())
    group = {r.doc_id: r.doc_id for r in now}
    for a, b in near_brute([(r.doc_id, r.text, "s") for r in now]):
        low, high = sorted((group[a], group[b]))
        group = {i: low if g == high else g for i, g in group.items()}
    now = [r for r in now if group[r.doc_id] == r.doc_id]
    sizes = {}
    for r in now:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text)
    epochs = {s: round(e, 9) for s, e in water_fill(sizes, dict.fromkeys(sizes, 1.0), sum(sizes.values()), 4.0).items()}
    draw = lambda i: int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:12], 16) / (1 << 48)
    t = bpe.transducer(bpe.VOCABULARY, bpe.WINDOW)
    wanted = [str((r.doc_id, r.text, t.core.encode_ordinary(r.text))) for r in now for _ in range(int(epochs[r.source]) + (draw(r.doc_id) < epochs[r.source] % 1))]
    got = corpus_pipeline.run(spark, DIR).collect()
    assert sorted(str((r.doc_id, r.text, r.token_ids)) for r in got) == sorted(wanted)


def test_near_stage_loses_no_pair_in_large_buckets(spark, monkeypatch):
    rows, least, most = sliding_windows(2)
    monkeypatch.setattr(N, "near_groups", functools.partial(N.near_groups, bands=2, rows=1, pairwise=1))
    got = {r.doc_id for r in corpus_pipeline.near(spark, docs(spark, *rows), DIR).collect()}
    assert least <= got <= most


def test_stages_with_odd_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for df, n in ((odd(spark), 7), (odd(spark).limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:3]:
            df = stage(spark, df, str(tmp_path))
            assert df.columns == odd(spark).columns
        ids = sorted(str(r.doc_id) for r in df.collect())
        assert ids == (["1", "2", "3", "5", "6"] if n else [])
        for _, stage in corpus_pipeline.STAGES[3:]:
            df = stage(spark, df, str(tmp_path))
        assert {r.doc_id for r in df.collect()} <= {1, 2, 3, 5, 6}
