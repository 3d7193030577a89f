"""Near-duplicate removal: improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lectern.llm import vectext
from lectern.llm.components import connected_components
from lectern.llm.keyfilter import mark_possible, semi_possible
from lectern.session import BROADCAST_BYTES, bounded_batches, materialize, small_or_shuffled

_R, _ID, _TEXT = "__nd_row", "__nd_id", "__nd_text"
_SLICES = 256


def _key(text_col: str, id_col: str) -> Column:
    """128 bits for a row: rows with equal id and text share them."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat(part(id_col), F.lit("\0"), part(text_col))))


def _rows(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(_key(text_col, id_col).alias(_R), F.col(id_col).alias(_ID), F.col(text_col).alias(_TEXT))


def document_frequencies(docs: DataFrame, text_col: str = "text", shingle: int = 3, buckets: int = 1 << 20) -> tuple[np.ndarray, int]:
    """How many documents hold a shingle of each of ``buckets`` hash buckets, and how many documents there are.

    All documents are counted. The array has a fixed size: each task adds up its own one,
    and the slices of the arrays are added up in parallel. What comes to the driver is
    8 bytes for a bucket, whatever the size of the corpus.
    """
    width = buckets // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(buckets, dtype=np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for a, b in vectext.groups(texts):
                h, _, _, first = vectext.words(texts[a:b])
                for i in range(b - a):
                    s = vectext.shingles(h[first[i] : first[i + 1]], shingle)
                    total[np.unique(s & np.uint64(buckets - 1)).astype(np.int64)] += 1
        if n:
            narrow = total.astype(np.int32) if total.max() < 2**31 else total
            parts = [narrow[i * width : (i + 1) * width].tobytes() for i in range(_SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array([*range(_SLICES), -1], pa.int32()), pa.array([*parts, b""], pa.binary()), pa.array([0] * _SLICES + [n], pa.int64())], ["slice", "counts", "n"])
        vectext.give_back()

    def add(key, table):
        total = np.zeros(width, dtype=np.int64)
        for x in table.column("counts"):
            x = x.as_py()
            if x:
                total += np.frombuffer(x, dtype=np.int32 if len(x) == 4 * width else np.int64)
        n = sum(table.column("n").to_pylist())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    schema = "slice int, counts binary, n bigint"
    found = docs.select(text_col).mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).collect()
    total, n = np.zeros(buckets, dtype=np.int64), 0
    for r in found:
        if r["slice"] < 0:
            n = r["n"]
        else:
            total[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], dtype=np.int64)
    return total, n


def idf_of(counts: np.ndarray, n: int) -> np.ndarray:
    return (1.0 + np.log((1.0 + n) / (1.0 + np.minimum(counts, n)))).astype(np.float32)


def weighted_shingles(word_hashes: np.ndarray, idf: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of one document in ascending order and their TF-IDF weights."""
    s, tf = np.unique(vectext.shingles(word_hashes, shingle), return_counts=True)
    return s, tf.astype(np.float32) * idf[(s & np.uint64(len(idf) - 1)).astype(np.int64)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller over sum of the larger weights; 0 if either side is empty."""
    if len(a[0]) == 0 or len(b[0]) == 0:
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][at] == b[0]
    common = float(np.minimum(a[1][at[hit]], b[1][hit]).sum(dtype=np.float64))
    return common / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - common)


class Sampler:
    """Improved consistent weighted sampling with ``k`` samples.

    For shingle s of weight S and sample j: r and c are Gamma(2, 1), beta is uniform, all
    from the hash of (s, j); t = floor(ln S / r + beta) and ln a = ln c - r (t - beta) - r.
    The sample is the (s, t) with the smallest a; two documents agree on a sample with the
    probability of their weighted Jaccard similarity. The distributions are tables of
    65,536 quantiles.
    """

    BLOCK = 1024

    def __init__(self, k: int, seed: int = 11):
        j = np.arange(k, dtype=np.uint64)
        self.a, self.b = vectext.mix(j, seed) | np.uint64(1), vectext.mix(j, seed + 1)
        q = (np.arange(65536) + 0.5) / 65536
        lo, hi = np.zeros(65536), np.full(65536, 64.0)
        for _ in range(60):
            mid = (lo + hi) / 2
            below = 1 - (1 + mid) * np.exp(-mid) < q
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        self.gamma, self.log_gamma = lo.astype(np.float32), np.log(lo).astype(np.float32)
        self.uniform = ((np.arange(65536) + 0.5) / 65536).astype(np.float32)
        self.seeds = vectext.mix(j, seed + 2)

    def __call__(self, s: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """``k`` hashes, one for each sample; ``s`` must be sorted and not empty."""
        best = star = level = None
        for i in range(0, len(s), self.BLOCK):
            x = s[i : i + self.BLOCK, None] * self.a + self.b
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            u = x.view(np.uint16).reshape(len(x), -1, 4)
            r, beta = self.gamma[u[:, :, 3]], self.uniform[u[:, :, 1]]
            t = np.floor(np.log(weight[i : i + self.BLOCK, None]) / r + beta)
            a = self.log_gamma[u[:, :, 2]] - r * (t - beta + 1)
            at = np.argmin(a, axis=0)
            cols = np.arange(len(self.a))
            low, one, lev = a[at, cols], s[i + at], t[at, cols].astype(np.int64)
            if best is None:
                best, star, level = low, one, lev
            else:
                less = low < best
                best, star, level = np.where(less, low, best), np.where(less, one, star), np.where(less, lev, level)
        return vectext.mix(star ^ vectext.mix(level.view(np.uint64), 5) ^ self.seeds)


def band_hashes(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    m = samples.reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        out = vectext.mix(out ^ m[:, j], j + 20)
    return out.view(np.int64)


def signatures(docs: DataFrame, idf, bands: int, rows: int, shingle: int, text_col: str, id_col: str) -> DataFrame:
    """``(row, id, hashes)`` for every row; no hashes where the text has no word."""
    source = _rows(docs, text_col, id_col)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sampler = idf.value, Sampler(bands * rows)
        for batch in batches:
            texts, out = batch.column(2).to_pylist(), []
            for a, b in vectext.groups(texts):
                h, _, _, first = vectext.words(texts[a:b])
                for i in range(b - a):
                    w = h[first[i] : first[i + 1]]
                    out.append(band_hashes(sampler(*weighted_shingles(w, table, shingle)), bands, rows) if len(w) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], [_R, _ID, "__nd_hashes"])
        vectext.give_back()

    schema = T.StructType([source.schema[_R], source.schema[_ID], T.StructField("__nd_hashes", T.ArrayType(T.LongType()))])
    return source.mapInArrow(sign, schema)


def _verify(pairs: DataFrame, docs: DataFrame, idf, shingle: int, threshold: float, text_col: str, id_col: str, limit: int, per_task: int = 4096) -> DataFrame:
    """Those of ``pairs (a, b)`` whose weighted Jaccard similarity reaches the threshold.

    The pairs of one ``a`` meet its text in one task, or in several if they are many.
    """
    pairs = materialize(pairs.distinct(), "pairs")
    tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(per_task)).cast("int").alias("tasks"))
    many = materialize(tasks, "pair-heads")
    salted = pairs.join(small_or_shuffled(many, 64, limit), "a").select("a", F.pmod(F.xxhash64("b"), "tasks").cast("int").alias("salt"), "b")
    none = F.lit(None).cast(pairs.schema["b"].dataType).alias("b")
    wants = salted.select(F.col("b.row").alias(_R), F.struct("a", "salt", "b").alias("want"))
    heads = many.select("a", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"), none)
    wants = wants.union(heads.select(F.col("a.row").alias(_R), F.struct("a", "salt", "b").alias("want")))
    # texts meet the pairs in one join; a bitmap keeps all others out of its shuffle
    wants = materialize(wants.groupBy(_R).agg(F.collect_list("want").alias("wants")), "wanted-texts")
    texts = semi_possible(_rows(docs, text_col, id_col).select(_R, _TEXT), wants, _R).join(wants, _R)
    both = texts.select(F.explode("wants").alias("want"), _TEXT).select("want.a", "want.salt", "want.b", _TEXT)
    both = both.withColumn("__nd_key", F.xxhash64("a", "salt")).withColumn("__nd_tail", F.col("b").isNotNull())
    both = both.withColumn("__nd_ar", F.col("a.row"))
    both = both.repartition("__nd_key").sortWithinPartitions("__nd_key", "__nd_ar", "salt", "__nd_tail").select("a", "b", "__nd_ar", "__nd_tail", _TEXT)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, head, vector = idf.value, None, None
        for batch in batches:
            texts, hits = batch.column(4).to_pylist(), []
            keys, tails = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b in vectext.groups(texts):
                h, _, _, first = vectext.words(texts[a:b])
                for i in range(a, b):
                    v = weighted_shingles(h[first[i - a] : first[i - a + 1]], table, shingle)
                    if not tails[i]:
                        head, vector = keys[i], v
                    elif head == keys[i] and weighted_jaccard(vector, v) >= threshold:
                        hits.append(i)
            yield batch.select(["a", "b"]).take(pa.array(hits, pa.int64()))
        vectext.give_back()

    return both.mapInArrow(compare, pairs.schema).distinct()


def prefix(s: np.ndarray, weight: np.ndarray, idf: np.ndarray, threshold: float) -> np.ndarray:
    """The rarest shingles of a document, up to where those left weigh less than ``threshold`` of all.

    Two documents whose weighted Jaccard similarity reaches the threshold have one of these in common: their common
    weight is at least that share of either, and what is rarer than the end of the shorter prefix is in both prefixes.
    """
    order = np.lexsort((s, -idf[(s & np.uint64(len(idf) - 1)).astype(np.int64)]))
    taken = np.cumsum(weight[order], dtype=np.float64)
    return s[order[: int(np.searchsorted(taken, (1 - threshold + 1e-6) * taken[-1])) + 1]]


def _rest_pairs(placed: DataFrame, docs: DataFrame, idf, shingle: int, threshold: float, text_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Edges of rows of equal shingles, and all pairs of ``placed (node, comp)`` that may reach the threshold between components.

    Exact, whatever the number of rows: pairs without a common shingle in their prefixes, or whose weights
    differ by more than the threshold allows, can't reach it. Of rows with equal shingles one takes part.
    """
    placed = materialize(placed.withColumn(_R, F.col("node.row")), "rest")
    source = semi_possible(_rows(docs, text_col, id_col).select(_R, _TEXT), placed, _R)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for a, b in vectext.groups(texts):
                h, _, _, first = vectext.words(texts[a:b])
                for i in range(b - a):
                    s, weight = weighted_shingles(h[first[i] : first[i + 1]], table, shingle)
                    form = hashlib.md5(s.tobytes() + weight.tobytes()).digest()
                    out.append((form, float(weight.sum(dtype=np.float64)), prefix(s, weight, table, threshold).view(np.int64) if len(s) else np.zeros(0, np.int64)))
            form, weight, rare = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(form, pa.binary()), pa.array(weight, pa.float64()), pa.array(rare, pa.list_(pa.int64()))], [_R, "form", "weight", "rare"])
        vectext.give_back()

    known = source.mapInArrow(facts, f"{_R} binary, form binary, weight double, rare array<bigint>").dropDuplicates([_R])
    known = materialize(placed.join(known, _R).select("node", "comp", "form", "weight", "rare"), "prefixes")
    forms = known.groupBy("form").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("form", "a")
    equal = materialize(known.join(materialize(forms, "forms"), "form").where("a <> node").select("a", F.col("node").alias("b")), "equal")
    rows = known.join(equal.select(F.col("b").alias("node")), "node", "left_anti").select("node", "comp", "weight", F.explode("rare").alias("s"))
    shared = materialize(rows.groupBy("s").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("s"), "rare-shingles")
    rows = materialize(semi_possible(rows, shared, "s").join(shared, "s"), "postings")
    # components meet first: rows of one component are never paired
    comps = materialize(rows.select("s", "comp").distinct(), "posted-components")
    meet = comps.withColumnRenamed("comp", "ca").join(comps.withColumnRenamed("comp", "cb"), "s").where("ca < cb")
    side = lambda n, c, w: rows.select("s", F.col("node").alias(n), F.col("comp").alias(c), F.col("weight").alias(w))
    pairs = meet.join(side("p", "ca", "wp"), ["s", "ca"]).join(side("q", "cb", "wq"), ["s", "cb"])
    pairs = pairs.where(F.least("wp", "wq") >= (threshold - 1e-6) * F.greatest("wp", "wq"))
    return equal, pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def near_groups(
    docs: DataFrame,
    threshold: float = 0.45,
    bands: int = 30,
    rows: int = 3,
    shingle: int = 3,
    buckets: int = 1 << 20,
    text_col: str = "text",
    id_col: str = "doc_id",
    broadcast_bytes: int = BROADCAST_BYTES,
    pairwise: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """``(node, comp)`` for rows with near copies, and the table of signatures.

    Rows that agree on a band are candidates: with the defaults 0.94 of the pairs at the threshold. In each
    bucket all are first compared with the smallest node; what then still lies in one bucket but in
    different components is compared pair by pair in buckets of up to ``pairwise`` rows, and in larger ones
    first by one row of each component if there are no more than ``pairwise`` components. Of larger buckets that
    are still split after that, all pairs of different components are compared, but those whose weights or rarest
    shingles show that they can't reach the threshold (``_rest_pairs``). So a bucket of n copies costs n comparisons.
    """
    docs = bounded_batches(docs)
    counts, n = document_frequencies(docs, text_col, shingle, buckets)
    idf = docs.sparkSession.sparkContext.broadcast(idf_of(counts, n))
    args = (docs, idf, shingle, threshold, text_col, id_col, broadcast_bytes)
    signed = materialize(signatures(docs, idf, bands, rows, shingle, text_col, id_col), "signatures")
    node = F.struct(F.col(_ID).isNull().alias("nil"), F.col(_ID).alias("id"), F.col(_R).alias("row"))
    members = signed.select(node.alias("node"), F.explode(F.array_distinct("__nd_hashes")).alias("h"))
    # firsts are combined on the map side, and a bitmap keeps hashes that occur once out of the join
    heads = materialize(members.groupBy("h").agg(F.min("node").alias("first"), F.count("*").alias("size")).where("size > 1"), "bucket-heads")
    members = semi_possible(members, heads, "h").join(heads, "h").where("size > 1")
    members = materialize(members.select("h", "node", "first", "size"), "buckets")
    pairs = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    edges = materialize(_verify(pairs, *args), "edges")
    comps = materialize(connected_components(edges), "components")

    def split(of: DataFrame, comps: DataFrame) -> DataFrame:
        placed = of.join(small_or_shuffled(comps, 112, broadcast_bytes), "node", "left").select("h", "node", "size", F.coalesce("comp", "node").alias("comp"))
        apart = placed.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("h")
        return materialize(placed.join(small_or_shuffled(materialize(apart, "split-buckets"), 16, broadcast_bytes), "h", "left_semi"), "split-buckets")

    apart = split(members, comps)
    one = apart.where(F.col("size") > pairwise).groupBy("h", "comp").agg(F.min("node").alias("node"))
    few = one.groupBy("h").count().where(F.col("count") <= pairwise).select("h")
    one = one.join(few, "h", "left_semi").select("h", "node", "comp")
    placed = materialize(apart.where(F.col("size") <= pairwise).select("h", "node", "comp").union(one), "split-buckets")
    left = placed.select("h", F.col("node").alias("a"), F.col("comp").alias("ca"))
    right = placed.select("h", F.col("node").alias("b"), F.col("comp").alias("cb"))
    rest = left.join(right, "h").where("a < b and ca <> cb").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    rest = materialize(rest, "pairs")
    more = None if rest.isEmpty() else materialize(_verify(rest, *args), "edges")
    if more is not None and not more.isEmpty():
        edges = edges.union(more)
        comps = materialize(connected_components(edges), "components")
    large = apart.where(F.col("size") > pairwise).select("h", "node", "size")
    if large.isEmpty():
        return comps, signed
    large = split(large, comps)
    if large.isEmpty():
        return comps, signed
    equal, rest = _rest_pairs(large.select("node", "comp").distinct(), docs, idf, shingle, threshold, text_col, id_col)
    more = materialize(_verify(rest, *args).union(equal), "edges")
    if not more.isEmpty():
        comps = materialize(connected_components(edges.union(more)), "components")
    return comps, signed


def near_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES, **options) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id.

    Two rows are near copies if the weighted Jaccard similarity of their TF-IDF shingles
    (``shingle`` words; letters and digits in lower case) reaches ``threshold``; groups
    are the connected components. Document frequencies are counted over all rows, by
    hashed shingle in ``buckets`` buckets; idf = 1 + ln((1 + n) / (1 + df)), so that no
    weight is 0. A text of fewer words is one shingle.

    Rows whose text is null, empty or without any word are near copies of nothing and
    stay. Rows repeated with equal id and text are one row. Null ids sort last; ties of
    ids go by the hash of the row. Long texts are read whole. Columns return unchanged; an empty table stays empty.
    """
    comps, signed = near_groups(docs, text_col=text_col, id_col=id_col, broadcast_bytes=broadcast_bytes, **options)
    gone = materialize(comps.where("node <> comp").select(F.col("node.row").alias(_R)), "near-copies")
    twice = materialize(signed.where(F.size("__nd_hashes") > 0).groupBy(_R).count().where("count > 1").select(_R), "repeated-rows")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = mark_possible(docs.withColumn(_R, _key(text_col, id_col)), gone, _R, "__nd_hit")
    kept = keyed.where("not __nd_hit").unionByName(keyed.where("__nd_hit").join(gone, _R, "left_anti"))
    if twice.isEmpty():
        return kept.select(*columns)
    some = small_or_shuffled(twice, 64, broadcast_bytes)
    order = Window.partitionBy(_R).orderBy(F.xxhash64(F.to_json(F.struct(*columns))))
    one = kept.join(some, _R, "left_semi").withColumn("__nd_n", F.row_number().over(order)).where("__nd_n = 1")
    return kept.join(some, _R, "left_anti").select(*columns).unionByName(one.select(*columns))
