"""Quality classifier: supervised subword embeddings trained by numpy gradient descent."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lectern.llm import vectext
from lectern.session import bounded_batches


class SubwordClassifier:
    """Averaged vectors of hashed words and character n-grams, and a softmax layer.

    A word is what stands between white space, as written. The n-grams are those of the
    word with a space at either end (a text's first word has none before it), but for a whole word with both. Words and n-grams of each length share one table of
    ``buckets`` vectors. The model is linear in the table, so that a document's logits are
    the mean of its features' logits.
    """

    def __init__(self, buckets: int = 1 << 18, dim: int = 16, grams: Sequence[int] = (3, 4), classes: int = 2, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.buckets, self.grams, self.seed = buckets, tuple(grams), seed
        self.vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
        self.output = np.zeros((dim, classes), dtype=np.float32)
        self.bias = np.zeros(classes, dtype=np.float32)

    def features(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all features and the document of each (not in order)."""
        points, begins = vectext.code_points(texts)
        blank = _BLANK[np.minimum(points, len(_BLANK) - 1)]
        mask = np.uint64(self.buckets - 1)
        prefix = vectext.prefix_hash(np.where(blank, np.uint32(32), points))
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(begins))
        edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        out, docs = [(vectext.span_hash(prefix, begin, end, 1) & mask).astype(np.int32)], [doc[begin]]
        spaces = np.zeros(len(points) + 1, dtype=np.int32)
        np.cumsum(blank, out=spaces[1:])
        for n in self.grams:
            if len(points) < n:
                continue
            i = np.arange(len(points) - n + 1)
            i = i[(spaces[i + n - 1] == spaces[i + 1]) & (spaces[i + n] - spaces[i] < 2 + (n < 3)) & (doc[i] == doc[np.maximum(i + n - 2, i)])]
            out.append((vectext.span_hash(prefix, i, i + n, n) & mask).astype(np.int32))
            docs.append(doc[i])
        return np.concatenate(out), np.concatenate(docs)

    def fit(self, texts: Sequence[str | None], labels: Sequence[int], epochs: int = 8, rate: float = 0.5) -> SubwordClassifier:
        """Stochastic gradient descent, one document a step, with a falling rate."""
        rows = []
        for a, b in vectext.groups(texts):
            f, d = self.features(texts[a:b])
            order = np.argsort(d, kind="stable")
            cuts = np.searchsorted(d[order], np.arange(b - a + 1))
            rows += [np.unique(f[order][cuts[i] : cuts[i + 1]], return_counts=True) for i in range(b - a)]
        rng, step, steps = np.random.default_rng(self.seed), 0, epochs * len(rows)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                f, n = rows[i]
                now = np.float32(rate * (1 - step / steps))
                step += 1
                if not len(f):
                    continue
                share = (n / n.sum()).astype(np.float32)
                v = self.vectors[f]
                mean = share @ v
                z = mean @ self.output + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = self.output @ p
                self.output -= now * np.outer(mean, p)
                self.bias -= now * p
                # each feature moves in proportion to its share; scaled so that a document's mean moves by the rate
                self.vectors[f] = v - now * np.outer(share / (share @ share), back)
        return self

    def weights(self) -> np.ndarray:
        """Logits of each bucket."""
        return (self.vectors @ self.output).astype(np.float32)

    def probabilities(self, texts: Sequence[str | None], weights: np.ndarray | None = None) -> np.ndarray:
        """Of each class for each text; texts without features have the bias alone."""
        w = self.weights() if weights is None else weights
        out = np.empty((len(texts), w.shape[1]), dtype=np.float64)
        for a, b in vectext.groups(texts):
            f, d = self.features(texts[a:b])
            n = np.maximum(np.bincount(d, minlength=b - a), 1)
            for c in range(w.shape[1]):
                out[a:b, c] = np.bincount(d, weights=w[f, c], minlength=b - a) / n + self.bias[c]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


_BLANK = np.array([chr(i).isspace() for i in range(0x3001)] + [False])


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = 4000, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", **options) -> SubwordClassifier | None:
    """A classifier fitted on at most ``sample`` labelled rows, those with the smallest hash of the id.

    ``sample`` bounds what the driver holds; the rows are the same however the tables are
    split. Null ids or labels, labels other than 0 and 1, and null texts are left out; of repeated ids one
    row counts. None if not both classes are left.
    """
    few = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).alias("__qc_y"))
    few = few.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    texts = docs.select(F.col(id_col), F.col(text_col).alias("__qc_text")).where(F.col("__qc_text").isNotNull())
    # at most ``sample`` ids are broadcast; of several texts under one id the smallest comes to the driver
    rows = texts.join(F.broadcast(few), id_col).groupBy(id_col).agg(F.min("__qc_text").alias("__qc_text"), F.min("__qc_y").alias("__qc_y")).toPandas()
    rows = rows.sort_values([id_col, "__qc_text"])
    if rows["__qc_y"].nunique() < 2:
        return None
    return SubwordClassifier(**options).fit(rows["__qc_text"].tolist(), rows["__qc_y"].astype(int).tolist())


def score_quality(docs: DataFrame, model: SubwordClassifier | None, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with the probability of good quality, over whole texts.

    Null texts score null, as do all if there is no model; empty texts score what the bias
    says. A column named as the score is replaced.
    """
    rest = bounded_batches(docs).drop(score_col)
    if model is None:
        return rest.withColumn(score_col, F.lit(None).cast("double"))
    shared = docs.sparkSession.sparkContext.broadcast((model.buckets, model.grams, model.bias, model.weights()))
    schema = T.StructType([*rest.schema, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, grams, bias, w = shared.value
        m = SubwordClassifier(1, 1, grams)
        m.buckets, m.bias = buckets, bias
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            p = m.probabilities(texts, w)[:, 1] if texts else np.zeros(0)
            score = pa.array([None if t is None else float(x) for t, x in zip(texts, p)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], schema.names)
        vectext.give_back()

    return rest.mapInArrow(run, schema)


def quality_filter(docs: DataFrame, labels: DataFrame, min_score: float = 0.5, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs`` that the classifier doesn't reject, with unchanged columns.

    A row is rejected if its score is below ``min_score``. Rows without a score (null text,
    or no model for want of labels) stay. A score of exactly ``min_score`` is enough. Long texts are scored whole,
    repeated rows each. Columns may have any names but those beginning with ``__qc_``. An empty table stays empty.
    """
    model = train_quality(docs, labels, text_col=text_col, id_col=id_col, **options)
    scored = score_quality(docs, model, text_col, "__qc_score")
    return scored.where(F.col("__qc_score").isNull() | (F.col("__qc_score") >= min_score)).select(*[F.col(f"`{c}`") for c in docs.columns])
