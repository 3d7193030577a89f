"""The corpus pipeline: classify, remove exact and near copies, mix, tokenize."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.bpe import bpe_round_trip
from lectern.llm.exact_dedup import exact_dedup
from lectern.llm.mixing import mix_sources
from lectern.llm.near_dedup import near_dedup
from lectern.llm.quality import quality_filter
from lectern.session import materialize, table

#: SQL can't express the classifier; the pipeline is tested against brute-force versions of its stages, one after another.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject.

    Null texts stay, empty ones are judged by the classifier's bias; repeated rows are judged alike; without labels of both classes all stay.
    """
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the smallest id, nulls last. Null texts all stay; empty ones are one text; repeated rows are copies."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest id, nulls last. Null texts and those without a word all stay."""
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources have equal weights, four epochs at most.

    A null source is one of its own; sources without any character go. Draws depend on the id, so that repeated ids share theirs.
    """
    return mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text decoded from them. Null texts have null ids, empty ones none."""
    return bpe_round_trip(docs)


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", exact),
    ("minhash near-dedup", near),
    ("source mixing", mix),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each stage's result is written and read again.

    Long texts are read whole in all stages; additional columns are kept, whatever their names; empty tables give no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
