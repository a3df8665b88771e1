"""The corpus pipeline: documents through five stages of sievewright.llm, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import exact_dedup, mixing, near_dedup, quality_mil, sentencepiece_lattice
from sievewright.llm.base import keep_judged, read, settled
from sievewright.llm.queries import model_file


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, doesn't reject."""
    return quality_mil.accepted(docs, quality_mil.fit(docs, read(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts; rows that repeat a doc_id, or have none, are judged by their own texts."""
    return keep_judged(docs, exact_dedup.exact_duplicates)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts; rows that repeat a doc_id, or have none, are judged by their own texts."""
    return keep_judged(docs, near_dedup.near_duplicates)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: some documents left out, others there twice."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids) of every document of the mix; ids decode to the text again, or round_trip is false."""
    return sentencepiece_lattice.encode(docs, sentencepiece_lattice.load(model_file()), keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: No SQL: a trained model, similarity components and a tokenizer aren't expressible; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(spark, lambda f=stage, d=docs: f(spark, d, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
