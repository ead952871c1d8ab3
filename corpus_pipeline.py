"""From raw documents to encoded training text, each stage over all that the one before kept.

Toxic documents go, boilerplate lines go, one document of each group of near copies stays, sources are mixed to
their target weights (a document that the mix takes twice is there twice), and what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orelens.llm import line_dedup, mixing, near_dedup, sentencepieces, toxicity
from orelens.llm.common import settle, table
from orelens.llm.queries import tokenizer_path


#: Documents with this percentage of their five-word shingles in common are near copies.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.stage(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.stage(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first_of_each(docs, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.stage(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, and its ids and their number."""
    return sentencepieces.encode(docs, tokenizer_path(), [c for c in docs.columns if c != "text"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("drop_toxic", drop_toxic),
    ("drop_boilerplate", drop_boilerplate),
    ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: A trained score and a Viterbi segmentation have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
