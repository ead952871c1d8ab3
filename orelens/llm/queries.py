"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, line_dedup, mixing, near_dedup, secret_scan, sentencepieces, tiff_media, toxicity, url_filter, vector_topk
from .common import table


def tokenizer_path() -> str:
    """The public SentencePiece model used by default; any model file's path can be given instead."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, "source", "text").drop("source")


def line_dedup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on raw pages, grouped by the host in their urls."""
    pages = table(spark, sf_dir, "pages").select("page_id", line_dedup.host_of(F.col("url")).alias("host"), "html")
    return line_dedup.drop_boilerplate(pages, "host", "html").drop("host")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat(table(spark, sf_dir, "conversations"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"], verify=True)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = url_filter.labels_of(table(spark, sf_dir, "labels"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), labels)


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff_media.digest(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.top_k(table(spark, sf_dir, "embeddings"), 10, "vec_id % 100 = 0")


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_secret_scan,
        op3_chat_format,
        op4_toxicity,
        op5_mixing,
        op6_sentencepiece,
        op7_near_dedup,
        op8_url_filter,
        op9_tiff,
        op10_exact_topk,
        line_dedup_pages,
    )
}

#: op4, op6 and op9 have no SQL (trained scores, Viterbi, file formats); tests hold them against brute-force versions.
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE,
    "line_dedup_pages": line_dedup.ORACLE_PAGES,
    "op2_secret_scan": secret_scan.ORACLE,
    "op3_chat_format": chat_format.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op7_near_dedup": near_dedup.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op10_exact_topk": vector_topk.ORACLE,
}
