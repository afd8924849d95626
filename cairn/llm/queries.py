"""Queries of the operators and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprint import edit_fingerprints
from .html import extract
from .langid import language_id
from .neardup import near_duplicates
from .oracles import ORACLES  # noqa: F401 - for __spark_entry__
from .packing import pack
from .pieces import encode_decode
from .substring import dedup_substrings
from .tokenfile import token_file
from .toxicity import toxicity
from .vectors import near_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(_table(spark, sf_dir, "documents")).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2("text", 256).alias("text_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "p_low_quality", "p_toxic", "toxic")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file(_table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_fingerprint, op3_sentencepiece, op4_language_id, op5_minhash, op6_html_text, op7_toxicity, op8_packing, op9_embeddings, op10_token_file)
}


