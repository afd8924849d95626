"""A training corpus from ``documents`` in five stages, each an operator of ``cairn.llm``.

A stage takes (spark, docs, sf_dir) and works on all rows of docs, as Parquet reread from the
stage before. All but the last return the columns of documents; other columns of docs are dropped,
whatever their names. An empty table gives an empty one. Each stage says what null ids and texts,
ties and repeated rows give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import store
from cairn.llm.langid import identify, train
from cairn.llm.neardup import near_duplicates
from cairn.llm.packing import pack
from cairn.llm.substring import LAST, dedup_substrings
from cairn.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of words of a learned language take 2 to 5.5 bits, those of another script or noise over 9;
#: text that needs more than this is none of them. Short texts get so many bits besides.
FOREIGN_BITS, SHORT_BITS = 6.5, 32


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, taught by ``labels``, doesn't call toxic.

    Rows are judged one by one by their text: repeated rows stay or go together, a null text is judged
    as one without words, a null id matters only for teaching (it has no label).
    """
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels).where(~F.col("toxic")).select(*COLUMNS)


def letter_words(text: Column) -> Column:
    """The text's letter runs in lower case between spaces, without runs that hold digits unless
    there are no others: numbers, keys and symbols tell nothing about a language."""
    runs = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[^\p{L}\p{M}]+", " ")))
    plain = runs(F.regexp_replace(text, r"(?<![\p{L}\p{M}\p{N}])[\p{L}\p{M}]*+\p{N}[\p{L}\p{M}\p{N}]*+", " "))
    return F.when(plain != "", plain).otherwise(runs(text))


def reject_foreign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose words the best language model doesn't find as unlikely as noise.

    A null text and one without letters go. Rows are judged one by one; where no text carries a
    language nothing is learned and nothing can stay.
    """
    words = docs.select(*COLUMNS, letter_words(F.col("text")).alias("words"))
    scored = identify(words, train(words, text_col="words"), text_col="words")
    spent = F.col("bits_a_byte") * F.octet_length("words")
    return scored.where((F.col("lang_pred") != "und") & (spent <= FOREIGN_BITS * F.octet_length("words") + SHORT_BITS)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of near duplicates (five-word shingles, similarity 0.8).

    Texts without words are in no class and stay. Where ids repeat or are null, every row counts as a
    document of its own: one row a class stays, of the smallest id (null ids last), then of the
    smallest text. Without such rows nothing but ids is joined.
    """
    docs = docs.select(*COLUMNS)
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    rows = store(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select("row", "text"), id_col="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("class"))
    ranked = rows.select("row", F.struct(F.coalesce("doc_id", F.lit(LAST)), F.sha2(F.coalesce("text", F.lit("")), 256), "row").alias("rank")).join(found, "row")
    best = ranked.groupBy("class").agg(F.min_by("row", "rank").alias("row"))
    return rows.join(best.select("row"), "row", "left_semi").select(*COLUMNS)


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 20-word passages that occur earlier; n_chars follows the text.

    No row goes. A null text becomes an empty one. Null ids come last in the order; rows that repeat
    an id are ordered by a text hash, and those that repeat the text as well are cut alike.
    """
    return dedup_substrings(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1,024 ids.

    Repeated rows are packed as often as they occur; a null or empty text is the end id alone.
    """
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", reject_toxic),
    ("language ID", reject_foreign),
    ("near-duplicates", drop_near_duplicates),
    ("substring dedup", drop_substrings),
    ("packing", pack_sequences),
]

#: No stage but the near-duplicates could be said in SQL; tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{STAGES.index((name, stage))}")
    return STAGES[-1][1](spark, docs, sf_dir)
