"""Parquet tables mapped onto the object model; columns that aren't asked for are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents_as_objects(spark: SparkSession, folder: str, ns: str = "lang") -> DataFrame:
    """(ns, key, content, doc_id): key is source/zero-padded id, content the UTF-8 bytes."""
    d = table(spark, folder, "documents")
    key = F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return d.select(F.col(ns).alias("ns"), key.alias("key"), F.encode("text", "UTF-8").alias("content"), "doc_id")


def pages_as_objects(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(F.lit("pages").alias("ns"), F.col("url").alias("key"), F.encode("html", "UTF-8").alias("content"), "page_id")


def events_as_log(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream as an operation log (ns, key, op, ts, version, size, custom)."""
    e = table(spark, folder, "events")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "update").otherwise("put")
    return e.select(
        F.pmod("user_id", F.lit(8)).cast("string").alias("ns"),
        F.get_json_object("props", "$.k").alias("key"),
        op.alias("op"),
        "ts",
        F.col("event_id").alias("version"),
        F.floor(F.abs("value")).cast("long").alias("size"),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("custom"),
    )


def lineitem_as_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as upload parts (session, start, stop, arrival)."""
    start = F.pmod("l_partkey", F.lit(200))
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("session"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("stop"), F.col("l_linenumber").alias("arrival"))
