"""The test tables, and the item tables bound to them.

Items have the columns item_id, feed_id, external_id, date_ms, author, value and meta (JSON). The SQL constants are the same
bindings for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in NAMES:
        raise ValueError(f"no table {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("item_id"),
        F.col("event_type").alias("feed_id"),
        F.col("event_id").cast("string").alias("external_id"),
        F.expr("unix_millis(cast(ts as timestamp))").alias("date_ms"),
        F.col("user_id").cast("string").alias("author"),
        "user_id",
        "value",
        F.col("props").alias("meta"),
    )


EVENT_ITEMS = """items AS (SELECT event_id AS item_id, event_type AS feed_id, cast(event_id AS VARCHAR) AS external_id,
    epoch_us(ts) // 1000 AS date_ms, cast(user_id AS VARCHAR) AS author, user_id, value, props AS meta FROM events)"""


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items a minute apart, feed = source."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.col("source").alias("feed_id"),
        F.col("doc_id").cast("string").alias("external_id"),
        (F.lit(1704067200000) + F.col("doc_id") * 60000).alias("date_ms"),
        "lang",
        "n_chars",
        "text",
    )


DOCUMENT_ITEMS = """items AS (SELECT doc_id AS item_id, source AS feed_id, cast(doc_id AS VARCHAR) AS external_id,
    1704067200000 + doc_id * 60000 AS date_ms, lang, n_chars, text FROM documents)"""
