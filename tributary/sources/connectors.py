"""Connectors by name: a function from (spark, options) to items, and the sinks of a digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..functions.text import stripped
from . import archive

ITEM = StructType([
    StructField("feed_id", StringType()), StructField("external_id", StringType()), StructField("date_ms", LongType()), StructField("title", StringType()),
    StructField("text", StringType()), StructField("author", StringType()), StructField("url", StringType()), StructField("thread_root", StringType()),
    StructField("is_group", BooleanType()), StructField("audience", StringType()), StructField("content_access", StringType()), StructField("meta", StringType()),
])

CONNECTORS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def connector(name: str):
    def register(f):
        CONNECTORS[name] = f
        return f

    return register


def scan(spark: SparkSession, name: str, options: dict) -> DataFrame:
    if name not in CONNECTORS:
        raise ValueError(f"no connector {name}")
    return CONNECTORS[name](spark, options)


@connector("json")
def json_items(spark: SparkSession, options: dict) -> DataFrame:
    """Items as JSON lines."""
    return spark.read.schema(ITEM).json(options["path"])


@connector("parquet")
def parquet_items(spark: SparkSession, options: dict) -> DataFrame:
    return spark.read.schema(ITEM).parquet(options["path"])


@connector("archive")
def archive_items(spark: SparkSession, options: dict) -> DataFrame:
    """Posts of a paged archive as items, each post once."""
    rest = {k: options[k] for k in ("kinds", "from_ms", "to_ms") if k in options}
    posts = archive.scan(spark, [p for p in options["pages"].split(",") if p], **archive.parsed_options(rest)).dropDuplicates(["post_id"])
    columns = {"feed_id": F.lit(options.get("feed_id", "archive")), "external_id": F.col("post_id").cast("string"), "date_ms": F.col("date_ms"), "title": F.col("title"), "text": F.coalesce("text", F.lit(""))}
    return posts.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ITEM])


def violations(items: DataFrame) -> DataFrame:
    """Items that may not be written, with the rule that each breaks."""
    rules = F.array_compact(F.array(
        F.when(F.coalesce(stripped("feed_id"), F.lit("")) == "", "feed_id is empty"),
        F.when(F.coalesce(stripped("external_id"), F.lit("")) == "", "external_id is empty"),
        F.when(F.col("date_ms").isNull(), "no date"),
        F.when(F.col("text").isNull(), "no text"),
    ))
    return items.withColumn("rule", F.explode(rules))


def checked(items: DataFrame) -> DataFrame:
    """The items themselves; a batch with an invalid one fails as a whole when it is written."""
    bad = (F.coalesce(stripped("feed_id"), F.lit("")) == "") | (F.coalesce(stripped("external_id"), F.lit("")) == "") | F.col("date_ms").isNull() | F.col("text").isNull()
    return items.withColumn("external_id", F.when(bad, F.raise_error(F.lit("an invalid item"))).otherwise(F.col("external_id")))


def write_json(rows: DataFrame, path: str) -> None:
    """Debug output as JSON lines, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_log(lines: DataFrame, path: str, column: str = "line") -> None:
    """Log lines as text, secrets replaced."""
    from ..functions.text import redact

    lines.select(redact(column).alias("value")).write.mode("append").text(path)
