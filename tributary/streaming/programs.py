"""Structured Streaming programs. Each runs what is there (availableNow) from its checkpoint on, so that a scheduler may call it again and again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import merges
from ..session import shared_folder
from .buckets import BucketTable


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def upsert_stream(stream: DataFrame, root: str, keys: list[str], payload: list[str], stamp: str, order: list[Column], buckets: int = 64) -> BucketTable:
    """Merge every micro-batch into the bucketed table below ``root``, numbered like the batches: only the buckets that a batch touches are rewritten, and a batch that runs again changes nothing.

    Late and edited rows replace what they find; the stamp advances only where the payload changed.
    """
    names = [*keys, *payload, stamp]
    table = BucketTable(stream.sparkSession, root, StructType([stream.schema[c] for c in names]), keys, buckets)

    def merge(batch: DataFrame, number: int) -> None:
        rows = merges.last_of_batch(batch, keys, order).select(*names)
        table.merge(rows, number, lambda old, new: merges.upsert_items(old, new, keys, payload, stamp))

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table


def to_table(stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """The stream's rows as a Parquet table below ``root``."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


def rate_limited(stream: DataFrame, key: str, order: str, at_ms: str, window_ms: int, limit: int, late: str = "1 day") -> DataFrame:
    """(key, pos, count, allowed) by a fixed window that opens with its first event; the state of a key is its count and when it resets.

    Events that come ``late`` behind the newest are dropped. Once all that may still come lies after a key's window, the key is forgotten: its next event would open a
    new window all the same.
    """
    key_kind = stream.schema[key].dataType.simpleString()

    def step(name, frames: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        n, resets = state.get if state.exists else (0, -(2**62))
        rows = pd.concat(list(frames)).sort_values("pos")
        counts = []
        for t in rows["t"].tolist():
            n, resets = (n + 1, resets) if resets > t else (1, t + window_ms)
            counts.append(n)
        state.update((n, resets))
        state.setTimeoutTimestamp(int(resets))
        yield pd.DataFrame({key: [name[0]] * len(rows), "pos": rows["pos"].to_numpy(), "count": counts, "allowed": [c <= limit for c in counts]})

    rows = stream.select(key, F.col(order).alias("pos"), F.col(at_ms).alias("t"), F.timestamp_millis(F.col(at_ms)).alias("at")).withWatermark("at", late)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {key_kind}, pos long, count long, allowed boolean", "n long, resets long", "append", "EventTimeTimeout")


def session_counts(stream: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Items of each gap session, once the watermark has passed its end."""
    window = F.session_window(ts, gap).alias("session")
    return stream.withWatermark(ts, late).groupBy(*keys, window).agg(F.count("*").alias("n")).select(*keys, F.col("session.start").alias("began"), F.col("session.end").alias("ended"), "n")
