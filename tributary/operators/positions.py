"""Places and running sums in a total order, in two levels: rows are dealt by ranges of the order, counted in their range, and each range gets what lies before it.

No window runs over a whole key or table, so one key may have any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

#: monotonically_increasing_id has the partition above this bit and the row's number in it below.
PART = 33


def dealt(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` in ``order`` over range partitions, with __part and __row (from 0 in its part); written, so that both stay as they are."""
    at = F.monotonically_increasing_id()
    placed = settled(rows.orderBy(*order).withColumn("__at", at), "placed")
    return placed.withColumn("__part", F.shiftright("__at", PART)).withColumn("__row", F.col("__at").bitwiseAND(F.lit((1 << PART) - 1))).drop("__at")


def numbered(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with their place (from 1) in ``order``; a tie is in the order that Spark's sort gives it."""
    placed = dealt(rows, order)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row a range partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__row") + 1)
    return out.drop("__part", "__row", "__before")


def running(rows: DataFrame, keys: list[str], order: list[str], size: str, upto: str, total: str) -> DataFrame:
    """``rows`` with two longs: the sum of ``size`` up to and with the row in its key's ``order``, and the key's whole sum.

    Rows are dealt by ranges of key and order; sums within a range and key are a window over that range alone, and what the ranges before it hold of the key, a row a range and key, is added. Nulls in keys are a value.
    """
    placed = dealt(rows, [*[F.asc_nulls_first(k) for k in keys], *[F.asc_nulls_first(c) for c in order]])
    within = Window.partitionBy("__part", *keys).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    mine = placed.withColumn("__own", F.sum(size).over(within))
    parts = placed.groupBy("__part", *keys).agg(F.sum(size).alias("__sum"))
    # a key has a row for each range that it reaches into
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("__part").alias("__in"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"), F.sum("__sum").over(by_key).alias("__all"))
    same = F.col("__part") == F.col("__in")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = mine.join(starts, same)
    return out.select(*rows.columns, (F.col("__before") + F.col("__own")).alias(upto), F.col("__all").alias(total))
