"""Order-sensitive operators over ordered items: discussion units, islands, fills, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000


def islands(df: DataFrame, partition: list[str], order: list[Column], joins: Column, name: str = "island") -> DataFrame:
    """``name`` numbers the runs of rows that ``joins`` (an expression that may look back) ties to the row before; from 0."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("__new", F.when(joins, 0).otherwise(1)).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")


def thread_units(items: DataFrame, scope: list[str], root_gap_ms: int = 30 * MINUTE, root_cap: int = 8, gap_ms: int = 2 * MINUTE, cap: int = 4) -> DataFrame:
    """Items with ``unit``: the position of the first member of their discussion unit.

    Columns needed: pos (total order in the scope), feed_id, root (null without a thread), is_group, author, date_ms. Items of one thread go
    together while gaps stay within ``root_gap_ms``, ``root_cap`` at most; others follow the unit made last if that ends with such an item of
    the same feed and author within ``gap_ms``, ``cap`` at most. The scope (a user and period) is the unit of parallel work.
    """
    rooted, plain = items.where(F.col("root").isNotNull()), items.where(F.col("root").isNull())
    thread = [*scope, "feed_id", "root"]
    w = Window.partitionBy(*thread).orderBy("pos")
    near = F.abs(F.col("date_ms") - F.lag("date_ms").over(w)) <= root_gap_ms
    r = islands(rooted, thread, [F.asc("pos")], near)
    r = r.withColumn("__n", F.row_number().over(Window.partitionBy(*thread, "island").orderBy("pos")) - 1)
    r = r.withColumn("__part", F.floor(F.col("__n") / root_cap))
    r = r.withColumn("unit", F.min("pos").over(Window.partitionBy(*thread, "island", "__part")))
    makers = r.where(F.col("__n") % root_cap == 0).select(*items.columns).withColumn("__rooted", F.lit(True))
    s = plain.withColumn("__rooted", F.lit(False)).unionByName(makers)
    w = Window.partitionBy(*scope).orderBy("pos")
    before = {c: F.lag(c).over(w) for c in ("__rooted", "feed_id", "author", "date_ms")}
    follows = ~F.col("__rooted") & F.coalesce(F.col("is_group"), F.lit(False)) & (F.coalesce(F.col("author"), F.lit("")) != "")
    follows &= ~before["__rooted"] & (F.col("feed_id") == before["feed_id"]) & (F.col("author") == before["author"]) & (F.abs(F.col("date_ms") - before["date_ms"]) <= gap_ms)
    s = islands(s, scope, [F.asc("pos")], F.coalesce(follows, F.lit(False)))
    s = s.withColumn("__n", F.row_number().over(Window.partitionBy(*scope, "island").orderBy("pos")) - 1)
    s = s.withColumn("__part", F.floor(F.col("__n") / cap))
    s = s.withColumn("unit", F.min("pos").over(Window.partitionBy(*scope, "island", "__part"))).where("NOT __rooted")
    return r.select(*items.columns, "unit").unionByName(s.select(*items.columns, "unit"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; Spark prunes to one row a group before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def fill_forward(column: str, partition: list[str], order: list[Column]) -> Column:
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def occurrence(identity: list[str], order: list[Column]) -> Column:
    """0-based number of a row among those of equal identity."""
    return F.row_number().over(Window.partitionBy(*identity).orderBy(*order)) - 1


def run_lengths(df: DataFrame, partition: list[str], order: list[Column], value: str) -> DataFrame:
    """One row for each run of consecutive equal values: partition, value, run, n."""
    w = Window.partitionBy(*partition).orderBy(*order)
    runs = islands(df, partition, order, F.col(value) == F.lag(value).over(w), "run")
    return runs.groupBy(*partition, "run", value).agg(F.count("*").alias("n"))
