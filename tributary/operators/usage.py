"""Usage and cost: saturating sums, prices, costs that one unknown makes unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest integer that a double holds exactly.
MOST = 2**53 - 1


def saturating_sum(column: str | Column) -> Column:
    """The sum, at most 2**53 - 1; summed as decimals, so it can't overflow on the way."""
    c = F.col(column) if isinstance(column, str) else column
    return F.least(F.sum(c.cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")


def saturated(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.sum(c.cast("decimal(38,0)")) > F.lit(MOST).cast("decimal(38,0)")


def cached_tokens(prompt: Column, hit: Column, miss: Column) -> Column:
    return F.least(prompt, F.coalesce(hit, F.greatest(F.lit(0).cast("long"), prompt - F.coalesce(miss, prompt))))


def uncached_tokens(prompt: Column, hit: Column, miss: Column) -> Column:
    return F.least(prompt, F.coalesce(miss, F.greatest(F.lit(0).cast("long"), prompt - cached_tokens(prompt, hit, miss))))


def micro_cost(prompt: Column, hit: Column, miss: Column, completion: Column, price: Column, hit_price: Column, out_price: Column) -> Column:
    """Cost in millionths of the price unit: prices are per million tokens, so token counts times prices."""
    return uncached_tokens(prompt, hit, miss) * price + cached_tokens(prompt, hit, miss) * hit_price + completion * out_price


def poisoned_sum(value: Column, known: Column) -> Column:
    """The sum, or null if one row is unknown."""
    return F.when(F.bool_and(known), F.sum(value))


def valid_usage(prompt: Column, completion: Column, total: Column, hit: Column, miss: Column) -> Column:
    """Whether the counts agree: all there and none negative, total = prompt + completion, hit + miss = prompt where both are known."""
    counts = (prompt >= 0) & (completion >= 0) & (total == prompt + completion)
    parts = F.coalesce((hit + miss) == prompt, F.lit(True)) & F.coalesce(hit >= 0, F.lit(True)) & F.coalesce(miss >= 0, F.lit(True))
    return F.coalesce(counts & parts, F.lit(False))


#: Low bits that are summed apart from the high ones.
BITS = 26

#: The counters of a rollup.
COUNTERS = ("attempts", "duration_ms", "reported", "prompt", "completion", "total", "hit", "miss", "success", "retry", "failure")


def rollup(attempts: DataFrame) -> DataFrame:
    """Totals (null, null) and one row a stage and model, in order: COUNTERS, each at most 2**53 - 1, and whether one of them is more (``saturated``).

    ``attempts``: stage, model (null: unknown), status, duration_ms and the usage: prompt, completion, total, hit, miss. Without a prompt count the attempt reported no usage; null hits and misses count nothing.
    """
    one = lambda when: F.when(when, 1).otherwise(0)
    told = F.col("prompt").isNotNull()
    counts = {"attempts": F.lit(1), "reported": one(told)} | {s: one(F.col("status") == s) for s in ("success", "retry", "failure")}
    sums = {"duration_ms": F.col("duration_ms")} | {c: F.when(told, F.coalesce(F.col(c), F.lit(0))).otherwise(0) for c in ("prompt", "completion", "total", "hit", "miss")}
    # sums as two longs each, of high and of low bits: a value beyond MOST saturates by itself, so neither can overflow
    halves = {}
    for c, v in sums.items():
        v = F.least(v.cast("long"), F.lit(MOST + 1))
        halves |= {f"{c}_high": F.shiftright(v, BITS), f"{c}_low": v.bitwiseAND(F.lit((1 << BITS) - 1))}
    parts = {**counts, **halves}
    by = attempts.withColumn("model", F.coalesce("model", F.lit("unknown"))).groupBy("stage", "model").agg(*[F.sum(v).alias(c) for c, v in parts.items()])
    # the few rows that this leaves are summed once more, as decimals
    wide = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0))
    whole = {c: wide(c) for c in counts} | {c: wide(f"{c}_high") * F.lit(1 << BITS).cast("decimal(9,0)") + wide(f"{c}_low") for c in sums}
    rows = by.groupingSets([[], ["stage", "model"]], "stage", "model").agg(F.grouping_id().alias("level"), *[whole[c].alias(c) for c in COUNTERS])
    over = F.lit(False)
    for c in COUNTERS:
        over = over | (F.col(c) > MOST)
    return rows.select("stage", "model", "level", *[F.least(F.col(c), F.lit(MOST)).cast("long").alias(c) for c in COUNTERS], over.alias("saturated")).orderBy("stage", "model")
