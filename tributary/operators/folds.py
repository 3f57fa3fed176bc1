"""Greedy folds over ordered rows: next-fit batches, fixed-window counters and quotas.

Batches and windows are chains of starts over pieces of a key's rows (``chains``), quotas are sums in two levels (``positions``): a key may have any share of the rows. ``fold`` is for
rules whose state has no such form: a key's rows are sorted within partitions (which spills) and folded in Arrow batches with a running state only, one key in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chains, positions


def fold(df: DataFrame, keys: list[str], order: str, inputs: list[Column], start: tuple, step: Callable, out: str) -> DataFrame:
    """(keys, pos, ``out``): ``step(state, *inputs)`` gives a row's value (a long) and the next state; every key begins with ``start``."""
    k = len(keys)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, state = None, start
        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            values = []
            for key, row in zip(zip(*lists[:k], strict=True), zip(*lists[k + 1 :], strict=True), strict=True):
                if key != at:
                    at, state = key, start
                value, state = step(state, *row)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: k + 1], pa.array(values, pa.int64())], [*keys, "pos", out])

    rows = df.select(*keys, F.col(order).alias("pos"), *[c.alias(f"__in{i}") for i, c in enumerate(inputs)])
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "pos")
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*keys, "pos"]]
    return rows.mapInArrow(run, ", ".join([*kinds, f"{out} long"]))


def next_fit(df: DataFrame, keys: list[str], order: str, size: str, max_items: int, max_size: int, same: str | None = None, gap: int = 0, members: str | None = None, max_members: int | None = None) -> DataFrame:
    """(keys, pos, batch from 0): a batch ends before the row that would exceed ``max_items`` rows, ``max_size`` (each row but the first costs ``gap`` more) or ``max_members``, or that differs in ``same``.

    A row larger than a limit is a batch of its own; a null or negative size is 0, a null ``same`` a value of its own.
    """
    counts, limits = [size], [(max_size, gap)]
    if members is not None:
        counts.append(members)
        limits.append((max_members, 0))
    inputs = [F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")) for c in counts]
    return chains.chained(df, keys, order, inputs, chains.NextFit(max_items, limits), "batch", F.col(same) if same else None)


def fixed_window(df: DataFrame, keys: list[str], order: str, at_ms: str, window_ms: int, limit: int) -> DataFrame:
    """(keys, pos, count, allowed): the window opens with its first event and lasts ``window_ms``; events beyond ``limit`` are rejected but count.

    An event without a time counts in the window before it.
    """
    t = F.col(at_ms).cast("long")
    inputs = [F.coalesce(t, F.lit(0).cast("long")), t.isNotNull().cast("long")]
    out = chains.chained(df, keys, order, inputs, chains.FixedWindow(window_ms), "count")
    return out.withColumn("allowed", F.col("count") <= limit)


def quota_evict(files: DataFrame, partition: list[str], order: list[str], size: str, incoming: int, quota: int) -> DataFrame:
    """Files with ``evict``: the oldest go until what is left and ``incoming`` fit the quota. A null size is 0."""
    rows = positions.running(files.withColumn("__size", F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))), partition, order, "__size", "__upto", "__total")
    return rows.withColumn("evict", F.col("__total") + incoming - (F.col("__upto") - F.col("__size")) > quota).select(*files.columns, "evict")


def rotated(lines: DataFrame, partition: list[str], order: list[str], size: str, most: int, keep: int = 1) -> DataFrame:
    """Lines with ``file`` and ``kept``: a file is closed before the line that would make it larger than ``most`` bytes (the first line of a file always fits); of the files, counted from 0, the open one and the ``keep`` before it are kept."""
    whole = 2**31 - 1
    numbered = next_fit(lines, partition, order[0], size, whole, most).withColumnRenamed("batch", "file")
    newest = numbered.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(partition)]).agg(F.max("file").alias("__newest"))
    same = F.lit(True)
    for i, c in enumerate(partition):
        same &= F.col(c).eqNullSafe(F.col(f"__k{i}"))
    out = numbered.join(newest, same).select(*numbered.columns, "__newest")
    return out.withColumn("kept", F.col("file") >= F.col("__newest") - keep).drop("__newest")


#: Limits of a scan: rounds, rounds without anything new, items.
ROUNDS, STALLS, ITEMS = 72, 4, 5000


def scan_stops(rounds: DataFrame, key: str, max_rounds: int = ROUNDS, max_stalls: int = STALLS, max_items: int = ITEMS) -> DataFrame:
    """(key, stop_reason, stopped_at, items): where a scan of windows ends and why, from its log.

    ``rounds``: round (from 0), added (new items that the window had), stop (the caller's condition, null is false), and of the move after it: moved, edge (the move signalled an edge that has to settle), at_edge (the scroller
    stands at its real end, null where it can't tell). A round is judged in this order: condition, max_items; then, after ``max_stalls`` windows without anything new of which one was moved into, a move that fails proves the
    boundary (once an edge has settled), one that succeeds short of the edge means no_progress; ``max_stalls`` failed moves in a row prove the boundary too; max_rounds ends the rest. A log that ends before has no reason.
    Rounds beyond ``max_rounds`` don't count, so a key's rounds are bounded, and it is folded as one array.
    """
    one = F.struct("round", F.coalesce(F.col("added").cast("int"), F.lit(0)).alias("added"), *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("stop", "moved", "edge", "at_edge")])
    logs = rounds.where(F.col("round") < max_rounds).groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("log"))
    no, zero = F.lit(False), F.lit(0)
    begin = F.struct(zero.alias("items"), no.alias("advanced"), no.alias("into"), zero.alias("idle"), no.alias("saw"), no.alias("early"), zero.alias("stall"), no.alias("settled"), F.lit(None).cast("string").alias("reason"), F.lit(-1).alias("at"))

    def let(value: Column, body: Callable) -> Column:
        return F.transform(F.array(value), body)[0]

    def judged(s: Column, r: Column) -> Column:
        new, first = r["added"] > 0, (s["idle"] == 0) & ~s["advanced"]
        items = F.least(s["items"] + r["added"], F.lit(max_items))
        return F.struct(
            items.alias("items"), s["advanced"].alias("advanced"), s["into"].alias("into"), F.when(new, 0).otherwise(s["idle"] + 1).alias("idle"), (~new & (s["saw"] | (s["advanced"] & s["into"]))).alias("saw"),
            (~new & (s["early"] | first)).alias("early"), F.when(new, 0).otherwise(s["stall"]).alias("stall"), (~new & s["settled"]).alias("settled"),
            F.when(r["stop"], "condition").when(new & (items >= max_items), "max_items").alias("reason"), r["round"].cast("int").alias("at"),
        )

    def moved_on(s: Column, r: Column) -> Column:
        quiet = s["idle"] - s["early"].cast("int")
        probe = s["advanced"] & (quiet >= max_stalls) & s["saw"]
        settles = ~r["moved"] & r["edge"] & ~s["settled"]
        # a move that succeeded proves nothing unless it reached the end
        proved = F.when(settles, F.lit(None)).when(~r["moved"], "boundary").when(~r["at_edge"], "no_progress")
        stall = F.when(probe | settles, 0).when((r["added"] == 0) & ~r["moved"], s["stall"] + 1).otherwise(0)
        reason = F.when(probe, proved).when(stall >= max_stalls, "boundary")
        reason = F.coalesce(reason, F.when(r["round"] + 1 >= max_rounds, "max_rounds"))
        return F.struct(
            s["items"].alias("items"), F.lit(True).alias("advanced"), r["moved"].alias("into"), s["idle"].alias("idle"), s["saw"].alias("saw"), s["early"].alias("early"), stall.alias("stall"),
            F.when(r["moved"], False).otherwise(s["settled"] | settles).alias("settled"), reason.alias("reason"), s["at"].alias("at"),
        )

    def step(s: Column, r: Column) -> Column:
        now = let(judged(s, r), lambda j: F.when(j["reason"].isNotNull(), j).otherwise(moved_on(j, r)))
        return F.when(s["reason"].isNotNull(), s).otherwise(now)

    end = F.aggregate("log", begin.cast("struct<items:int,advanced:boolean,into:boolean,idle:int,saw:boolean,early:boolean,stall:int,settled:boolean,reason:string,at:int>"), step)
    return logs.select(key, end.alias("end")).select(key, F.col("end.reason").alias("stop_reason"), F.col("end.at").alias("stopped_at"), F.col("end.items").alias("items"))
