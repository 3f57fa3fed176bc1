"""Chained folds and running sums against plain loops, with hot keys over many tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import chains, folds, positions


def next_fit(rows, most, limits, kinds=True):
    """rows of one key: (sizes..., kind)."""
    out, batch, n, sums, last = [], -1, 0, [0] * len(limits), None
    for *sizes, kind in rows:
        fits = n and n < most and (not kinds or kind == last) and all(s + gap + x <= m for s, x, (m, gap) in zip(sums, sizes, limits, strict=True))
        if not fits:
            batch, n, sums = batch + 1, 0, [0] * len(limits)
        sums = [x if not n else s + gap + x for s, x, (_, gap) in zip(sums, sizes, limits, strict=True)]
        n, last = n + 1, kind
        out.append(batch)
    return out


def windows(times, length):
    out, n, resets = [], 0, 0
    for t in times:
        n, resets = (n + 1, resets) if n and (t is None or resets > t) else (1, (t or 0) + length)
        out.append(n)
    return out


def pieces(rule, x, sizes, change_of=None):
    """Values of one key cut into pieces of ``sizes``, through the accounts that pieces give."""
    out, state, a = [], rule.begin, 0
    for size in sizes:
        part = x[a : a + size].copy()
        if not len(part):
            continue
        other = a == 0 or bool(x[a, -1])
        if isinstance(rule, chains.NextFit):
            part[0, -1] = other
        out += rule.values(part, state).tolist()
        part2 = part.copy()
        if isinstance(rule, chains.NextFit):
            part2[0, -1] = 0
        told = rule.told(part2)
        state = rule.passed(state, chains._with_change(rule, told, other))
        a += size
    return out


@pytest.mark.parametrize("seed", range(40))
def test_next_fit_in_pieces(seed):
    rng = random.Random(seed)
    n, most = rng.randint(1, 60), rng.choice([1, 2, 5, 100])
    limits = [(rng.choice([3, 10, 50]), rng.choice([0, 1])), (rng.choice([4, 1000]), 0)]
    kinds = [rng.choice("ab") if seed % 2 else "a" for _ in range(n)]
    rows = [(rng.choice([0, 1, 2, 7, 60]), rng.randint(0, 3), k) for k in kinds]
    x = np.array([[a, b, i == 0 or kinds[i] != kinds[i - 1]] for i, (a, b, _) in enumerate(rows)], np.int64)
    sizes = []
    while sum(sizes) < n:
        sizes.append(rng.randint(1, 9))
    assert pieces(chains.NextFit(most, limits), x, sizes) == next_fit(rows, most, limits)


@pytest.mark.parametrize("seed", range(40))
def test_windows_in_pieces(seed):
    rng = random.Random(seed)
    times, t = [], 100
    for _ in range(rng.randint(1, 60)):
        t += rng.choice([-30, 0, 1, 3, 20, 90])
        times.append(None if rng.random() < 0.1 else t)
    x = np.array([[v or 0, v is not None, 0] for v in times], np.int64)
    sizes = []
    while sum(sizes) < len(times):
        sizes.append(rng.randint(1, 9))
    length = rng.choice([1, 10, 60])
    assert pieces(chains.FixedWindow(length), x, sizes) == windows(times, length)


def test_over_tables(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), i, rng.choice([None, 1, 2, 30, -4]), rng.choice(["x", "x", "y", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, size long, kind string").repartition(5)
    got = {(r["k"], r["pos"]): r["batch"] for r in folds.next_fit(df, ["k"], "i", "size", 7, 40, same="kind", gap=1).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        want |= dict(zip([(k, r[1]) for r in mine], next_fit([(max(0, r[2] or 0), r[3]) for r in mine], 7, [(40, 1)]), strict=True))
    assert got == want
    got = {(r["k"], r["pos"]): (r["count"], r["allowed"]) for r in folds.fixed_window(df, ["k"], "i", "size", 20, 3).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        want |= {(k, r[1]): (n, n <= 3) for r, n in zip(mine, windows([r[2] for r in mine], 20), strict=True)}
    assert got == want
    assert folds.next_fit(df.limit(0), ["k"], "i", "size", 7, 40).collect() == []


def test_one_hot_key(spark):
    """A key with a million rows is packed by many tasks, and as the plain loop does."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(900)).alias("size")).repartition(8)
    sizes = [r["size"] for r in df.orderBy("i").collect()]
    out = folds.next_fit(df, ["k"], "i", "size", 50, 8000)
    got = out.select("batch", F.spark_partition_id().alias("task")).orderBy("pos").collect()
    assert [r["batch"] for r in got] == next_fit([(s, "") for s in sizes], 50, [(8000, 0)])
    assert len({r["task"] for r in got}) >= 3
    most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < n // 2


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", None, "b"]), i, rng.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i long, size long").repartition(5)
    got = {(r["k"], r["i"]): (r["upto"], r["total"]) for r in positions.running(df, ["k"], ["i"], "size", "upto", "total").collect()}
    for k in ("a", "b", None):
        mine, s = [r for r in rows if r[0] == k], 0
        for r in mine:
            s += r[2]
            assert got[(k, r[1])] == (s, sum(x[2] for x in mine))


def test_rotation(spark):
    lines = spark.createDataFrame([("log", i, 4) for i in range(10)] + [("other", 0, 99)], "k string, i long, size long")
    got = {(r["k"], r["pos"]): (r["file"], r["kept"]) for r in folds.rotated(lines, ["k"], ["i"], "size", 10).collect()}
    assert [got["log", i] for i in range(10)] == [(0, False)] * 2 + [(1, False)] * 2 + [(2, False)] * 2 + [(3, True)] * 2 + [(4, True)] * 2
    assert got["other", 0] == (0, True)
