"""Greedy folds as chains of starts, over pieces of a key's rows, so that a key with any share of the rows is worked on by many tasks.

A greedy fold puts rows into groups; where the group that begins at a row ends depends on that row and those after it alone. So every row of a piece has a successor, the row that the next group would begin with, found by a
search in prefix sums (or in running maxima). A piece tells, for every row that a group may begin with, how many groups begin in the piece from there on and what the last one leaves open; these are got by pointer
doubling. The pieces of one key are then gone through in order, a few lookups each, which gives each piece what comes in; and the groups of all pieces are filled in apart from each other.

Rows are sorted once, over ranges of key and order. A key that lies wholly in one piece needs none of the passing on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled

#: Rows of a piece at most.
PIECE = 1 << 14


def doubled(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start: how many starts follow within the piece, itself included, and the last of them; ``after`` is the next start, the length where it lies beyond."""
    n = len(after)
    reach, count, last = after.copy(), np.ones(n, np.int64), np.arange(n)
    while True:
        on = np.flatnonzero(reach < n)
        if not len(on):
            return count, last
        to = reach[on]
        # what is read was there before this round, so every round doubles the steps
        count[on], last[on], reach[on] = count[on] + count[to], last[to], reach[to]


def starts(after: np.ndarray, first: int) -> np.ndarray:
    nxt, out = after.tolist(), []
    while first < len(nxt):
        out.append(first)
        first = nxt[first]
    return np.array(out, np.int64)


class NextFit:
    """Batches of rows in order: at most ``most`` rows, for each limit (largest sum, what a row costs besides its size unless it is the first) the sizes' sum, and rows of one kind only.

    Inputs: a long for each limit, then a number that rises where the kind changes. A state is (rows, sums, batch).
    """

    def __init__(self, most: int, limits: list[tuple[int, int]]):
        self.most, self.limits = most, limits
        self.begin = (0, tuple(0 for _ in limits), -1)

    def _sums(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.concatenate([[0], np.cumsum(x[:, k] + gap)]) for k, (_, gap) in enumerate(self.limits)]

    def _kinds(self, x: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where the kind changes (a piece's first row where it isn't the ``same`` as before), and the length."""
        change = x[:, -1] != 0
        change[0] = not same
        return np.append(np.flatnonzero(change), len(x))

    def after(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        at = np.arange(n)
        out = np.minimum(at + self.most, n)
        for (most, gap), s in zip(self.limits, self._sums(x), strict=True):
            # the rows from i to before m cost s[m] - s[i] less one gap
            out = np.minimum(out, np.searchsorted(s, s[:-1] + most + gap, "right") - 1)
        changes = self._kinds(x, True)
        out = np.minimum(out, changes[np.searchsorted(changes, at, "right")])
        return np.maximum(out, at + 1)

    def told(self, x: np.ndarray) -> tuple:
        """What others need of a piece: as many sums as a batch from before may reach, the first change of kind, and what every start leads to."""
        n = len(x)
        far = min(n, self.most)
        sums, changes = self._sums(x), self._kinds(x, True)
        count, last = doubled(self.after(x))
        left = [s[-1] - s[last[:far]] for s in sums]
        total = [int(s[-1]) for s in sums]
        return n, [s[: far + 1] for s in sums], int(changes[0]), bool(x[0, -1]), count[:far], n - last[:far], left, total

    def enter(self, state: tuple, same_kind: bool, sums: list[np.ndarray], first_change: int, n: int) -> int:
        """The first row that a batch begins with, after ``state``."""
        rows, have, _ = state
        if not rows or not same_kind:
            return 0
        out = min(max(self.most - rows, 0), n, first_change)
        for (most, gap), total, s in zip(self.limits, have, sums, strict=True):
            out = min(out, max(0, int(np.searchsorted(s, most + gap - total, "right")) - 1))
        return out

    def passed(self, state: tuple, told: tuple) -> tuple:
        n, sums, first_change, changed, count, rows, left, total = told
        e = self.enter(state, not changed, sums, first_change, n)
        if e == n:
            return state[0] + n, tuple(a + b for a, b in zip(state[1], total, strict=True)), state[2]
        return int(rows[e]), tuple(int(x[e]) for x in left), state[2] + int(count[e])

    def values(self, x: np.ndarray, state: tuple) -> np.ndarray:
        """The batch of every row."""
        n = len(x)
        e = self.enter(state, x[0, -1] == 0, self._sums(x), int(self._kinds(x, True)[0]), n)
        out = np.zeros(n, np.int64)
        out[starts(self.after(x), e)] = 1
        return state[2] + np.cumsum(out)


class FixedWindow:
    """Counts within windows that open with their first event and last ``length``; an event without a time (``None``) counts in the window before it, or opens one at 0.

    Inputs: the time, and whether there is one. A state is (rows, end of the window).
    """

    NEVER = np.iinfo(np.int64).min

    def __init__(self, length: int):
        self.length = length
        self.begin = (0, 0)

    def _times(self, x: np.ndarray) -> np.ndarray:
        return np.where(x[:, 1] != 0, x[:, 0], self.NEVER)

    def _ends(self, x: np.ndarray) -> np.ndarray:
        return np.where(x[:, 1] != 0, x[:, 0], 0) + self.length

    def after(self, x: np.ndarray) -> np.ndarray:
        """The first later row whose time is not before the end of this one's window, by maxima over runs of 1, 2, 4, ... rows."""
        t, ends, n = self._times(x), self._ends(x), len(x)
        levels = [t]
        while 2 << (len(levels) - 1) <= n:
            m, half = levels[-1], 1 << (len(levels) - 1)
            levels.append(np.maximum(m[: len(m) - half], m[half:]))
        at = np.arange(1, n + 1)
        for k in reversed(range(len(levels))):
            m = levels[k]
            inside = at < len(m)
            skip = np.zeros(n, bool)
            skip[inside] = m[at[inside]] < ends[inside]
            at = np.where(skip, at + (1 << k), at)
        return at

    def told(self, x: np.ndarray) -> tuple:
        count, last = doubled(self.after(x))
        return len(x), np.maximum.accumulate(self._times(x)), len(x) - last, self._ends(x)[last]

    def enter(self, state: tuple, highest: np.ndarray) -> int:
        return int(np.searchsorted(highest, state[1], "left")) if state[0] else 0

    def passed(self, state: tuple, told: tuple) -> tuple:
        n, highest, rows, ends = told
        e = self.enter(state, highest)
        return (state[0] + n, state[1]) if e == n else (int(rows[e]), int(ends[e]))

    def values(self, x: np.ndarray, state: tuple) -> np.ndarray:
        """Each row's number in its window, from 1."""
        n = len(x)
        begin = starts(self.after(x), self.enter(state, np.maximum.accumulate(self._times(x))))
        base = np.full(n, -state[0])
        place = np.zeros(n, np.int64)
        place[begin] = begin
        later = np.maximum.accumulate(place)
        started = np.zeros(n, bool)
        started[begin] = True
        base = np.where(np.cumsum(started) > 0, later, base)
        return np.arange(n) - base + 1


def _changes(column) -> np.ndarray:
    """Whether each value differs from the one before (the first does); null is a value."""
    import pyarrow.compute as pc

    n = len(column)
    out = np.ones(n, bool)
    if n > 1:
        a, b = column.slice(1), column.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        null = pc.is_null(column).to_numpy(zero_copy_only=False)
        out[1:] = differs | (null[1:] != null[:-1])
    return out


def chained(rows: DataFrame, keys: list[str], order: str, inputs: list[Column], rule, out: str, kind: Column | None = None) -> DataFrame:
    """(keys, pos, ``out``) by a rule of this module. ``inputs``: longs, not null; with ``kind`` the rule's last input is whether it changes from the row before (null is a kind)."""
    k, n_in = len(keys), len(inputs)
    names = [*keys, "pos"]
    narrow = rows.select(*keys, F.col(order).alias("pos"), *[c.cast("long").alias(f"__in{i}") for i, c in enumerate(inputs)], (F.lit("") if kind is None else kind).alias("__kind"))
    with_kind = kind is not None
    types = {c: narrow.schema[c].dataType.simpleString() for c in [*names, "__kind"]}
    head = ", ".join(f"`{c}` {types[c]}" for c in keys)
    piece = f"{head}, __p long, __whole boolean, __pos array<{types['pos']}>, __x binary, __kinds array<{types['__kind']}>"

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        p, left, first, going = TaskContext.get().partitionId() << 33, None, True, False
        for batch in _with_end(batches):
            if batch is None:
                if left is None:
                    return
                table, more = left, False
            else:
                table = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
                more = True
            columns = [c.combine_chunks() for c in table.columns]
            n = table.num_rows
            new = np.zeros(n, bool)
            new[0] = True
            for c in columns[:k]:
                new |= _changes(c)
            runs = np.flatnonzero(new)
            place = np.arange(n) - np.repeat(runs, np.diff(np.append(runs, n)))
            at = np.flatnonzero(place % PIECE == 0)
            run = np.searchsorted(runs, at, "right") - 1
            alone = np.bincount(run, minlength=len(runs))[run] == 1
            # the first and the last key of a range may go on in the ranges beside it
            alone &= ~((run == 0) & (first or going)) & (run < len(runs) - 1)
            keep = len(at) if not more else len(at) - 1
            if keep:
                stop = int(at[keep]) if keep < len(at) else n
                offsets = pa.array(np.append(at[:keep], stop).astype(np.int32))
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns[k + 1 : k + 1 + n_in]] + [_changes(columns[-1]) if with_kind else np.zeros(n)], axis=1).astype(np.int64)
                raw = [x[a:b].tobytes() for a, b in zip(at[:keep].tolist(), [*at[1:keep].tolist(), stop], strict=True)]
                take = pa.array(at[:keep])
                # of a piece only its first kind and its last matter outside it
                lists = lambda c: pa.ListArray.from_arrays(offsets, c.slice(0, stop))
                ends = np.stack([at[:keep], np.append(at[1:keep], stop) - 1], axis=1).ravel()
                kinds = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * keep + 1, 2, dtype=np.int32)), columns[-1].take(pa.array(ends)))
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in columns[:k]), pa.array(p + np.arange(keep)), pa.array(alone[:keep]), lists(columns[k]), pa.array(raw, pa.binary()), kinds], [*keys, "__p", "__whole", "__pos", "__x", "__kinds"])
                p += keep
            if more:
                rest = int(at[keep])
                going = bool(place[rest] > 0 or (run[keep] == 0 and (first or going)))
                first = first and not keep
                left = table.slice(rest)

    def array(raw: bytes, changed: bool) -> np.ndarray:
        x = np.frombuffer(raw, np.int64).reshape(-1, n_in + 1).copy()
        if with_kind:
            x[0, -1] = changed
        return x

    def tell(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            told = [pickle.dumps(rule.told(array(x, False))) for x in batch.column(k + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: k + 1], pa.array(told, pa.binary()), batch.column(k + 2)], [*keys, "__p", "__told", "__kinds"])

    def carry(batches: Iterator) -> Iterator:
        """What comes into each piece: the rule's state, and whether the piece's first row is of another kind than the row before."""
        import pyarrow as pa

        at, state, last = None, rule.begin, None
        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            states, differs = [], []
            for *key, told, kinds in zip(*lists[:k], *lists[k + 1 :], strict=True):
                if key != at:
                    at, state, last = key, rule.begin, None
                    other = True
                else:
                    other = with_kind and kinds[0] != last
                states.append(pickle.dumps(state))
                differs.append(other)
                state, last = rule.passed(state, _with_change(rule, pickle.loads(told), other)), kinds[1]
            yield pa.RecordBatch.from_arrays([batch.column(k), pa.array(states, pa.binary()), pa.array(differs)], ["__p", "__state", "__other"])

    def fill(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            values = [rule.values(array(x, other is not False), rule.begin if state is None else pickle.loads(state)) for x, state, other in zip(c["__x"].to_pylist(), c["__state"].to_pylist(), c["__other"].to_pylist(), strict=True)]
            who = pc.list_parent_indices(c["__pos"])
            flat = pa.array(np.concatenate(values) if values else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*(c[x].take(who) for x in keys), c["__pos"].flatten(), flat], [*keys, "pos", out])

    sort = [F.asc_nulls_first(c) for c in names]
    pieces = settled(narrow.orderBy(*sort).mapInArrow(pack, piece), "pieces")
    several = pieces.where("NOT __whole").select(*keys, "__p", "__x", "__kinds").mapInArrow(tell, f"{head}, __p long, __told binary, __kinds array<{types['__kind']}>")
    carried = several.repartition(*keys).sortWithinPartitions(*sort[:k], "__p").mapInArrow(carry, "__p long, __state binary, __other boolean")
    some = ["__pos", "__x", "__state", "__other"]
    one = pieces.where("__whole").withColumn("__state", F.lit(None).cast("binary")).withColumn("__other", F.lit(True))
    # a merge join, so that pieces stay dealt by their number (a key's accounts stand in one partition)
    both = one.select(*keys, *some).unionByName(pieces.where("NOT __whole").hint("merge").join(carried, "__p").select(*keys, *some))
    return both.mapInArrow(fill, f"{head}, pos {types['pos']}, `{out}` long")


def _with_end(batches: Iterator) -> Iterator:
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def _with_change(rule, told: tuple, other: bool) -> tuple:
    """A piece's account, with whether its first row is of another kind than the row before it."""
    return (*told[:3], other, *told[4:]) if isinstance(rule, NextFit) else told
