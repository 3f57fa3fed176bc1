"""Conversation structure repair: faults of turns, and the cheapest edits that give roles ``(s?(ua)+)?``.

Faults, the first that holds: blank (no character but ASCII white space), duplicate (role and text were there earlier in the conversation), truncated (the last character but white space is none of
``.!?``). Edits: keep (0), rerole to user or assistant (3), delete (4; a blank or a duplicate turn must go), insert an empty turn of user or assistant (3); a truncated turn that stays costs 3. Of
equally cheap edits the least string of initials (D, I, K, R) is taken.

Rows become one byte each (role and fault), in order, packed in pieces of at most PIECE rows. The dynamic program runs time-major over tensors: pieces of like length are one bucket, and each step
updates the four states' costs of all pieces of the bucket at once; the costs backward are kept and the edits are traced along them, again for all pieces at once. A conversation in several pieces
(many turns, or cut by a range of the sort) is put together by each piece's costs from state to state; so its turns are worked on by many tasks, and what runs through one task in order is a few
numbers a piece, and at last the text itself, row by row, in bounded memory.

Defined results: a null role or text is one blank; null turns come first; equal turns are in the order of the SHA-256 of role and text; repeated rows are duplicates but the first; a null
conversation id is a conversation of its own; an empty table gives no rows. Turns must be whole numbers; more columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a piece, and of a bucket of pieces (turns times pieces).
PIECE, BUCKET = 4096, 1 << 17
#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, after system, after user, after assistant; which one a user or assistant turn leads to, the initial that keeps to it, and what is missing at the end.
NEXT = np.array([2, 2, 3, 2])
WANT = np.array([1, 1, 2, 1])
END = np.array([0, 6, 3, 0], np.int64)
FAR = np.int64(1 << 40)
INITIALS = {"s": 0, "u": 1, "a": 2}


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): every row by the CRC-32 of ``conv:turn`` modulo 20: 0 is dropped (copies 0), 1 loses its text, 2 its full stops, 3 is there twice, 4 is the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.encode(F.concat(blank(conv), F.lit(":"), blank(turn)), "UTF-8")) % 20
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"), k.alias("k"))
    return rows.select(
        "conv", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("copies"),
    )


def _ordered(turns: DataFrame) -> DataFrame:
    """Rows with the columns that order them, none of which is null: cn, c (conversation), tn, t (turn), key (SHA-256 of role and text)."""
    conv, kind = F.col("conv"), turns.schema["conv"].dataType
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select(
        conv.isNotNull().alias("cn"), F.coalesce(conv, F.lit("0").cast(kind)).alias("c"),
        F.col("turn").isNotNull().alias("tn"), F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("t"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"),
        role.alias("role"), text.alias("text"), F.col("copies").cast("int").alias("copies"),
    )


def _codes(rows: DataFrame) -> DataFrame:
    """(cn, c, tn, t, key, i, code), a row a turn after damage: code is the role's initial (s, u, a, other) and four times the fault (blank 1, duplicate 2, truncated 3)."""
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(trimmed == "", 1).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3)
    narrow = rows.where("copies > 0").select("cn", "c", "tn", "t", "key", (initial + 4 * fault).alias("code"), F.col("copies").cast("long").alias("n"))
    seen = narrow.groupBy("cn", "c", "key").agg(F.min(F.struct("tn", "t")).alias("first"))
    some = narrow.groupBy("cn", "c", "key", "tn", "t").agg(F.max("code").alias("code"), F.sum("n").alias("n"))
    told = some.join(seen, ["cn", "c", "key"]).withColumn("new", F.struct("tn", "t") == F.col("first"))
    each = told.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    again = ~F.col("new") | (F.col("i") > 0)
    code = F.when(again & (F.shiftright("code", 2) != 1), F.col("code") % 4 + 8).otherwise(F.col("code"))
    return each.select("cn", "c", "tn", "t", "key", "i", code.cast("int").alias("code"))


def _pack(batches: Iterator) -> Iterator:
    """Sorted codes as pieces: the columns of a piece's first row, p (ascending in the order), whole (the conversation is this piece) and the codes."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    p, left, first, going = TaskContext.get().partitionId() << 33, None, True, False

    def pieces(table: pa.Table, more: bool):
        """Pieces that are at an end (all, when no ``more`` comes) and the rows of the last one."""
        nonlocal p, first, going
        n = table.num_rows
        new = np.ones(n, bool)
        if n > 1:
            differs = lambda x: pc.not_equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[1:] = differs(table["c"].combine_chunks()) | differs(table["cn"].combine_chunks())
        runs = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(runs, np.diff(np.append(runs, n)))
        at = np.flatnonzero(place % PIECE == 0)
        run_of = np.searchsorted(runs, at, "right") - 1
        alone = np.bincount(run_of, minlength=len(runs))[run_of] == 1
        # the first and the last conversation of a range may go on elsewhere
        alone &= ~((run_of == 0) & (first or going)) & (run_of < len(runs) - 1)
        ends = np.append(at[1:], n)
        keep = len(at) if not more else len(at) - 1
        codes = table["code"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.uint8)
        if keep:
            stop = int(ends[keep - 1])
            offsets = np.append(at[:keep], stop).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), keep, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(codes[:stop].tobytes())])
            head = table.take(pa.array(at[:keep])).combine_chunks()
            numbers = pa.array(p + np.arange(keep), pa.int64())
            p += keep
            columns = [head[c].combine_chunks() for c in ("cn", "c", "tn", "t", "key", "i")]
            out = pa.RecordBatch.from_arrays([*columns, numbers, pa.array(alone[:keep]), packed], ["cn", "c", "tn", "t", "key", "i", "p", "whole", "codes"])
        else:
            out = None
        rest = table.slice(int(at[keep])) if keep < len(at) else None
        if keep:
            # does the piece that is left over go on with a conversation that has pieces already, or is it of the range's first
            last_run = run_of[keep] if keep < len(at) else -1
            going = last_run >= 0 and bool(place[at[keep]] > 0 or (last_run == 0 and (first or going)))
            first = False
        return out, rest

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([left, table]) if left is not None else table
        out, left = pieces(table, True)
        if out is not None:
            yield out
    if left is not None:
        out, _ = pieces(left, False)
        yield out


def _buckets(codes: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the pieces, codes time-major with 255 after a piece's end) for pieces of like length."""
    size = np.array([len(x) for x in codes])
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        least = max(1, int(size[order[i]]))
        # at most twice the shortest, and BUCKET cells
        j = i + 1
        while j < len(order) and size[order[j]] <= 2 * least and (j - i + 1) * size[order[j]] <= BUCKET:
            j += 1
        who = order[i:j]
        longest = int(size[who].max())
        grid = np.full((len(who), longest), 255, np.uint8)
        grid[np.arange(longest) < size[who][:, None]] = np.frombuffer(b"".join([codes[k] for k in who]), np.uint8)
        yield who, np.ascontiguousarray(grid.T)
        i = j


def _inserted(v: np.ndarray) -> np.ndarray:
    """Costs of the states (second axis) where turns may be inserted first."""
    a, u = np.minimum(v[:, 3], v[:, 2] + 3), np.minimum(v[:, 2], v[:, 3] + 3)
    return np.stack([np.minimum(v[:, 0], u + 3), np.minimum(v[:, 1], u + 3), u, a], axis=1)


def _row_costs(code: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of deleting, keeping and reroling a row from each state, given the costs ``v`` after it (pieces, states, ...)."""
    more = (1,) * (v.ndim - 2)
    initial, fault = code & 3, code >> 2
    must = ((fault == 1) | (fault == 2)).reshape(-1, 1, *more)
    extra = np.where(fault == 3, 3, 0).reshape(-1, 1, *more)
    delete = v + 4
    keep = np.where((initial[:, None] == WANT).reshape(len(code), 4, *more), v[:, NEXT] + extra, FAR)
    # a system turn may only begin
    system = (initial == 0).reshape(-1, *more)
    keep[:, 0] = np.where(system, (v[:, 1:2] + extra)[:, 0], keep[:, 0])
    rerole = v[:, NEXT] + extra + 3
    return delete, np.where(must, FAR, keep), np.where(must, FAR, rerole)


def _backward(grid: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
    """Costs to go before each turn, from after the last (``end``) to before the first."""
    v = end
    yield v
    for code in grid[::-1]:
        live = code != 255
        delete, keep, rerole = _row_costs(code, v)
        now = _inserted(np.minimum(np.minimum(delete, keep), rerole))
        v = np.where(live.reshape(-1, *(1,) * (v.ndim - 1)), now, v)
        yield v


def _matrices(batches: Iterator) -> Iterator:
    """(cn, c, p, m): a piece's least costs from each state before it to each after it, as 16 longs."""
    import pyarrow as pa

    for batch in batches:
        cn, c, p, codes = batch.columns
        out: list = [b""] * len(p)
        for who, grid in _buckets(codes.to_pylist()):
            end = np.where(np.eye(4, dtype=bool), np.int64(0), FAR)
            *_, m = _backward(grid, np.repeat(end[None], len(who), axis=0))
            for k, x in zip(who.tolist(), np.minimum(m, FAR), strict=True):
                out[k] = x.tobytes()
        yield pa.RecordBatch.from_arrays([cn, c, p, pa.array(out, pa.binary())], ["cn", "c", "p", "m"])


def _onward(batches: Iterator) -> Iterator:
    """(p, v, last): the costs to go after each piece, from the last piece of a conversation to its first (rows come in that order)."""
    import pyarrow as pa

    at, v = None, END
    for batch in batches:
        out, last = [], []
        cn, c, _, m = (x.to_pylist() for x in batch.columns)
        for conv, matrix in zip(zip(cn, c, strict=True), m, strict=True):
            last.append(conv != at)
            if conv != at:
                at, v = conv, END
            out.append(v.tobytes())
            v = np.minimum((np.frombuffer(matrix, np.int64).reshape(4, 4) + v).min(axis=1), FAR)
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.binary()), pa.array(last, pa.bool_())], ["p", "v", "last"])


def _edits(grid: np.ndarray, costs: list[np.ndarray], state: np.ndarray, last: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Each piece's edits from ``state`` on, and the state after it. ``costs[t]``: costs to go before turn t."""
    t, n = grid.shape
    slots = np.zeros((t + 1, 3, n), np.uint8)
    lane = np.arange(n)
    for k in range(t):
        code, now, after = grid[k], costs[k], costs[k + 1]
        delete, keep, _ = _row_costs(code, after)
        open_ = code != 255
        for slot in range(3):
            here = now[lane, state]
            d = open_ & (delete[lane, state] == here)
            i = open_ & ~d & (now[lane, NEXT[state]] + 3 == here) & (slot < 2)
            kept = open_ & ~d & ~i & (keep[lane, state] == here)
            r = open_ & ~d & ~i & ~kept
            slots[k, slot][i] = ord("I")
            slots[k, 2][d] = ord("D")
            slots[k, 2][kept] = ord("K")
            slots[k, 2][r] = ord("R")
            onto = np.where(kept & ((code & 3) == 0), 1, NEXT[state])
            state = np.where(i | kept | r, onto, state)
            open_ = i
            if not open_.any():
                break
    for slot in range(2):
        i = last & ((state == 1) | (state == 2))
        slots[t, slot][i] = ord("I")
        state = np.where(i, NEXT[state], state)
    flat = slots.transpose(2, 0, 1).reshape(n, -1)
    ends = np.cumsum((flat != 0).sum(axis=1)).tolist()
    text = flat[flat != 0].tobytes()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)], state


def _trace(batches: Iterator) -> Iterator:
    """Pieces with the edits and the end state for each state before them (whole conversations: for the first alone), and the cost to go from the first state."""
    import pyarrow as pa

    for batch in batches:
        names = batch.schema.names
        codes, whole, v, last = (batch.column(names.index(c)).to_pylist() for c in ("codes", "whole", "v", "last"))
        n = len(codes)
        letters: list = [[b""] * 4 for _ in range(n)]
        ends: list = [[0] * 4 for _ in range(n)]
        cost = np.zeros(n, np.int64)
        for who, grid in _buckets(codes):
            end = np.array([END if v[k] is None else np.frombuffer(v[k], np.int64) for k in who])
            final = np.array([v[k] is None or bool(last[k]) for k in who])
            costs = list(_backward(grid, end))[::-1]
            cost[who] = costs[0][:, 0]
            for s in range(4):
                some = np.flatnonzero([s == 0 or not whole[k] for k in who])
                if len(some):
                    found, to = _edits(grid[:, some], [x[some] for x in costs], np.full(len(some), s), final[some])
                    for k, x, e in zip(who[some].tolist(), found, to.tolist(), strict=True):
                        letters[k][s], ends[k][s] = x, e
        columns = [batch.column(names.index(c)) for c in ("cn", "c", "tn", "t", "key", "i", "codes")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(letters, pa.list_(pa.binary())), pa.array(ends, pa.list_(pa.int32())), pa.array(cost)], ["cn", "c", "tn", "t", "key", "i", "codes", "letters", "ends", "cost"])


class _Reader:
    """One conversation, piece by piece and row by row, in order."""

    def __init__(self, emit):
        self.emit = emit
        self.state = self.reached = 0
        self.buffer, self.at, self.owed = b"", 0, 0
        self.audit: list[bytes] = []
        self.faults = np.zeros(4, np.int64)
        self.before, self.illegal, self.cost, self.fresh = -1, 0, 0, True
        self.low = self.high = self.turn = None
        self.turns = 0

    def piece(self, codes: bytes, letters: list[bytes], ends: list[int], cost: int) -> None:
        if self.fresh:
            self.cost, self.fresh = cost, False
        mine, self.reached = letters[self.reached], ends[self.reached]
        self.audit.append(mine)
        self.buffer, self.at = self.buffer[self.at :] + mine, 0
        c = np.frombuffer(codes, np.uint8)
        self.faults += np.bincount(c >> 2, minlength=4)
        roles = np.concatenate([[self.before], c & 3]) if self.before >= 0 else c & 3
        a, b = roles[:-1], roles[1:]
        self.illegal += int((~(((b == 1) & ((a == 0) | (a == 2))) | ((a == 1) & (b == 2)))).sum())
        self.before = int(roles[-1])
        owed, self.owed = self.owed, 0
        for _ in range(owed):
            self.row(None, None)

    def seen(self, turn: int | None) -> None:
        if turn is not None:
            if self.turn != turn:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn

    def row(self, role: str | None, text: str | None) -> None:
        """The next row's edit; without text it is one that must go."""
        while True:
            if self.at == len(self.buffer):
                # its piece begins later in the order: only repeats of a row come before their piece
                self.owed += 1
                return
            letter = self.buffer[self.at]
            self.at += 1
            if letter == 73:
                self.put("I", self.due(), "")
            elif letter == 68:
                return
            elif letter == 75:
                return self.put("K", role, text)
            else:
                return self.put("R", self.due(), text)

    def due(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def put(self, edit: str, role: str, text: str) -> None:
        self.state = INITIALS[role[0]] + 1
        self.emit(edit, role, text)

    def finish(self) -> None:
        while self.at < len(self.buffer):
            self.at += 1
            self.put("I", self.due(), "")


def _stream(turns: DataFrame) -> DataFrame:
    """Rows and pieces of each conversation in order, in one partition; a piece stands before the row that it begins with."""
    rows = _ordered(turns)
    sort = ["cn", "c", "tn", "t", "key", "i"]
    kind = rows.schema["c"].dataType.simpleString()
    place = f"cn boolean, c {kind}, tn boolean, t long, key binary, i long"
    pieces = materialize(_codes(rows).orderBy(*sort).mapInArrow(_pack, f"{place}, p long, whole boolean, codes binary"), "pieces")
    several = pieces.where("NOT whole").select("cn", "c", "p", "codes").mapInArrow(_matrices, f"cn boolean, c {kind}, p long, m binary")
    onward = several.repartition("cn", "c").sortWithinPartitions("cn", "c", F.desc("p")).mapInArrow(_onward, "p long, v binary, last boolean")
    whole = pieces.where("whole").withColumn("v", F.lit(None).cast("binary")).withColumn("last", F.lit(True))
    both = whole.unionByName(pieces.where("NOT whole").join(onward, "p").select(*whole.columns))
    traced = both.mapInArrow(_trace, f"{place}, codes binary, letters array<binary>, ends array<int>, cost long")
    traced = traced.withColumn("is_row", F.lit(False))
    for c, of in (("role", "string"), ("text", "string"), ("copies", "int")):
        traced = traced.withColumn(c, F.lit(None).cast(of))
    here = F.col("copies") > 0
    texts = rows.withColumn("role", F.when(here, F.col("role"))).withColumn("text", F.when(here, F.col("text"))).withColumn("i", F.lit(0).cast("long")).withColumn("is_row", F.lit(True))
    for c, of in (("codes", "binary"), ("letters", "array<binary>"), ("ends", "array<int>"), ("cost", "long")):
        texts = texts.withColumn(c, F.lit(None).cast(of))
    names = [*sort, "is_row", "role", "text", "copies", "codes", "letters", "ends", "cost"]
    return texts.select(*names).unionByName(traced.select(*names)).repartition("cn", "c").sortWithinPartitions(*sort, "is_row")


def _conversations(batches: Iterator, emit) -> Iterator[tuple]:
    """((cn, c), reader) of each conversation when all of it was read; emit(conversation, edit, role, text) as turns come out. None after every batch."""
    at = reader = None
    for batch in batches:
        for cn, c, tn, t, _, _, is_row, role, text, copies, codes, letters, ends, cost in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (cn, c) != at:
                if reader is not None:
                    reader.finish()
                    yield at, reader
                at = (cn, c)
                reader = _Reader(lambda *x, conv=at: emit(conv, *x))
            if not is_row:
                reader.piece(codes, letters, ends, cost)
                continue
            if copies:
                reader.seen(t if tn else None)
            for _ in range(copies):
                reader.row(role, text)
        yield None, None
    if reader is not None:
        reader.finish()
        yield at, reader


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv, place from 0, edit K, R or I, role, text): the turns of every conversation after repair. ``turns``: conv, turn, role, text, copies (how often the row is there)."""
    kind = turns.schema["conv"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out, size, place, now = [], 0, 0, None

        def emit(conv, edit, role, text):
            nonlocal size, place, now
            if conv != now:
                now, place = conv, 0
            out.append((conv[1] if conv[0] else None, place, edit, role, text))
            place += 1

        schema = None
        for batch in _conversations(_tee(batches, box := []), emit):
            schema = schema or pa.schema([("conv", box[0]), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
            if out and batch[0] is None or len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return _stream(turns).mapInArrow(run, f"conv {kind}, place long, edit string, role string, text string")


def _tee(batches: Iterator, box: list) -> Iterator:
    for batch in batches:
        box.append(batch.column(1).type) if not box else None
        yield batch


def repair_report(turns: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation: counts before repair, the edits' initials in order, and the SHA-256 of the repaired
    ``role:text`` joined by line feeds. A conversation none of whose rows is there has zeros, no edits, and the hash of nothing."""
    kind = turns.schema["conv"].dataType.simpleString()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sha, some, out, box = hashlib.sha256(), False, [], []

        def emit(_, edit, role, text):
            nonlocal some
            sha.update(f"{chr(10) * some}{role}:{text}".encode())
            some = True

        def batch() -> pa.RecordBatch:
            kinds = [box[0], *[pa.int64()] * len(names), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv", *names, "audit", "repaired_sha256"])

        for conv, r in _conversations(_tee(batches, box), emit):
            if conv is None:
                if out:
                    yield batch()
                    out.clear()
                continue
            gaps = 0 if r.low is None else r.high - r.low + 1 - r.turns
            out.append((conv[1] if conv[0] else None, gaps, *r.faults[1:].tolist(), r.illegal, r.cost, b"".join(r.audit).decode(), sha.hexdigest()))
            sha, some = hashlib.sha256(), False
        if out:
            yield batch()

    fields = ", ".join(f"{c} long" for c in names)
    return _stream(turns).mapInArrow(run, f"conv {kind}, {fields}, audit string, repaired_sha256 string")
