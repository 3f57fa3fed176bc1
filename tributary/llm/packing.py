"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Pieces are dealt over shards by a hash (some SHARD_PIECES each, however many there are); each shard is evolved by several islands
with seeds of their own. An island starts from random orders, in which larger pieces tend to come first, best-fitted. Crossover injects whole well-filled bins of one parent into the
other, drops the bins that hold duplicates and best-fits the displaced pieces, largest first; mutation dissolves the emptiest bins
and some others. Between rounds the islands of a shard exchange their best solutions; the best of the last round stands. What the shards leave in
their emptiest bins is dealt over fewer shards and evolved again, down to one, so that shards waste no bins.
Only lengths move, never texts or ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices, utf8

SHARD_PIECES = 8192
ISLANDS = 2
ROUNDS = 2
#: Generations of a round, solutions of an island, and generations without a better one after which a round ends.
GENERATIONS, POPULATION, PATIENCE = 24, 4, 6
#: How full a bin of a parent must be to be passed on whole. Of a shard's bins the emptiest OPEN, as far as they aren't full, are packed again.
WELL_FILLED, OPEN = 0.995, 1 / 8
#: Spread of the factors that sizes are multiplied by for the order of a first solution.
NOISE = 0.2


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of each document's ids and ``end_id``, cut every ``capacity`` ids.

    A null or empty text is the end id alone; ids of documents may be null; repeated rows give repeated pieces; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .tokens import encoder

        coder, end = encoder(tokenizer), np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in slices(at):
                ids, at_ids = coder.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])
                row, piece, start, length, crc, raw_ids = [], [], [], [], [], []
                for k in range(j - i):
                    raw = ids[at_ids[k] : at_ids[k + 1]].astype("<u4").tobytes() + end
                    for p, a in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[a : a + 4 * capacity]
                        row.append(i + k)
                        piece.append(p)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        raw_ids.append(part if with_ids else None)
                columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(raw_ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def best_fit(sizes: list[int], order, bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put the pieces of ``order`` into the bin with the least room that is enough; open a bin where none is."""
    free = sorted((r, b) for b, r in enumerate(room) if r > 0)
    for k in order:
        s = sizes[k]
        at = bisect_left(free, (s, -1))
        if at == len(free):
            bins.append([k])
            room.append(capacity - s)
            if capacity > s:
                insort(free, (capacity - s, len(bins) - 1))
        else:
            r, b = free.pop(at)
            bins[b].append(k)
            room[b] = r - s
            if r > s:
                insort(free, (r - s, b))


def _descending(sizes: np.ndarray, items: list[int]) -> list[int]:
    items = np.array(items, np.int64)
    return items[np.argsort(-sizes[items], kind="stable")].tolist()


def _room(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> np.ndarray:
    count = np.array([len(x) for x in bins])
    flat = np.fromiter((k for x in bins for k in x), np.int64, int(count.sum()))
    return capacity - np.add.reduceat(sizes[flat], np.cumsum(count) - count) if len(bins) else np.empty(0, np.int64)


def _refit(bins: list[list[int]], dissolved: np.ndarray, loose: list[int], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """``bins`` without the ``dissolved`` ones, whose pieces are best-fitted with the ``loose`` ones."""
    child = [list(x) for x, gone in zip(bins, dissolved, strict=True) if not gone]
    loose = loose + [k for x, gone in zip(bins, dissolved, strict=True) if gone for k in x]
    best_fit(sizes.tolist(), _descending(sizes, loose), child, _room(child, sizes, capacity).tolist(), capacity)
    return child


def _crossover(a: list[list[int]], b: list[list[int]], sizes: np.ndarray, capacity: int, rng) -> list[list[int]]:
    """Some of the well-filled bins of ``b`` go into ``a`` whole; bins of ``a`` that hold a piece of theirs are dissolved."""
    good = np.flatnonzero(_room(b, sizes, capacity) <= (1 - WELL_FILLED) * capacity)
    take = [b[i] for i in good[rng.random(len(good)) < rng.uniform(0.2, 0.8)].tolist()]
    taken = np.zeros(len(sizes), bool)
    taken[[k for x in take for k in x]] = True
    hit = np.array([bool(taken[x].any()) for x in a], bool)
    loose = [k for x, h in zip(a, hit, strict=True) if h for k in x if not taken[k]]
    kept = [x for x, h in zip(a, hit, strict=True) if not h] + take
    return _refit(kept, np.zeros(len(kept), bool), loose, sizes, capacity)


def _mutation(bins: list[list[int]], sizes: np.ndarray, capacity: int, rng) -> list[list[int]]:
    """The bins that aren't well filled are dissolved, and some of the others."""
    room = _room(bins, sizes, capacity)
    return _refit(bins, (room > (1 - WELL_FILLED) * capacity) | (rng.random(len(bins)) < 0.05), [], sizes, capacity)


def _fitness(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better; of equally many, fuller ones."""
    return len(bins), -float((((capacity - _room(bins, sizes, capacity)) / capacity) ** 2).sum()) / max(1, len(bins))


def evolve(sizes: list[int], capacity: int, seed: int, migrants: list[list[list[int]]], generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """The best solution that an island finds from random ones and its ``migrants``; it ends early at the lower bound, or after PATIENCE generations without a better one.

    The first population has the plain order by size too, so no island does worse than best-fit decreasing.
    """
    rng, least, sizes = np.random.default_rng(seed), -(-sum(sizes) // capacity), np.array(sizes, np.int64)
    pool = [list(m) for m in migrants][: population - 1]
    while len(pool) < population:
        bins: list[list[int]] = []
        noise = NOISE * rng.standard_normal(len(sizes)) if pool else 0.0
        key = sizes * np.exp(noise)
        best_fit(sizes.tolist(), np.argsort(-key, kind="stable").tolist(), bins, [], capacity)
        pool.append(bins)
    pool = sorted(((*_fitness(x, sizes, capacity), k, x) for k, x in enumerate(pool)))
    idle = 0
    for turn in range(generations):
        if pool[0][0] <= least or idle >= PATIENCE:
            break
        i, j = rng.permutation(len(pool))[:2]
        children = [_crossover(pool[int(i)][-1], pool[int(j)][-1], sizes, capacity, rng), _mutation(pool[int(min(i, j))][-1], sizes, capacity, rng)]
        before = pool[0][:2]
        pool = sorted(pool + [(*_fitness(x, sizes, capacity), population + 2 * turn + k, x) for k, x in enumerate(children)])[:population]
        idle = 0 if pool[0][:2] < before else idle + 1
    return pool[0][-1]


def _bins_of(assignment: bytes) -> list[list[int]]:
    of = np.frombuffer(assignment, np.int32)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(of) else []


def _evolved(lengths: DataFrame, capacity: int) -> DataFrame:
    """(shard, sizes, assignment: the bin of each piece, as 32-bit integers) for (shard, sizes); the islands and rounds are here."""

    def island(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for shard, sizes, seed, elites in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                bins = evolve(sizes, capacity, seed * 7919 + shard, [_bins_of(e) for e in elites or []])
                of = np.zeros(len(sizes), np.int32)
                for b, x in enumerate(bins):
                    of[x] = b
                n, fit = _fitness(bins, np.array(sizes, np.int64), capacity)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n], pa.int32()), pa.array([fit]), pa.array([of.tobytes()], pa.binary())], ["shard", "bins", "fit", "assignment"])

    tasks = max(int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lengths.count() * ISLANDS // 4))
    elites = None
    for turn in range(ROUNDS):
        seeds = F.explode(F.array(*[F.lit(turn * ISLANDS + k) for k in range(ISLANDS)]))
        start = lengths.withColumn("seed", seeds)
        start = start.join(elites, "shard") if elites is not None else start.withColumn("elites", F.lit(None).cast("array<binary>"))
        dealt = start.select("shard", "sizes", "seed", "elites").repartition(tasks, "shard", "seed")
        old, found = elites, materialize(dealt.mapInArrow(island, "shard long, bins int, fit double, assignment binary"), "islands")
        elites = found.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bins", "fit", "assignment"))).alias("all")).select("shard", F.col("all.assignment").alias("elites"))
        elites = materialize(elites, "elites")
        discard(found, *([old] if old is not None else []))
    return lengths.join(elites.select("shard", F.col("elites")[0].alias("assignment")), "shard")


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with sequence_id (long) and offset (long): every row in one sequence, gapless, at most ``capacity`` ids each.

    Pieces of exactly ``capacity`` ids are sequences of their own. Lengths must lie from 1 to ``capacity``; ties are settled by
    the order of the shard; repeated rows are pieces like others; an empty table gives an empty result. Columns named
    sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    pieces = materialize(pieces.select(F.struct(*names).alias("row"), F.col(length_col).cast("int").alias("size"), F.monotonically_increasing_id().alias("number")), "pieces")
    left = pieces.where(F.col("size") < capacity).select("size", "number")
    done, level = None, 0

    def placed(batches: Iterator) -> Iterator:
        """(number, size, sequence, offset, open: whether the sequence is to be packed again) of the pieces of whole shards."""
        import pyarrow as pa

        for batch in batches:
            for shard, sizes, numbers, assignment, last, depth in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                of, size = np.frombuffer(assignment, np.int32).astype(np.int64), np.array(sizes, np.int64)
                order = np.argsort(of, kind="stable")
                ends = np.cumsum(size[order])
                before = ends - size[order]
                first = np.concatenate([[True], np.diff(of[order]) > 0])
                offset = np.zeros(len(of), np.int64)
                offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
                fill = np.bincount(of, size)
                again = np.zeros(len(fill), bool)
                again[np.argsort(fill, kind="stable")[: int(np.ceil(OPEN * len(fill)))]] = not last
                again = (again & (fill < capacity))[of]
                sequence = ((np.int64(depth) << 58) + (np.int64(shard) << 24) + of).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sequence, pa.int64()), pa.array(offset), pa.array(again, pa.bool_())], ["number", "size", "sequence_id", "offset", "open"])

    count = left.count()
    while done is None or count:
        shards = max(1, -(-count // shard_pieces))
        item = F.struct("number", "size")
        # the number is in the hash, so that repeated rows are dealt like others
        dealt = left.groupBy(F.pmod(F.xxhash64("number", F.lit(level)), F.lit(shards)).alias("shard")).agg(F.sort_array(F.collect_list(item)).alias("items"))
        dealt = materialize(dealt.select("shard", F.col("items.number").alias("numbers"), F.col("items.size").alias("sizes")), "shards")
        best = _evolved(dealt.select("shard", "sizes"), capacity).join(dealt.select("shard", "numbers"), "shard")
        best = best.select("shard", "sizes", "numbers", "assignment", F.lit(shards == 1).alias("last"), F.lit(level).alias("level"))
        found = materialize(best.mapInArrow(placed, "number long, size int, sequence_id long, offset long, open boolean"), "placed")
        discard(dealt)
        fixed = found.where("not open").select("number", "sequence_id", "offset")
        done = fixed if done is None else done.unionByName(fixed)
        left, level = found.where("open").select("size", "number"), level + 1
        count = left.count() if shards > 1 else 0
    small = pieces.join(done, "number").select("row.*", "sequence_id", "offset")
    full = pieces.where(F.col("size") >= capacity).select("row.*", (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return small.unionByName(full)
