"""Approximate nearest neighbours by inner product, with randomly rotated one-bit codes.

A vector's difference from the centre of its cell is rotated at random and stored as one sign a dimension, packed in words, with a few correction scalars. A query is rotated alike and cut into bit planes
of PLANES bits, so that its inner product with a code is a few population counts; divided by the code's own share of its vector this estimates the true inner product without bias, and the
share says how far off it may be (``sigmas`` standard errors). Only vectors whose upper bound reaches the query's threshold are looked at again, with all their numbers in double precision.

The index is fitted on a bounded sample (SAMPLE vectors, those with the least hash of the id): centres of cells, and each query's threshold, the 2k-th best score within the sample, which is below
the k-th best of all. Every vector is indexed. The few queries for which the bounds let fewer than k through are asked again without a threshold, so that each gets k. A query goes only to cells whose centre and radius let them hold something above the threshold. Cells of many vectors are dealt into parts
of at most PART_BYTES, queries into groups of at most QUERIES; a task has one part and one group, and gives at most k rows a query.

Defined results: rows without an id, null or empty vectors, vectors of another length than most (of equally many the longer), zeros, and vectors with null or non-finite numbers take no part. A query
finds no row of its own id; of several rows of one id the query is the one with the least vector, and each is a candidate. Equal vectors get equal scores; ties go to the smaller id. With fewer than k
candidates all are given. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors that cells and thresholds are fitted on (fewer where they would exceed 64 MB), cells, and rounds of fitting.
SAMPLE, CELLS, ROUNDS = 8192, 16, 8
#: Bytes of vectors in a part, queries in a group, and pairs estimated at once.
PART_BYTES, QUERIES, PAIRS = 1 << 25, 1 << 14, 1 << 20
PLANES = 4
SEED = 20240613


class Model:
    """Rotation, cells and the sample: bounded by the dimensions and SAMPLE, whatever the number of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, cells: int):
        rng = np.random.default_rng(SEED)
        d = vectors.shape[1]
        # codes are whole words: the dimensions are filled up with zeros before they are rotated
        self.width = -(-d // 64) * 64
        q, r = np.linalg.qr(rng.standard_normal((self.width, self.width)))
        self.rotation = (q * np.sign(np.diag(r)))[:d]
        self.ids, self.vectors = ids, vectors
        self.centres = vectors[np.sort(rng.permutation(len(vectors))[:cells])]
        for _ in range(ROUNDS):
            at = self.cell(vectors)
            self.centres = np.array([vectors[at == k].mean(axis=0) if (at == k).any() else c for k, c in enumerate(self.centres)])

    def cell(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centres**2).sum(axis=1) - 2 * (x @ self.centres.T), axis=1)

    def encode(self, x: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs (rows, words), distance from the centre, the code's share of the rotated unit vector, and the inner product with the centre."""
        away = x - self.centres[cell]
        far = np.sqrt((away**2).sum(axis=1))
        turned = away @ self.rotation
        signs = turned > 0
        share = np.abs(turned).sum(axis=1) / np.sqrt(self.width) / np.where(far > 0, far, 1)
        words = np.packbits(signs, axis=1, bitorder="little").view("<u8")
        return words, far, np.where(far > 0, share, 1.0), x @ self.centres[cell]

    def planes(self, away: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bit planes (plane, rows, words) of rotated queries, with the least value, the step, and the sum of what the planes stand for."""
        turned = away @ self.rotation
        low = turned.min(axis=1)
        step = (turned.max(axis=1) - low) / ((1 << PLANES) - 1)
        step = np.where(step > 0, step, 1.0)
        # rounding at random keeps the estimate without bias; the same numbers for every query, so that a retry gives the same
        noise = np.random.default_rng(SEED + 1).random(self.width)
        steps = np.clip(np.floor((turned - low[:, None]) / step[:, None] + noise), 0, (1 << PLANES) - 1).astype(np.uint8)
        bits = np.stack([np.packbits((steps >> k) & 1, axis=1, bitorder="little").view("<u8") for k in range(PLANES)])
        return bits, low, step, low * self.width + step * steps.sum(axis=1)

    def bounds(self, queries: np.ndarray, cell: int, code: tuple, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries, rows) with a cell's coded vectors, and how far off they may be."""
        words, far, share, own = code
        away = queries - self.centres[cell]
        bits, low, step, total = self.planes(away)
        both = np.zeros((len(queries), len(words)), np.uint16)
        ones = np.zeros(len(words), np.uint16)
        for w in range(words.shape[1]):
            ones += np.bitwise_count(words[:, w])
            for k in range(PLANES):
                both += np.bitwise_count(bits[k][:, w, None] & words[None, :, w]).astype(np.uint16) << k
        # sums of the rotated query where the signs are set, twice, less all of it: the product with the signs
        signed = 2 * (low[:, None] * ones + step[:, None] * both) - total[:, None]
        away_by = np.sqrt((away**2).sum(axis=1))
        estimate = signed * (far / share / np.sqrt(self.width)) + own + (away @ self.centres[cell])[:, None]
        # of the code's direction, and of rounding the query (a step has a variance of at most a quarter)
        error = (far * np.sqrt(np.maximum(1 - share**2, 0)) / share / np.sqrt(max(self.width - 1, 1)))[None, :] * away_by[:, None]
        rounding = (far / share)[None, :] * (step / 2)[:, None]
        return estimate, sigmas * np.sqrt(error**2 + rounding**2) + 1e-9


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision; each depends on its two rows alone, so that equal vectors get equal scores."""
    return (a * b).sum(axis=1)


def matrix(column) -> np.ndarray:
    """An Arrow list column whose lists are of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector): rows that take part."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    some = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull()).where(fine)
    # one row for each length that occurs
    length = some.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return some.where(F.size("vector") == (length["d"] if length else 0))


def fitted(rows: DataFrame, cells: int = CELLS, most: int = SAMPLE) -> Model | None:
    """The model of a bounded sample of (id, vector), fitted on the driver; None without vectors."""
    one = rows.select(F.size("vector").alias("d")).first()
    if one is None:
        return None
    most = max(1, min(most, (1 << 23) // one["d"]))
    chosen = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(most).toArrow().sort_by("id")
    return Model(chosen["id"].to_numpy(), matrix(chosen["vector"].combine_chunks()), min(cells, len(chosen)))


def nearest(rows: DataFrame, is_query, k: int = 20, sigmas: float = 2.0, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = CELLS, sample: int = SAMPLE, part_bytes: int = PART_BYTES, group: int = QUERIES) -> DataFrame:
    """(query_id, rank from 1, id, score): the ``k`` nearest found of each row for which ``is_query`` (a condition on the column id) holds. Ids must be whole numbers."""
    spark, kind = rows.sparkSession, rows.schema[id_col].dataType.simpleString()
    some = usable(rows, id_col, vector_col)
    model = fitted(some, cells, sample)
    empty = spark.createDataFrame([], f"query_id {kind}, rank int, `{id_col}` {kind}, score double")
    if model is None:
        return empty
    shared = spark.sparkContext.broadcast(model)
    d = model.vectors.shape[1]

    def index(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            x = matrix(batch.column(1))
            at = m.cell(x)
            for cell in np.unique(at).tolist():
                who = np.flatnonzero(at == cell)
                words, far, share, own = m.encode(x[who], cell)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(who), cell), pa.int32()), batch.column(0).take(pa.array(who)), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(far), pa.array(share), pa.array(own), batch.column(1).take(pa.array(who))],
                    ["cell", "id", "code", "far", "share", "own", "vector"],
                )

    indexed = materialize(some.mapInArrow(index, f"cell int, id {kind}, code binary, far double, share double, own double, vector array<double>"), "codes")
    sizes = {r["cell"]: (r["n"], r["far"]) for r in indexed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    rows_each = max(1, part_bytes // (8 * d))
    parts = np.array([-(-sizes.get(c, (0, 0.0))[0] // rows_each) for c in range(len(model.centres))])
    radius = np.array([sizes.get(c, (0, 0.0))[1] for c in range(len(model.centres))])
    queries = some.where(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    groups = max(1, -(-queries.count() // group))

    def ask(batches: Iterator, bounded: bool) -> Iterator:
        """Each query once for each part of the cells that may hold something above its threshold."""
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            for a in range(0, len(ids), 256):
                q, mine = x[a : a + 256], ids[a : a + 256]
                scores = np.where(mine[:, None] == m.ids, -np.inf, q @ m.vectors.T)
                # a hair below, since the sums here are in another order than those of the result
                least = np.partition(scores, -2 * k, axis=1)[:, -2 * k] if bounded and scores.shape[1] >= 2 * k else np.full(len(q), -np.inf)
                least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.inf)
                most = q @ m.centres.T + np.sqrt((q**2).sum(axis=1))[:, None] * radius * (1 + 1e-9) + 1e-12
                who, cell = np.nonzero((most >= least[:, None]) & (parts > 0))
                rows_of, n = np.repeat(np.arange(len(who)), parts[cell]), parts[cell]
                part = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = who[rows_of]
                yield pa.RecordBatch.from_arrays([pa.array(cell[rows_of], pa.int32()), pa.array(part, pa.int64()), batch.column(0).take(pa.array(a + at)), batch.column(1).take(pa.array(a + at)), pa.array(least[at])], ["cell", "part", "id", "vector", "least"])

    # a part's rows are told by where they were written, so that equal rows are dealt evenly, and the same way if a task runs again
    n_parts = F.element_at(F.array(*[F.lit(max(1, int(n))) for n in parts]), F.col("cell") + 1)
    dealt = indexed.withColumn("part", F.pmod(F.monotonically_increasing_id(), n_parts).cast("long"))
    dealt = dealt.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def search(key, left, right):
        import pyarrow as pa

        m, cell = shared.value, key[0].as_py()
        out: list = [[], [], []]
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            ids, x = right["id"].to_numpy(), matrix(right["vector"].combine_chunks())
            words = np.frombuffer(b"".join(right["code"].to_pylist()), "<u8").reshape(len(ids), -1)
            code = (words, *(right[c].to_numpy() for c in ("far", "share", "own")))
            mine, q, least = left["id"].to_numpy(), matrix(left["vector"].combine_chunks()), left["least"].to_numpy()
            step = max(1, PAIRS // len(ids))
            for a in range(0, len(mine), step):
                b = slice(a, a + step)
                estimate, error = m.bounds(q[b], cell, code, sigmas)
                other = mine[b][:, None] != ids
                lower = np.where(other, estimate - error, -np.inf)
                floor = least[b].copy()
                if len(ids) > k:
                    floor = np.maximum(floor, np.partition(lower, -k, axis=1)[:, -k])
                who, row = np.nonzero(other & (estimate + error >= floor[:, None]))
                score = np.concatenate([products(q[b][who[i : i + 65536]], x[row[i : i + 65536]]) for i in range(0, len(who), 65536)] or [np.empty(0)])
                # of each query the k best, ties to the smaller id
                good = np.flatnonzero(score >= least[b][who])
                who, row, score = who[good], row[good], score[good]
                order = np.lexsort((ids[row], -score, who))
                who, row, score = who[order], row[order], score[order]
                first = np.searchsorted(who, who)
                best = np.arange(len(who)) - first < k
                for c, v in zip(out, (mine[b][who[best]], ids[row[best]], score[best]), strict=True):
                    c.append(v)
        kind_of = left.schema.field("id").type
        whole = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"query_id": pa.array(whole[0], kind_of), id_col: pa.array(whole[1], kind_of), "score": pa.array(whole[2], pa.float64())})

    def best(of: DataFrame, bounded: bool) -> DataFrame:
        by = ("cell", "part", "group")
        asked = of.mapInArrow(lambda batches: ask(batches, bounded), f"cell int, part long, id {kind}, vector array<double>, least double")
        asked = asked.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)))
        found = asked.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(search, f"query_id {kind}, `{id_col}` {kind}, score double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col)))
        return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")

    first = materialize(best(queries, True), "nearest")
    if len(model.ids) < 2 * k:
        return first
    full = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = materialize(queries.join(full, queries["id"] == full["query_id"], "left_anti"), "short")
    if short.isEmpty():
        return first
    return first.join(full, "query_id", "left_semi").unionByName(best(short, False))
