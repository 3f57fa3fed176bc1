"""Helpers shared by the corpus operators: Arrow text buffers, hashing, materialised steps, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy temporaries are built for at once (a longer document is a slice of its own).
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and an odd base with its inverse modulo 2**64.
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string or binary column, one after another, and the n+1 offsets; null is empty."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, values = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values is not None else np.empty(0, np.uint8)
    return data, at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of documents that hold at most ``most`` bytes, or one document."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def powers(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        out = np.full(max(n, SLICE_BYTES + 2), base, np.uint64)
        out[0] = 1
        _powers[key] = np.cumprod(out)
    return _powers[key]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[j]-H[i] = the polynomial hash of values[i:j], times BASE**-i (modulo 2**64)."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(INVERSE, len(values))[: len(values)], out=out[1:])
    return out


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (h[end] - h[start]) * powers(BASE, len(h))[start]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Masks that keep the first 0 to 8 bytes of a little-endian word.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Strings of more bytes are hashed one by one.
SHORT = 32


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one little-endian word (zeros after the end)."""
    wide = np.zeros(len(data) + 16, np.uint8)
    wide[: len(data)] = data
    return np.ndarray(len(data) + 8, "<u8", wide, strides=(1,))


def byte_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: eight bytes after eight through a finaliser, strings of more than SHORT bytes by XXH3.

    Unlike a polynomial modulo 2**64 it has no strings that collide by their form.
    """
    import xxhash

    word, size = eights(data), end - start
    h = mix(size.astype(np.uint64) * BASE)
    for k in range(0, SHORT, 8):
        live = np.flatnonzero(size > k)
        if not len(live):
            break
        h[live] = mix(h[live] * BASE + (word[start[live] + k] & KEEP[np.minimum(size[live] - k, 8)]))
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return h


#: ASCII white space as the n-gram contract has it: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, at: np.ndarray, lower: bool = True):
    """Start, end and 64-bit hash of every maximal run of bytes that are no white space; runs end with their document."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[:-1][np.diff(at) > 0]
    first[cuts] = inside[cuts]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    end = np.flatnonzero(last) + 1
    return start, end, byte_hash(LOWER[data] if lower else data, start, end)


def spread(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of ranges one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted (a plain sort, which beats the hash table of numpy.unique here)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


#: Bits of a bitmap of hashes: 4 MB, whatever the number of hashes.
BITS_LOG2 = 25


def bitmap(hashes: DataFrame) -> DataFrame:
    """(bucket, words: 512 longs): at most 2**(BITS_LOG2 - 15) rows of 4 kB, for the column ``h``."""
    place = F.col("h").bitwiseAND(F.lit((1 << BITS_LOG2) - 1))
    bits = hashes.groupBy(F.shiftright(place, 15).alias("bucket")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits"))
    words = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    return bits.select("bucket", words.alias("words"))


def within(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` with the column __in: whether the bit of ``h`` is set, as it is for all of the bitmap's hashes and a few others."""
    place = F.col("h").bitwiseAND(F.lit((1 << BITS_LOG2) - 1))
    bits = F.broadcast(marks.withColumnRenamed("bucket", "__bucket"))
    marked = rows.withColumn("__place", place).join(bits, F.shiftright("__place", 15) == F.col("__bucket"), "left")
    # the bitmap's first byte is a word's highest, its first bit a byte's lowest
    bit = F.expr("shiftright(words[cast((__place & 32767) >> 6 as int)], cast(56 - (__place & 56) + (__place & 7) as int)) & 1")
    return marked.withColumn("__in", F.coalesce(bit == 1, F.lit(False))).drop("__place", "__bucket", "words")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) with label = the smallest node reachable, for the undirected ``edges`` (a, b); nodes without edges have no row.

    Large-star / small-star contraction; every round is materialised in the shared folder.
    Stars are joins and grouped minima, so a hub of any degree is pre-aggregated, never gathered.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a hangs below the least of a's neighbourhood
        large = both.join(low, both["a"] == low["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        # small star: every smaller neighbour of a, and a itself, hang below the least
        small = large.join(low2, large["a"] == low2["k"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("p")).select("p.*").where("a <> b").distinct()
        old, e = e, materialize(small, "edges")
        discard(old)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
