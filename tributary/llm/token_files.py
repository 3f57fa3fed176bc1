"""Binary token files: blocks of ids transposed into byte or bit planes, each plane compressed with zstandard, and a chunk index."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, utf8

#: Ids of a block; the last block of a chunk may be shorter.
BLOCK_IDS = 16384
#: A chunk ends with the document that reaches so many ids.
CHUNK_IDS = 1 << 18


def pack_block(ids: np.ndarray, planes: str, compress) -> list[bytes]:
    """Planes of one block, lowest first, as many as its largest id needs."""
    most = int(ids.max()) if len(ids) else 0
    if planes == "byte":
        table = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [compress(table[:, k].tobytes()) for k in range(max(1, -(-most.bit_length() // 8)))]
    return [compress(np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes()) for k in range(max(1, most.bit_length()))]


def unpack_block(parts: list[bytes], n: int, planes: str, decompress) -> np.ndarray:
    if planes == "byte":
        table = np.zeros((n, 4), np.uint8)
        for k, part in enumerate(parts):
            table[:, k] = np.frombuffer(decompress(part), np.uint8)
        return table.reshape(-1).view("<u4")
    out = np.zeros(n, np.uint32)
    for k, part in enumerate(parts):
        out |= np.unpackbits(np.frombuffer(decompress(part), np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


def pack_chunk(ids: np.ndarray, planes: str, level: int = 1) -> tuple[bytes, bytes]:
    """(index, payload) of a chunk: the index has, for each block, the number of ids, of planes, and each plane's compressed length."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=level).compress
    index, payload = [], []
    for a in range(0, len(ids), BLOCK_IDS):
        parts = pack_block(ids[a : a + BLOCK_IDS], planes, compress)
        index += [min(BLOCK_IDS, len(ids) - a), len(parts), *map(len, parts)]
        payload += parts
    return np.array(index, "<u4").tobytes(), b"".join(payload)


def unpack_chunk(index: bytes, payload: bytes, planes: str) -> np.ndarray:
    import zstandard

    decompress = zstandard.ZstdDecompressor().decompress
    marks, out, k, at = np.frombuffer(index, "<u4").tolist(), [], 0, 0
    while k < len(marks):
        n, count = marks[k], marks[k + 1]
        sizes, parts = marks[k + 2 : k + 2 + count], []
        for size in sizes:
            parts.append(payload[at : at + size])
            at += size
        out.append(unpack_block(parts, n, planes, decompress))
        k += 2 + count
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, planes: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, each with ``end_id`` after it, in ascending order of the id, as a table of chunks at ``path``.

    One row a chunk: shard (ascending with the ids of documents), chunk (ascending in its shard), n_ids, doc_ids, n_tokens (of
    each document), planes, index, payload. A chunk holds whole documents, so it is read alone. Texts are range-partitioned once by id;
    nothing is gathered. Null or empty texts have the end id alone; a null id comes first; repeated ids stand side by side;
    an empty table gives an empty file table.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder

        coder, shard, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids_of, sizes, parts, held = [], [], [], 0

        def chunk():
            nonlocal number, ids_of, sizes, parts, held
            index, payload = pack_chunk(np.concatenate(parts), planes)
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([ids_of], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([planes]), pa.array([index], pa.binary()), pa.array([payload], pa.binary())],
                ["shard", "chunk", "n_ids", "doc_ids", "n_tokens", "planes", "index", "payload"],
            )
            number, ids_of, sizes, parts, held = number + 1, [], [], [], 0
            return out

        end = np.array([end_id], np.uint32)
        for batch in batches:
            data, at = utf8(batch.column(1))
            keys = batch.column(0).to_pylist()
            for i, j in slices(at):
                ids, at_ids = coder.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])
                for k in range(j - i):
                    parts += [ids[at_ids[k] : at_ids[k + 1]], end]
                    n = int(at_ids[k + 1] - at_ids[k]) + 1
                    ids_of.append(keys[i + k])
                    sizes.append(n)
                    held += n
                    if held >= CHUNK_IDS:
                        yield chunk()
        if parts:
            yield chunk()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    schema = "shard int, chunk int, n_ids long, doc_ids array<long>, n_tokens array<long>, planes string, index binary, payload binary"
    rows.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids binary]) of each document, from the files at ``path``; start counts the ids of all documents before it."""
    files = spark.read.schema("shard int, chunk int, n_ids long, doc_ids array<long>, n_tokens array<long>, planes string, index binary, payload binary").parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row a shard (a partition of the writer), hence few
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    chunks = files.select("shard", "chunk", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n_ids")).alias("chunk_start"))
    chunks = chunks.join(shards, "shard").select("shard", "chunk", (F.col("shard_start") + F.col("chunk_start")).alias("base"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for shard, number, keys, sizes, planes, index, payload in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                ids = unpack_chunk(index, payload, planes)
                ends = np.cumsum(np.array(sizes, np.int64))
                raw = ids.astype("<u4").tobytes()
                parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes, strict=True)]
                columns = [pa.array([shard] * len(keys), pa.int32()), pa.array([number] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(ends - np.array(sizes)), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                names = ["shard", "chunk", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = files.select("shard", "chunk", "doc_ids", "n_tokens", "planes", "index", "payload").mapInArrow(run, "shard int, chunk int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    rows = rows.join(chunks, ["shard", "chunk"])
    return rows.select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def new_path(spark: SparkSession, name: str = "tokens") -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
