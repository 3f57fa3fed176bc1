"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 bytes cuts texts into chunks that depend on content alone, so documents that share a passage share its chunks. A chunk is
encoded once and found again by its bytes. Where two chunks meet, ids may be wrong: a pre-token may have been cut, or a run of white space judged by
the wrong neighbour. So every join is repaired: a window from the second sync point before it to the second after it is encoded anew. Up to the first
sync point its ids must agree with the left chunk's, from the last one on with the right chunk's; what lies between is taken from the window. A
window that doesn't agree is widened, a sync point more on each side, in the end to the whole document. A sync point is a blank between two visible characters:
no pre-token of the vocabulary spans it. A cut without two sync points of its own on either side is no cut. At last the ids are
decoded; a text that doesn't come back byte for byte is encoded whole by the library.

The most shared chunks of the corpus, HOT_CHUNKS at most of HOT_BYTES each, are found by a count over all
documents, encoded once and broadcast (bounded by these two parameters); any other chunk is encoded once by each Python
worker, which keeps a bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, byte_hash, distinct, mix, prefix_hash, range_hash, slices, utf8

WINDOW = 16
#: One position in 2**CUT_BITS ends a chunk.
CUT_BITS = 10
HOT_CHUNKS = 4096
HOT_BYTES = 4096
#: Ids that a worker's table of chunks holds at most.
TABLE_IDS = 1 << 20


def _chunks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges of chunks, sync points); every document's borders are edges, and every other edge has two sync points of its own on each side."""
    n = len(data)
    h = prefix_hash(BYTE_VALUES[data])
    visible = (data > 32) & (data < 127)
    sync = np.zeros(n, bool)
    if n > 2:
        sync[1:-1] = (data[1:-1] == 32) & visible[:-2] & visible[2:]
    here = np.arange(WINDOW, n + 1) if n >= WINDOW else np.empty(0, np.int64)
    cut = here[(mix(range_hash(h, here - WINDOW, here)) >> np.uint64(64 - CUT_BITS)) == 0]
    doc = np.searchsorted(at, cut, "right") - 1
    good = (doc < len(at) - 1) & (cut - WINDOW >= at[np.minimum(doc, len(at) - 1)]) & ((data[np.minimum(cut, n - 1)] & 0xC0) != 0x80)
    # a sync point on a document's border has no neighbour there
    borders = at[(at > 0) & (at < n)]
    sync[borders] = sync[borders - 1] = False
    sync = np.flatnonzero(sync)
    before, first, end = np.searchsorted(sync, cut), np.searchsorted(sync, at)[np.minimum(doc, len(at) - 1)], np.searchsorted(sync, at)[np.minimum(doc + 1, len(at) - 1)]
    keep, used, last = [], 0, -1
    for k, ok, c, low, high, d in zip(range(len(cut)), good.tolist(), before.tolist(), first.tolist(), end.tolist(), doc.tolist(), strict=True):
        low = used if d == last else low
        if ok and c - low >= 2 and high - c >= 2:
            keep.append(k)
            used, last = c + 2, d
    return distinct(np.concatenate([at, cut[keep]])), sync


class Reuse:
    """A worker's table of encoded chunks, by their bytes; how many joins it has met, and of how many the ids were wrong."""

    def __init__(self, path: str, hot: dict[bytes, bytes]):
        from .tokens import decoder, encoder

        self.encoder, self.decoder = encoder(path), decoder(path)
        self.hot = {k: np.frombuffer(v, np.uint32) for k, v in hot.items()}
        self.table, self.held = dict(self.hot), 0
        self.joins = self.repaired = self.widened = 0

    def _of_chunks(self, data: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """The ids of all chunks one after another, each as if it stood alone."""
        if self.held > TABLE_IDS:
            self.table, self.held = dict(self.hot), 0
        table, raw = self.table, data.tobytes()
        chunks = [raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        need = [c for c in dict.fromkeys(chunks) if c not in table]
        if need:
            ids, at_ids = self.encoder.encode(np.frombuffer(b"".join(need), np.uint8), np.cumsum([0] + [len(c) for c in need]))
            for c, a, b in zip(need, at_ids[:-1].tolist(), at_ids[1:].tolist(), strict=True):
                table[c] = ids[a:b].copy()
                self.held += b - a
        return np.concatenate([table[c] for c in chunks]) if chunks else np.empty(0, np.uint32)

    def _whole(self, data: np.ndarray) -> np.ndarray:
        return np.array(self.encoder.library.encode(data.tobytes().decode("utf-8"), add_special_tokens=False).ids, np.uint32)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(at), np.int64)
        edge, sync = _chunks(data, at)
        ids = self._of_chunks(data, distinct(edge))
        ends = np.cumsum(self.decoder.size[ids])
        joins = np.setdiff1d(edge, at)
        ids = self._repaired(data, at, sync, ids, ends, joins)
        text, widths = self.decoder.decode(ids)
        at_ids = np.searchsorted(np.cumsum(widths), at, "right")
        if len(text) == len(data) and (text == data).all():
            return ids, at_ids
        whole = [self._whole(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return np.concatenate(whole), np.concatenate([[0], np.cumsum([len(x) for x in whole])])

    def _repaired(self, data, at, sync, ids, ends, joins) -> np.ndarray:
        """``ids`` with the ids across every join encoded anew, as far as the windows agree with both sides."""
        if not len(joins):
            return ids
        self.joins += len(joins)
        k = np.searchsorted(sync, joins)
        left, right, low, high = sync[k - 1], sync[k], sync[k - 2], sync[k + 1]
        tokens = lambda p: np.searchsorted(ends, p, "right")  # noqa: E731  how many tokens end at p or before
        size = high - low
        pieces = np.concatenate([data[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        found, at_found = self.encoder.encode(pieces, np.concatenate([[0], np.cumsum(size)]))
        parts, done = [], 0
        rows = zip(*(x.tolist() for x in (left, right, low, high, tokens(low), tokens(left), tokens(right), tokens(high), at_found[:-1], at_found[1:], joins)), strict=True)
        for a, b, p, q, t_low, t_left, t_right, t_high, i, j, join in rows:
            window = found[i:j]
            reach = np.cumsum(self.decoder.size[window]) + p
            u, v = int(np.searchsorted(reach, a, "right")), int(np.searchsorted(reach, b, "right"))
            agree = np.array_equal(window[:u], ids[t_low:t_left]) and np.array_equal(window[v:], ids[t_right:t_high])
            if not (agree and ends[t_left - 1] == a and ends[t_right - 1] == b and reach[v - 1] == b and (not u or reach[u - 1] == a)):
                self.widened += 1
                return self._documents(data, at)
            self.repaired += not np.array_equal(window[u:v], ids[t_left:t_right])
            parts += [ids[done:t_left], window[u:v]]
            done = t_right
        return np.concatenate([*parts, ids[done:]])

    def _documents(self, data, at) -> np.ndarray:
        """The windows widened to whole documents."""
        return self.encoder.encode(data, at)[0]


def _hot_chunks(docs: DataFrame, path: str, text_col: str) -> dict[bytes, bytes]:
    text = docs.select(F.col(text_col).cast("string").alias("body"))

    def seen(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, at = utf8(batch.column(0))
            for i, j in slices(at):
                part = data[at[i] : at[j]]
                edge, _ = _chunks(part, at[i : j + 1] - at[i])
                short = np.flatnonzero(np.diff(edge) <= HOT_BYTES)
                key, n = np.unique(byte_hash(part, edge[short], edge[short + 1]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    counts = text.mapInArrow(seen, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    top = {r[0] for r in counts.orderBy(F.desc("n"), "key").limit(HOT_CHUNKS).select("key").collect()}
    if not top:
        return {}
    sent = docs.sparkSession.sparkContext.broadcast(np.array(sorted(top), np.int64))

    def texts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        wanted, done = sent.value, set()
        for batch in batches:
            data, at = utf8(batch.column(0))
            for i, j in slices(at):
                part = data[at[i] : at[j]]
                edge, _ = _chunks(part, at[i : j + 1] - at[i])
                short = np.flatnonzero(np.diff(edge) <= HOT_BYTES)
                key = byte_hash(part, edge[short], edge[short + 1]).view(np.int64)
                keys, chunks = [], []
                for k in np.flatnonzero(np.isin(key, wanted)).tolist():
                    if int(key[k]) not in done:
                        done.add(int(key[k]))
                        keys.append(int(key[k]))
                        chunks.append(part[edge[short[k]] : edge[short[k] + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(chunks, pa.binary())], ["key", "chunk"])

    def encoded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .tokens import encoder

        for batch in batches:
            data, at = utf8(batch.column(1))
            ids, at_ids = encoder(path).encode(data, at)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([ids[a:b].tobytes() for a, b in zip(at_ids[:-1], at_ids[1:], strict=True)], pa.binary())], ["chunk", "ids"])

    found = text.mapInArrow(texts, "key long, chunk binary").groupBy("key").agg(F.min("chunk").alias("chunk"))
    return {bytes(r[0]): bytes(r[1]) for r in found.mapInArrow(encoded, "chunk binary, ids binary").collect()}


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary: unsigned 32-bit, little-endian) for every row of ``docs``, as the tokenizers library encodes.

    A null or empty text has no ids; repeated rows give repeated rows; ids of documents may be null; other columns are
    ignored; an empty table gives an empty result. ``tokenizer`` is the path of a byte-level vocabulary file that the executors see.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_hot_chunks(docs, tokenizer, text_col))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reuse = Reuse(tokenizer, sent.value)
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in slices(at):
                ids, at_ids = reuse.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])
                out = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at_ids * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at_ids)), out], ["id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).mapInArrow(run, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded``: the text of the ids, special tokens included; null ids give an empty text."""
    from pyspark.sql.types import StringType, StructType

    schema = StructType([*encoded.schema.fields]).add("decoded", StringType())
    place = encoded.columns.index(ids_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .tokens import decoder

        table = decoder(tokenizer)
        for batch in batches:
            data, at = utf8(batch.column(place))
            for i, j in slices(at, 1 << 22):
                text, size = table.decode(np.frombuffer(data[at[i] : at[j]].tobytes(), "<u4"))
                ends = np.concatenate([[0], np.cumsum(size)])[(at[i : j + 1] - at[i]) // 4]
                raw = text.tobytes()
                out = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, out], schema.fieldNames())

    return encoded.mapInArrow(run, schema)
