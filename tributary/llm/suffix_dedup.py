"""Suffix-array dedup: bytes covered by a long string that an earlier document has too are removed.

Every string of ``length`` bytes has one anchor in it, the least of its 24-byte hashes, chosen by content alone; so
equal strings have equal anchors at equal places, and only strings of one anchor need comparing. The strings
of one anchor occurrence are the suffixes (cut at ``length`` bytes) that start in one short region of text.

1. Texts are written once as chunks: a row each, so that later steps name a byte by chunk and place. A long document is cut into
   slices that overlap by more than a string, so that memory is bounded by a chunk, whatever the length of a document.
2. Anchors are dealt by hash over buckets as (anchor, document). Those that one document has alone are done with.
3. The regions of the others are dealt by anchor, with their bytes. Equal ones, told by hash and then byte by byte, become one. The suffixes of
   what is left are sorted: a mergesort whose comparisons find the common extension by binary search over prefix polynomial hashes.
   Neighbours equal by hash are compared byte by byte. Of each run of equal strings only those in the smallest document stay.
4. The verdicts, a bit a string, go back to their chunks.

A hot anchor, one with very many regions (a passage in much of the corpus), has them as rows, each chunk every different region once. They travel with the messages of step 3, dealt by chunk, so that
no chunk is read or dealt once more for them. Equal regions of all chunks are grouped first, then taken apart into strings, whose smallest documents are a grouped minimum; Spark sums both up before its shuffles, so no task gathers a hot anchor.
No byte goes because hashes agree: every removal rests on equal bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTE_VALUES, materialize, mix, powers, prefix_hash, range_hash, slices, spread, utf8

ANCHOR = 24
#: Bytes of text in a chunk or slice.
CHUNK_BYTES = 1 << 20
#: Bytes of text whose anchors are sought at once, so that numpy's temporaries stay in a core's cache.
BLOCK = 1 << 17
#: Bytes of text for each bucket of anchors.
BUCKET_BYTES = 12 << 20
#: An anchor with so many different regions in one chunk, or regions in all (some twentieth of a bucket's bytes), is hot.
HOT_HERE, HOT = 64, 8192
NONE, PART, HOT_PART = 0, 1, 2
#: Suffixes that are sorted at once.
SORTED = 60_000
LAST = np.iinfo(np.int64).max

CHUNKS = "chunk long, size long, ids array<long>, at binary, text binary, rest binary, document long, slice int, lead int, own int"


def chunked(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """CHUNKS, written in the shared folder: size, in bytes; ids; at, the offsets (int64); text, zstandard; rest, the other columns as Arrow.

    A slice of a long document also has document, its number; slice, from 0; and lead and own: how many of its bytes come before its own, and how many those are.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    pad, most = length + 4, CHUNK_BYTES

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        press = zstandard.ZstdCompressor(level=3).compress
        held, size = [], 0

        def others(table) -> bytes:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_batch(table.set_column(1, table.schema.field(1), pa.nulls(table.num_rows, table.schema.field(1).type)))
            return press(sink.getvalue().to_pybytes())

        def chunk(ids, at, data, rest, document=None, number_of=None, lead=None, own=None):
            nonlocal number
            number += 1
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            values = [number - 1, len(data), ids, at.tobytes(), press(data.tobytes()), rest, document, number_of, lead, own]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["chunk", "size", "ids", "at", "text", "rest", "document", "slice", "lead", "own"])

        def whole():
            nonlocal held, size
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            data, at = utf8(table.column(1))
            held, size = [], 0
            return chunk(table.column(0).cast(pa.int64()).to_pylist(), at, data, others(table))

        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in slices(at, most // 4):
                n = int(at[j] - at[i])
                if n > most:  # one document
                    text, first = data[at[i] : at[j]], number
                    for k, a in enumerate(range(0, n, most)):
                        low, high = max(0, a - pad), min(n, a + most + pad)
                        part = text[low:high]
                        table = batch.slice(i, 1)
                        yield chunk(table.column(0).cast(pa.int64()).to_pylist(), np.array([0, len(part)], np.int64), part, others(table) if not k else None, first, k, a - low, min(n, a + most) - a)
                    continue
                if held and size + n > most:
                    yield whole()
                held.append(batch.slice(i, j - i))
                size += n
        if held:
            yield whole()

    rows = docs.select(F.col(id_col).alias("c0"), F.col(text_col).cast("string").alias("c1"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(rest, 2)])
    return materialize(rows.mapInArrow(run, CHUNKS), "chunks")


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of the runs of a sorted array."""
    if len(x):
        edges = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])
        yield from zip(x[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] and data[b:b+size] have equal bytes."""
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), 8192):
        n = size[i : i + 8192]
        same = data[spread(n, a[i : i + 8192])] == data[spread(n, b[i : i + 8192])]
        out[i : i + 8192] = np.logical_and.reduceat(same, np.cumsum(n) - n) if len(n) else True
    return out


class Regions:
    """Anchors of a chunk and the regions of text whose strings they stand for; the same for every reading of a chunk."""

    def __init__(self, ids: list, at: bytes, text: bytes, length: int, buckets: int):
        import zstandard

        self.length, self.buckets = length, buckets
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)
        self.at = np.frombuffer(at, np.int64)
        self.ids = np.array([LAST if x is None else x for x in ids], np.int64)
        starts = max(0, len(self.data) - length + 1)
        parts = [self._anchors(a, min(a + BLOCK, starts)) for a in range(0, starts, BLOCK)]
        none = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
        key, self.first, self.last, region = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none
        self.doc = self.ids[np.searchsorted(self.at, self.first, "right") - 1] if len(self.first) else np.empty(0, np.int64)
        # the different (anchor, region), each with the smallest document; others of a larger document are repeats
        order = np.argsort(key)
        k = key[order]
        twin = np.zeros(len(k), bool)
        twin[1:] = k[1:] == k[:-1]
        several = twin.copy()
        several[:-1] |= twin[1:]
        x = order[several]
        order[several] = x[np.lexsort((self.first[x], self.doc[x], region[x], key[x]))]
        twin[1:] &= region[order][1:] == region[order][:-1]
        # equal by hash: compare the bytes
        y = np.flatnonzero(twin)
        size = self.last - self.first + length
        p, q = order[y - 1], order[y]
        twin[y] = size[p] == size[q]
        y = np.flatnonzero(twin)
        p, q = order[y - 1], order[y]
        twin[y] = _equal(self.data, self.first[p], self.first[q], size[q])
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(~twin) - 1
        self.lead = order[~twin]
        self.key = key[self.lead]
        self.bucket = (self.key % np.uint64(buckets)).astype(np.int64)
        # an anchor with many regions here sends the first HOT_HERE of them only
        begin = np.concatenate([[True], self.key[1:] != self.key[:-1]]) if len(self.key) else np.empty(0, bool)
        rank = np.arange(len(self.key)) - np.flatnonzero(begin)[np.cumsum(begin) - 1] if len(self.key) else np.empty(0, np.int64)
        self.order = np.flatnonzero(rank < HOT_HERE)
        self.order = self.order[np.argsort(self.bucket[self.order], kind="stable")]

    def _anchors(self, base: int, stop: int):
        """(key, first and last start of the region's strings, hash of the region) of each anchor occurrence, for strings that start from ``base`` to before ``stop``."""
        width, length = self.length - ANCHOR + 1, self.length
        data = self.data[base : stop + length - 1]
        n = len(data)
        h = prefix_hash(BYTE_VALUES[data])
        key = (h[ANCHOR:] - h[:-ANCHOR]) * powers(BASE, n)[: n - ANCHOR + 1]
        # hash above, place below: the least of a window is the leftmost of its least anchors
        order = key ^ (key >> np.uint64(29))
        order *= np.uint64(0x9E3779B97F4A7C15)
        order &= np.uint64(0xFFFFFFFF << 32)
        order |= np.arange(n - ANCHOR + 1, dtype=np.uint64)
        least, s = order, 1
        while s * 2 <= width:
            least = np.minimum(least[:-s], least[s:])
            s *= 2
        if width > s:
            least = np.minimum(least[: len(least) - (width - s)], least[width - s :])
        good = np.ones(len(least) + 1, bool)
        good[-1] = False
        ends = self.at[np.searchsorted(self.at, base, "right") : np.searchsorted(self.at, base + n)]
        for end in (ends - base).tolist():
            good[max(0, end - length + 1) : end] = False
        turn = np.ones(len(least) + 1, bool)
        turn[1:-1] = least[1:] != least[:-1]
        change = turn[:-1] & good[:-1]
        change[1:] |= good[1:-1] & ~good[:-2]
        first = np.flatnonzero(change)
        last = np.flatnonzero(good[:-1] & (turn[1:] | ~good[1:]))
        place = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        shape = ((last - first).astype(np.uint64) * np.uint64(0x9E37) + (place - first).astype(np.uint64)) * np.uint64(0xD1B54A32D192ED03)
        region = mix(range_hash(h, first, last + length) ^ shape)
        return mix(key[place]), first + base, last + base, region

    def messages(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, message) with the keys and documents of the entries sent, bucket by bucket."""
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        lead, key = self.lead[self.order], (self.key[self.order] // np.uint64(self.buckets)).astype(np.uint32)
        for b, i, j in _runs(self.bucket[self.order]):
            docs, which = np.unique(self.doc[lead[i:j]], return_inverse=True)
            tail = np.diff(docs, prepend=0).tobytes() + which.astype(np.uint32).tobytes()
            yield b, np.array([j - i, len(docs)], "<u4").tobytes() + key[i:j].tobytes() + press(tail)

    def verdicts(self, replies: dict[int, bytes]) -> np.ndarray:
        """The verdict on every entry, from the buckets' replies (two bits each, in the order sent)."""
        out = np.full(len(self.lead), HOT_PART, np.uint8)
        for b, i, j in _runs(self.bucket[self.order]):
            bits = np.unpackbits(np.frombuffer(replies[b], np.uint8), count=2 * (j - i)).reshape(-1, 2)
            out[self.order[i:j]] = bits[:, 0] * 2 + bits[:, 1]
        return out

    def parts(self, verdict: np.ndarray) -> np.ndarray:
        """The entries whose regions are sorted elsewhere, by bucket."""
        x = np.flatnonzero(verdict == PART)
        return x[np.argsort(self.bucket[x], kind="stable")]

    def part_messages(self, verdict: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(bucket, message) with the keys, documents, numbers of suffixes and bytes of regions."""
        import zstandard

        press, x = zstandard.ZstdCompressor(level=1).compress, self.parts(verdict)
        for b, i, j in _runs(self.bucket[x]):
            lead, key = self.lead[x[i:j]], self.key[x[i:j]] // np.uint64(self.buckets)
            size = self.last[lead] - self.first[lead] + 1
            text = self.data[spread(size + self.length - 1, self.first[lead])]
            yield b, press(np.array([j - i], "<i8").tobytes() + self.doc[lead].tobytes() + key.astype("<u4").tobytes() + size.astype("<u4").tobytes() + text.tobytes())

    def hot_regions(self, verdict: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of hot anchors, and how many strings start in each."""
        hot = self.lead[verdict == HOT_PART]
        return hot, self.last[hot] - self.first[hot] + 1

    def hot_messages(self, verdict: np.ndarray) -> Iterator[bytes]:
        """Messages with the documents, sizes and bytes of some hot regions each, and the number of the first."""
        import zstandard

        press, (hot, size) = zstandard.ZstdCompressor(level=1).compress, self.hot_regions(verdict)
        for i in range(0, len(hot), 4096):
            some, wide = hot[i : i + 4096], size[i : i + 4096] + self.length - 1
            yield press(np.array([len(some), i], "<i8").tobytes() + self.doc[some].tobytes() + wide.astype("<u4").tobytes() + self.data[spread(wide, self.first[some])].tobytes())

    def removed(self, verdict: np.ndarray, replies: dict[int, bytes], hot_gone: list[dict]) -> np.ndarray:
        """Which bytes of the chunk go. ``hot_gone``: of hot regions by number, which of their strings an earlier document has."""
        starts = np.zeros(len(self.data) + 1, bool)
        x = self.parts(verdict)
        for b, i, j in _runs(self.bucket[x]):
            lead = self.lead[x[i:j]]
            size = self.last[lead] - self.first[lead] + 1
            flags = np.unpackbits(np.frombuffer(replies[b], np.uint8), count=int(size.sum())).astype(bool)
            starts[spread(size, self.first[lead])[flags]] = True
        hot, size = self.hot_regions(verdict)
        for x in hot_gone:
            lead = self.first[hot[x["number"]]]
            starts[lead : lead + size[x["number"]]] = x["gone"]
        # other occurrences of an entry: in its lead's document they go as the lead does, in a larger one as a whole
        other = np.flatnonzero(self.lead[self.entry] != np.arange(len(self.entry)))
        lead = self.lead[self.entry[other]]
        size = self.last[other] - self.first[other] + 1
        whole = self.doc[other] > self.doc[lead]
        source, target = spread(size, self.first[lead]), spread(size, self.first[other])
        starts[target[starts[source] | np.repeat(whole, size)]] = True
        count = np.cumsum(starts[:-1], dtype=np.int32)
        gone = count.copy()
        gone[self.length :] -= count[: -self.length]
        return gone > 0


def judge(messages: list[bytes]) -> list[bytes]:
    """Replies to one bucket's messages: of each anchor whether several documents have it, and whether it is hot."""
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    keys, docs, sizes = [], [], []
    for m in messages:
        n, k = np.frombuffer(m[:8], "<u4").tolist()
        keys.append(np.frombuffer(m, np.uint32, n, 8))
        tail = open_(m[8 + 4 * n :])
        docs.append(np.cumsum(np.frombuffer(tail[: 8 * k], np.int64))[np.frombuffer(tail[8 * k :], np.uint32)])
        sizes.append(n)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((chunk, key))
    k, c = key[order], chunk[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    anchor, first = np.cumsum(new) - 1, np.flatnonzero(new)
    low, high = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
    hot = np.diff(np.concatenate([first, [len(k)]])) > HOT
    pair = new.copy()
    pair[1:] |= c[1:] != c[:-1]
    begin = np.flatnonzero(pair)
    # what a chunk has of an anchor beyond the first it can't tell, so its strings all go on
    full = np.zeros(len(hot), bool)
    full[anchor[begin[np.diff(np.concatenate([begin, [len(k)]])) >= HOT_HERE]]] = True
    verdict = np.where(full | (hot & (low < high)), HOT_PART, np.where(low < high, PART, NONE))
    out = np.empty(len(k), np.uint8)
    out[order] = verdict[anchor]
    bits = np.stack([out >> 1, out & 1], 1)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return [np.packbits(bits[a:b].reshape(-1)).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def suffix_order(text: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes ``start`` (cut at ``length`` bytes) in each group (groups stand together), and for each the common extension with the one before.

    A bottom-up mergesort of all groups at once: an element's place in a merge is its own index plus its rank in the other run,
    found by binary search; a comparison finds the common extension by binary search over prefix polynomial hashes.
    """
    h, power = prefix_hash(BYTE_VALUES[text]), powers(BASE, len(text) + 1)
    steps = int(length).bit_length()

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.full(len(a), length)
        ha, hb, pa, pb = h[a], h[b], power[a], power[b]
        for _ in range(steps):
            mid = (low + high + 1) >> 1
            same = (h[a + mid] - ha) * pa == (h[b + mid] - hb) * pb
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = common(a, b)
        at = np.minimum(n, length - 1)
        x, y = text[a + at], text[b + at]
        return np.where(n == length, or_equal, x < y)

    n = len(start)
    # the first eight bytes part most suffixes; what they leave together is merged
    head = np.zeros(n, np.uint64)
    for k in range(min(8, length)):
        head = (head << np.uint64(8)) | text[start + k]
    order = np.lexsort((head, group))
    head, group = head[order], group[order]
    apart = np.ones(n, bool)
    apart[1:] = group[1:] != group[:-1]
    new = apart.copy()
    new[1:] |= head[1:] != head[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [n]]))
    begin, many = np.repeat(first, size), np.repeat(size, size)
    run, most = 1, int(size.max()) if n else 0
    while run < most:
        live = np.flatnonzero(many > run)
        within = live - begin[live]
        block = within // run
        left = (block & 1) == 0
        other = begin[live] + np.where(left, block + 1, block - 1) * run
        limit = begin[live] + many[live]
        low, high = np.minimum(other, limit), np.minimum(other + run, limit)
        base = low.copy()
        mine = start[order[live]]
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) >> 1
            before = less(start[order[mid]], mine[todo], ~left[todo])
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        rank = low - base
        place = np.where(left, live + rank, live - run + rank)
        merged = order.copy()
        merged[place] = order[live]
        order = merged
        run *= 2
    same = np.zeros(n, np.int64)
    inner = np.flatnonzero(~apart)
    if len(inner):
        same[inner] = common(start[order[inner - 1]], start[order[inner]])
    return order, same


def _sorted(text: np.ndarray, key: np.ndarray, doc: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of the fragments (their bytes stand one after another), whether a smaller document has its string."""
    wide = size + length - 1
    at = np.cumsum(wide) - wide
    h = prefix_hash(BYTE_VALUES[text])
    hashes = range_hash(h, at, at + wide)
    order = np.lexsort((doc, hashes, wide, key))
    same, p, q = np.zeros(len(order), bool), order[:-1], order[1:]
    same[1:] = (key[p] == key[q]) & (wide[p] == wide[q]) & (hashes[p] == hashes[q])
    y = np.flatnonzero(same)
    same[y] = _equal(text, at[order[y - 1]], at[order[y]], wide[order[y]])
    lead = order[~same]  # of equal fragments the one of the smallest document
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(~same) - 1
    # suffixes of the different fragments of an anchor, where it has several
    many = np.zeros(len(lead), bool)
    many[1:] = key[lead][1:] == key[lead][:-1]
    many[:-1] |= many[1:]
    x = lead[many]
    start = spread(size[x], at[x])
    flags = np.zeros(len(text) + 1, bool)
    if len(x):
        own = np.repeat(doc[x], size[x])
        ranked, common = suffix_order(text, start, np.repeat(key[x], size[x]), length)
        joined = np.flatnonzero(common >= length)
        true = np.zeros(len(ranked), bool)
        # equal by hash: compare the bytes
        true[joined] = _equal(text, start[ranked[joined - 1]], start[ranked[joined]], np.full(len(joined), length))
        run = np.cumsum(~true) - 1
        least = np.minimum.reduceat(own[ranked], np.flatnonzero(~true))
        flags[start[ranked[own[ranked] > least[run]]]] = True
    whole = doc > doc[lead][of]
    return flags[spread(size, at[lead][of])] | np.repeat(whole, size)


def sort_parts(messages: list[bytes], length: int) -> list[bytes]:
    """Replies to one bucket's fragments: for each suffix, whether a smaller document has its string."""
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    keys, docs, sizes, texts, counts = [], [], [], [], []
    for m in messages:
        raw = open_(m)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        docs.append(np.frombuffer(raw, np.int64, n, 8))
        keys.append(np.frombuffer(raw, np.uint32, n, 8 + 8 * n))
        sizes.append(np.frombuffer(raw, np.uint32, n, 8 + 12 * n).astype(np.int64))
        texts.append(np.frombuffer(raw, np.uint8, offset=8 + 16 * n))
        counts.append(int(sizes[-1].sum()))
    key, doc, size, text = np.concatenate(keys), np.concatenate(docs), np.concatenate(sizes), np.concatenate(texts)
    del texts
    wide = size + length - 1
    at, begin = np.cumsum(wide) - wide, np.cumsum(size) - size
    by = np.argsort(key, kind="stable")
    gone = np.zeros(int(size.sum()), bool)
    # whole anchors, some SORTED suffixes at a time
    ends = np.cumsum(size[by])
    edge = np.flatnonzero(np.concatenate([key[by][1:] != key[by][:-1], [True]])) + 1
    a = 0
    while a < len(by):
        done = ends[a - 1] if a else 0
        b = int(edge[min(len(edge) - 1, np.searchsorted(edge, max(a + 1, np.searchsorted(ends, done + SORTED, "right")), "left"))])
        x = by[a:b]
        gone[spread(size[x], begin[x])] = _sorted(text[spread(wide[x], at[x])], key[x], doc[x], size[x], length)
        a = b
    ends = np.concatenate([[0], np.cumsum(counts)])
    return [np.packbits(gone[p:q]).tobytes() for p, q in zip(ends[:-1], ends[1:], strict=True)]


def _rows(batch) -> Iterator[dict]:
    """Rows one by one: a chunk is large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def hot_rows(message: bytes) -> tuple:
    """The regions (binary) of a hot message, their numbers and documents."""
    import pyarrow as pa
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(message)
    n, first = np.frombuffer(raw, "<i8", 2).tolist()
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 16 + 8 * n).astype(np.int64))
    offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(raw[16 + 12 * n :])]), pa.array(np.arange(first, first + n)), pa.array(np.frombuffer(raw, np.int64, n, 16))


def _answered(messages: DataFrame, answer, tasks: int) -> DataFrame:
    """(chunk, bucket, reply, number, doc), written: the messages (bucket, chunk, message, hot) dealt by bucket and answered bucket by bucket.

    Hot messages become a row for each region: reply has its bytes. Other rows have no number and no doc.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        here, chunks, held = None, [], []

        def rows(chunks, bucket, replies, number, doc):
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([bucket] * len(chunks), pa.int32()), replies, number, doc], ["chunk", "bucket", "reply", "number", "doc"])

        def reply():
            none = pa.nulls(len(chunks), pa.int64())
            return rows(chunks, here, pa.array(answer(held), pa.binary()), none, none)

        for batch in batches:
            for bucket, chunk, message, hot in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if hot:
                    regions, number, doc = hot_rows(message.as_py())
                    yield rows([chunk] * len(number), bucket, regions, number, doc)
                    continue
                if bucket != here and held:
                    yield reply()
                    chunks, held = [], []
                here = bucket
                chunks.append(chunk)
                held.append(message.as_py())
        if held:
            yield reply()

    dealt = messages.repartition(tasks, "bucket").sortWithinPartitions("bucket", "chunk")
    return materialize(dealt.mapInArrow(run, "chunk long, bucket int, reply binary, number long, doc long"), "replies")


def _by_chunk(replies: DataFrame, name: str) -> DataFrame:
    return replies.where("number is null").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "reply")).alias(name))


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept (binary: the bytes that stay) in place of the text.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Matches don't cross
    documents and are judged on the input. With ``whole_characters`` the rest of a character that lost a byte is not kept either. A null text
    is empty; a null id is larger than all; rows with equal ids take nothing from each other; repeated rows and other columns stay; a text
    of any length is worked on in slices; an empty table gives an empty result. Columns named like the results are replaced.
    """
    if length <= ANCHOR:
        raise ValueError(f"length must exceed {ANCHOR}")
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    chunks = chunked(docs, id_col, text_col, length)
    total, sliced = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("slice")).first()
    buckets = max(24, -(-total // BUCKET_BYTES))
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 8)

    def regions(row: dict) -> Regions:
        return Regions(row["ids"], row["at"], row["text"], length, buckets)

    def answers(row: dict, name: str) -> dict[int, bytes]:
        return {x["bucket"]: x["reply"] for x in row[name] or ()}

    def message_batches(row: dict, messages: Iterator, hot: bool = False) -> Iterator:
        import pyarrow as pa

        found = list(messages)  # less than the chunk's text, some times over
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([row["chunk"]] * len(found), pa.int64()), pa.array([m for _, m in found], pa.binary()), pa.array([hot] * len(found), pa.bool_())], ["bucket", "chunk", "message", "hot"])

    def sent(batches: Iterator) -> Iterator:
        for batch in batches:
            for row in _rows(batch):
                yield from message_batches(row, regions(row).messages())

    def sent_parts(batches: Iterator) -> Iterator:
        for batch in batches:
            for row in _rows(batch):
                found = regions(row)
                verdict = found.verdicts(answers(row, "replies"))
                yield from message_batches(row, found.part_messages(verdict))
                # an anchor's hot regions would meet in its bucket; a chunk's go to any one
                to = int(mix(np.array([row["chunk"]], np.uint64))[0] % np.uint64(buckets))
                yield from message_batches(row, ((to, m) for m in found.hot_messages(verdict)), hot=True)

    names = docs.columns
    place = [id_col, text_col, *[c for c in names if c not in (id_col, text_col)]]

    def left(row: dict):
        """Of a chunk: its regions, the bytes that go, and those that are not kept."""
        found = regions(row)
        gone = found.removed(found.verdicts(answers(row, "replies")), answers(row, "part_replies"), row["hot_gone"] or [])
        dropped = gone
        if whole_characters and gone.any():
            character = np.cumsum((found.data & 0xC0) != 0x80)
            dropped = (np.bincount(character, gone) > 0)[character]
        return found, gone, dropped

    def kept(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        for batch in batches:
            for row in _rows(batch):
                found, gone, dropped = left(row)
                at, n = found.at, np.diff(found.at)
                count, lost = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, dropped))
                starts = gone.copy()
                starts[1:] &= ~gone[:-1]
                cuts = at[:-1][n > 0]
                starts[cuts] = gone[cuts]
                spans = np.concatenate([[0], np.cumsum(starts)])
                stay = found.data[~dropped]
                ends = at - lost[at]
                old = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_next_batch()
                columns = dict(zip(place, old.columns, strict=True))
                step = 1 << 12
                for i in range(0, len(n), step):
                    j = min(len(n), i + step)
                    size = pa.py_buffer((ends[i : j + 1] - ends[i]).astype(np.int32).tobytes())
                    text = pa.Array.from_buffers(pa.binary(), j - i, [None, size, pa.py_buffer(stay[ends[i] : ends[j]].tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [*(columns[c].slice(i, j - i) for c in names if c != text_col), pa.array(n[i:j]), pa.array(np.diff(count[at[i : j + 1]])), pa.array(np.diff(spans[at[i : j + 1]])), text],
                        [*(c for c in names if c != text_col), "n_bytes", "n_removed", "n_spans", "kept"],
                    )

    def kept_slice(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in _rows(batch):
                found, gone, dropped = left(row)
                a, b = row["lead"], row["lead"] + row["own"]
                before = np.concatenate([[False], gone[:-1]])  # a slice's lead reaches back beyond a string, so this is right from its own first byte on
                values = [row["document"], row["slice"], row["rest"], b - a, int(gone[a:b].sum()), int((gone & ~before)[a:b].sum()), found.data[a:b][~dropped[a:b]].tobytes()]
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["document", "slice", "rest", "n_bytes", "n_removed", "n_spans", "kept"])

    def joined(batches: Iterator) -> Iterator:
        """A long document of its slices, which come in order."""
        import pyarrow as pa
        import zstandard

        def document(rest, n, parts):
            old = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rest)).read_next_batch()
            columns = dict(zip(place, old.columns, strict=True))
            return pa.RecordBatch.from_arrays([*(columns[c] for c in names if c != text_col), *(pa.array([x], pa.int64()) for x in n), pa.array([b"".join(parts)], pa.binary())], [*(c for c in names if c != text_col), "n_bytes", "n_removed", "n_spans", "kept"])

        rest, n, parts = None, [0, 0, 0], []
        for batch in batches:
            for row in _rows(batch):
                if row["slice"] == 0:
                    if rest is not None:
                        yield document(rest, n, parts)
                    rest, n, parts = row["rest"], [0, 0, 0], []
                n = [x + row[c] for x, c in zip(n, ("n_bytes", "n_removed", "n_spans"), strict=True)]
                parts.append(row["kept"])
        if rest is not None:
            yield document(rest, n, parts)

    schema = "bucket int, chunk long, message binary, hot boolean"
    text = chunks.select("chunk", "ids", "at", "text")
    replies = _answered(text.mapInArrow(sent, schema), judge, tasks)
    told = _by_chunk(replies, "replies")
    with_replies = text.join(told, "chunk", "left")
    parts = _answered(with_replies.mapInArrow(sent_parts, schema), lambda held: sort_parts(held, length), tasks)
    held = parts.where("number is not null").select("chunk", "number", F.col("reply").alias("region"), "doc")
    # each different region once, then each different string: the smallest document of each; a region has at most length - ANCHOR + 1 strings
    each = held.groupBy("region").agg(F.min("doc").alias("least"))
    each = materialize(each.withColumn("id", F.monotonically_increasing_id()), "regions")
    starts = F.transform(F.sequence(F.lit(1), F.octet_length("region") - (length - 1)), lambda i: F.substring("region", i, F.lit(length)))
    strings = each.select("id", "least", F.posexplode(starts).alias("at", "string"))
    least = strings.groupBy("string").agg(F.min("least").alias("first"))
    # what no other region has of an earlier document is the region's own, and goes no further
    earlier = strings.join(least, "string").where("first < least").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "first"))).alias("earlier"))
    told_regions = each.join(earlier, "id", "left")
    places = F.sequence(F.lit(0), F.octet_length("region") - length)
    gone = held.join(told_regions, "region").select("chunk", "number", F.transform(places, lambda i: F.coalesce(F.element_at("earlier", i), F.col("least")) < F.col("doc")).alias("gone"))
    gone = gone.where(F.exists("gone", lambda x: x)).groupBy("chunk").agg(F.collect_list(F.struct("number", "gone")).alias("hot_gone"))
    both = chunks.join(told.join(_by_chunk(parts, "part_replies"), "chunk", "left"), "chunk", "left").join(gone, "chunk", "left")
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    out = StructType([*(f for f in docs.schema.fields if f.name != text_col), *(StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")), StructField("kept", BinaryType())])
    if not sliced:
        return both.mapInArrow(kept, out)
    pieces = both.where("slice is not null").mapInArrow(kept_slice, "document long, slice int, rest binary, n_bytes long, n_removed long, n_spans long, kept binary")
    long = pieces.repartition("document").sortWithinPartitions("document", "slice").mapInArrow(joined, out)
    return both.where("slice is null").mapInArrow(kept, out).unionByName(long)
