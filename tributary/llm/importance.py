"""Target-distribution importance resampling by hashed n-grams.

Every text is words (A-Z lowered, runs of digits, letters a-z and bytes from 0x80 on) and its features are all runs of 1 to ``most`` words. A feature's bucket is the CRC-32 of its
bytes modulo ``buckets``. A document weighs the mean gain of its features, the logarithm of how much likelier their buckets are in the target than in the corpus; with Gumbel noise
added, the highest scores are a sample without replacement in proportion to exp(weight).

Tasks keep an integer dictionary: a different word gets the next id, and an n-gram is a tuple of ids. Each different tuple of a slice of text is hashed once, over the bytes that its words and the blanks
between them give, and its bucket goes to all places where it stands. The dictionary is by value (no hash stands for a word) and starts anew when it holds TABLE words. Counts over all
documents are added up bucket by bucket; what goes to every task is one gain a bucket.

Texts are read in slices that end between words; the last words of a slice go on to the next of the same document, so that a document of any length needs the memory of a slice (a single word is
never cut). Null and empty texts have no features: weight 0. A null id is noise of the empty string; repeated rows are rows. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.positions import numbered
from .common import LOWER, materialize, utf8

#: Bytes of text that are turned into words at once.
SLICE = 1 << 21
#: Words that a task's dictionary holds before it starts anew.
TABLE = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TRANSLATE = LOWER.tobytes()
#: Words of more bytes are hashed one by one.
SHORT = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c.astype(np.uint32)


CRC = _crc_table()


class Dictionary(dict):
    """Word to id, in order of arrival; ``names`` is the way back."""

    def __init__(self):
        super().__init__()
        self.names: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        return n


class Features:
    """Buckets of n-grams by integer tuples; one for each task."""

    def __init__(self, most: int, buckets: int):
        self.most, self.buckets = most, buckets
        self.hashed = 0
        self.clear()

    def clear(self) -> None:
        self.words = Dictionary()
        self.bytes, self.size = np.empty(0, np.uint8), np.empty(0, np.int64)
        #: CRC-32 of each word, and of the word with a blank after it.
        self.alone, self.open = np.empty(0, np.uint32), np.empty(0, np.uint32)

    def _learn(self) -> None:
        """Bytes and checksums of the words that are new."""
        new = self.words.names[len(self.size) :]
        if new:
            add = lambda old, values, kind: np.concatenate([old, np.array(values, kind)])
            self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(new), np.uint8)])
            self.size = add(self.size, [len(w) for w in new], np.int64)
            alone = [zlib.crc32(w) for w in new]
            self.alone = add(self.alone, alone, np.uint32)
            self.open = add(self.open, [zlib.crc32(b" ", c) for c in alone], np.uint32)
            self.hashed += len(new)
        self.start = np.cumsum(self.size) - self.size

    def _extended(self, crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Checksums carried on over the bytes of one word each."""
        size = self.size[word]
        out = crc.copy()
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = zlib.crc32(self.words.names[word[i]], int(crc[i]))
        order = np.argsort(-np.where(size > SHORT, 0, size), kind="stable")
        live = np.bincount(np.where(size > SHORT, 0, size), minlength=1)[::-1].cumsum()[::-1]  # how many have at least so many bytes
        register, at = ~crc[order], self.start[word[order]]
        for j in range(len(live) - 1):
            k = int(live[j + 1])
            register[:k] = CRC[(register[:k] ^ self.bytes[at[:k] + j]) & 255] ^ (register[:k] >> np.uint32(8))
        k = int(live[1]) if len(live) > 1 else 0
        out[order[:k]] = ~register[:k]
        return out

    def _of(self, tuples: np.ndarray) -> np.ndarray:
        """Buckets of id tuples, a row each; every different one is hashed once."""
        k = tuples.shape[1]
        if k == 1:
            return self.alone[tuples[:, 0]].astype(np.int64) % self.buckets
        # ids are below TABLE plus the words of a slice, hence below 2**31
        if k == 2:
            found, inverse = np.unique(tuples[:, 0] << 32 | tuples[:, 1], return_inverse=True)
            ids = [found >> 32, found & 0xFFFFFFFF]
        else:
            found, inverse = np.unique(tuples, axis=0, return_inverse=True)
            ids = list(found.T)
        crc = self.open[ids[0]]
        for place, word in enumerate(ids[1:], 2):
            crc = self._extended(crc, word)
            if place < k:
                register = ~crc
                crc = ~(CRC[(register ^ np.uint32(32)) & 255] ^ (register >> np.uint32(8)))
        self.hashed += len(found)
        return (crc.astype(np.int64) % self.buckets)[inverse.ravel()]

    def slices(self, data: bytes, at: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, its words, bucket) of slices: arrays of documents with new words and their number, then document and bucket of every feature."""
        low = data.translate(_TRANSLATE)
        i, n, tail = 0, len(at) - 1, []
        begin = 0
        while i < n:
            j = i
            if at[i + 1] - begin > SLICE:
                # part of a long document, up to a place between words
                end = begin + SLICE
                cut = _between(low, end, at[i + 1])
                parts, tails, stay = [(i, begin, cut)], tail, cut < at[i + 1]
            else:
                while j + 1 < n and at[j + 2] - begin <= SLICE:
                    j += 1
                parts, tails, stay, cut = [(d, begin if d == i else at[d], at[d + 1]) for d in range(i, j + 1)], tail, False, at[j + 1]
            if len(self.words.names) > TABLE:
                names = [self.words.names[w] for w in tails]
                self.clear()
                tails = [self.words[w] for w in names]
            lists = [list(map(self.words.__getitem__, WORD.findall(low, a, b))) for _, a, b in parts]
            self._learn()
            sizes = np.array([len(x) for x in lists])
            ids = np.fromiter(chain(tails, *lists), np.int64, len(tails) + int(sizes.sum()))
            docs = np.concatenate([np.full(len(tails), parts[0][0]), np.repeat([p[0] for p in parts], sizes)]).astype(np.int64)
            of, buckets = [], []
            for k in range(1, self.most + 1):
                if len(ids) < k:
                    break
                last = np.arange(k - 1, len(ids))
                # within one document, and not wholly of words that an earlier slice has counted
                last = last[(docs[last] == docs[last - k + 1]) & (last >= len(tails))]
                if len(last):
                    of.append(docs[last])
                    buckets.append(self._of(np.stack([ids[last - k + 1 + x] for x in range(k)], axis=1)))
            empty = np.empty(0, np.int64)
            yield np.array([p[0] for p in parts]), sizes, np.concatenate(of) if of else empty, np.concatenate(buckets) if buckets else empty
            mine = ids[docs == parts[-1][0]]
            tail = mine[max(0, len(mine) - self.most + 1) :].tolist() if stay else []
            begin, i = cut, i if stay else j + 1


def _between(low: bytes, end: int, stop: int) -> int:
    """The first place from ``end`` on that is not inside a word, ``stop`` at the latest."""
    m = WORD.match(low, end, stop)
    return m.end() if m else end


def bucket_counts(texts: DataFrame, most: int = 2, buckets: int = 10000, text_col: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts each bucket holds; buckets without any have no row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features, counts = Features(most, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            data, at = utf8(batch.column(0))
            for _, _, _, found in features.slices(data.tobytes(), at.tolist()):
                counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("body")).mapInArrow(run, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10000) -> list[int]:
    """The gain of each bucket, in thousandths, floored; add-one smoothed shares of the two bucket counts. ``buckets`` numbers come to the driver."""
    both = corpus.select("bucket", F.lit(0).alias("side"), "n").unionByName(target.select("bucket", F.lit(1).alias("side"), "n"))
    n = [[0] * buckets, [0] * buckets]
    for r in both.collect():
        n[r["side"]][r["bucket"]] = r["n"]
    s, t = sum(n[0]), sum(n[1])
    return [math.floor(1000 * math.log((n[1][b] + 1) * (s + buckets) / ((n[0][b] + 1) * (t + buckets)))) for b in range(buckets)]


def weights(docs: DataFrame, gain: list[int], most: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of a document's features, 0 without any."""
    kind = docs.schema[id_col].dataType.simpleString()
    gain = np.array(gain, np.int64)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features = Features(most, len(gain))
        for batch in batches:
            data, at = utf8(batch.column(1))
            n = len(at) - 1
            words, count, total = (np.zeros(n, np.int64) for _ in range(3))
            for of, sizes, who, found in features.slices(data.tobytes(), at.tolist()):
                words[of] += sizes
                count += np.bincount(who, minlength=n)
                np.add.at(total, who, gain[found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, count, total // np.maximum(count, 1)))], [id_col, "n_words", "n_features", "weight"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("body")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int) -> Column:
    """Noise of an id in thousandths, floored: -1000 ln(-ln(u)), u from the first 32 bits of the SHA-256 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, most: int = 2, buckets: int = 10000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): every document, and the rank of those drawn: the ``percent`` highest scores of documents with ``least_words`` words, ties to the smaller id
    (null last). Ranks are places in ranges of the order, so no task sees all documents."""
    gain = gains(bucket_counts(docs, most, buckets, text_col), bucket_counts(target, most, buckets, target_text), buckets)
    scored = weights(docs, gain, most, id_col, text_col).withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed))
    scored = materialize(scored, "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    # the row's own number parts rows that are equal in score and id
    placed = numbered(able.withColumn("__own", F.monotonically_increasing_id()), [F.desc("score"), F.asc_nulls_last(id_col), F.asc("__own")], "rank").drop("__own")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*rest.columns).unionByName(rest)
