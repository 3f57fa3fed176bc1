"""N-gram Jaccard join: documents whose sets of word n-grams are alike, as connected components.

1. A fixed-size table of n-gram frequencies is summed over all documents (SLOTS counters, so its broadcast is bounded).
2. Each set is ordered rare first, by (frequency, hash). Two sets alike enough share an n-gram of their prefixes. Prefixes are
   dealt by n-gram over buckets; only n-grams with two different sets come back, as rows. Equal sets are one set from here on.
3. Pairs pass the length and positional filters, a filter on histograms of the sets' hashes, and, with the sets at hand, the suffix filter;
   each is verified once, on whole sets.

A bucket is read in portions: an n-gram of very many sets is told by rows as they come, and only its hub is kept, so no task holds a hot n-gram whole.

Copies of one document by the thousand would make pairs by the million, though components need few of them. So first each
set is paired with the most central set of its n-grams (the one whose prefix reaches the n-gram first), and the links found
are contracted. Then every n-gram pairs the rest: all sets of different components that pass the filters. A pair inside one component
could only join what is joined, so none that matters is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, components, discard, distinct, materialize, mix, slices, utf8, within, words

#: Counters of the frequency table, 4 bytes each.
SLOTS_LOG2 = 20
BLOCKS = 64
#: Tables of counts that one task adds up at each level.
FAN = 64
#: Bytes of text for each bucket of prefixes.
BUCKET_BYTES = 24 << 20
#: Bytes of messages that a task holds before it gives out the n-grams of more than HOT sets.
HELD_BYTES, HOT = 32 << 20, 4096
#: Ranges of hashes whose counts make the histogram filter, at first and where pairs are few.
PIVOTS, FINE_PIVOTS = 16, 256
#: How often the suffix filter parts two sets.
DEPTH = 4


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each document the sorted distinct 64-bit hashes of its n-grams of lower-case words (with fewer words, of all of them as one)."""
    start, _, h = words(data, at)
    edge = np.searchsorted(start, at)
    gram = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(gram)])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a >= n:
            yield distinct(gram[a : b - n + 1])
        elif b > a:
            short = np.zeros(1, np.uint64)
            for k in range(a, b):
                short = mix(short * np.uint64(0x9E3779B97F4A7C15) + h[k])
            yield mix(short + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def fingerprint(grams: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    n = np.uint64(len(grams))
    return mix(np.array([mix(grams).sum(dtype=np.uint64) + n, mix(grams ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) - n], np.uint64)).tobytes()


def _binary(prints: np.ndarray):
    """(k, 2) 64-bit numbers as an Arrow column of 16 bytes each."""
    import pyarrow as pa

    k = len(prints)
    return pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer((np.arange(k + 1) * 16).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(prints).tobytes())])


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection with which sets of n and m have 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def frequencies(text: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Counts of n-grams (once for each document) by the first bits of their hash, and the bytes of all texts."""

    names, schema = ["block", "part", "bytes", "counts"], "block int, part int, bytes long, counts binary"

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        total, size = np.zeros(1 << SLOTS_LOG2, np.int64), 0
        for batch in batches:
            data, at = utf8(batch.column(0))
            size += len(data)
            for i, j in slices(at):
                found = list(shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], n))
                total += np.bincount((np.concatenate(found) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64), minlength=len(total))
        press, part = zstandard.ZstdCompressor(level=1).compress, TaskContext.get().partitionId()
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([part] * BLOCKS, pa.int32()), pa.array([size] + [0] * (BLOCKS - 1), pa.int64()), pa.array([press(x.tobytes()) for x in np.split(total, BLOCKS)], pa.binary())], names)

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        sums, sizes = {}, {}
        for batch in batches:
            for block, part, size, counts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                key, counts = (block, part // FAN), np.frombuffer(open_(counts), np.int64)
                sums[key] = sums[key] + counts if key in sums else counts
                sizes[key] = sizes.get(key, 0) + size
        press = zstandard.ZstdCompressor(level=1).compress
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in sums], pa.int32()), pa.array([p for _, p in sums], pa.int32()), pa.array(list(sizes.values()), pa.int64()), pa.array([press(x.tobytes()) for x in sums.values()], pa.binary())], names)

    import zstandard

    # a task adds up FAN tables of a block, then FAN of the sums, so none reads what all tasks counted
    rows = text.mapInArrow(count, schema)
    for _ in range(2):
        rows = rows.repartition(BLOCKS, "block", F.expr(f"part div {FAN}")).mapInArrow(add, schema)
    table, size = np.zeros((BLOCKS, (1 << SLOTS_LOG2) // BLOCKS), np.int64), 0
    for block, _, part, counts in rows.collect():  # BLOCKS rows of a fixed size for each FAN * FAN tasks
        table[block] += np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), np.int64)
        size += part
    return np.minimum(table, 2**32 - 1).astype(np.uint32).reshape(-1), size


def _signature(grams: np.ndarray, ranges: int = PIVOTS) -> bytes:
    """How many hashes lie in each of the ranges, as unsigned 16-bit numbers modulo 2**16."""
    return np.bincount((grams >> np.uint64(65 - ranges.bit_length())).astype(np.int64), minlength=ranges).astype("<u2").tobytes()


def suffix_bound(x: np.ndarray, y: np.ndarray, most: int, depth: int = DEPTH) -> int:
    """At least so many n-grams are in one of the sorted sets only, as far as the suffix filter sees up to more than ``most``.

    Both are parted by the middle n-gram of ``y``: what lies below it in the one differs from what lies below it in the other by the
    difference in size at least, and above it likewise; each part is parted again, ``depth`` times in all.
    """
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    both = at < len(x) and x[at] == y[middle]
    parts = ((x[:at], y[:middle]), (x[at + both :], y[middle + 1 :]))
    left, right = (abs(len(p) - len(q)) for p, q in parts)
    alone = 1 - both
    if left + right + alone > most:
        return left + right + alone
    left = suffix_bound(*parts[0], most - right - alone, depth - 1)
    if left + right + alone > most:
        return left + right + alone
    return left + suffix_bound(*parts[1], most - left - alone, depth - 1) + alone


def histogram_filter(pairs: DataFrame, percent: int, ranges: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b, sig_a, sig_b) less those whose sets differ in too many n-grams by their counts alone; without the signatures."""

    def close(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n1, n2 = (batch.column(k).to_numpy() for k in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, ranges).astype(np.int32) for k in (4, 5))
            apart = np.abs(x - y)
            apart = np.minimum(apart, 65536 - apart).sum(1)  # the sets differ in so many at least
            yield batch.filter(pa.array(apart <= n1 + n2 - 2 * least_overlap(n1, n2, percent))).select(["a", "b", "n_a", "n_b"])

    return pairs.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(close, "a binary, b binary, n_a long, n_b long")


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``; component_id is the smallest id reachable by links, itself included.

    Words are runs other than ASCII white space, A-Z in lower case. A set: the distinct n-grams, or all words as one where they are fewer. Two rows
    link when 100 * intersection >= ``percent`` * union. A null or empty text and one without words has no n-grams and links with nothing.
    Repeated rows are linked as equal sets; a null id is reached by others but never smallest; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("body"))
    table, size = frequencies(rows.select("body"), n)
    sent = spark.sparkContext.broadcast(table)
    buckets = max(24, -(-size // BUCKET_BYTES))

    def prefixes(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        press, count = zstandard.ZstdCompressor(level=1).compress, sent.value
        names = ["bucket", "message", "doc", "n", "fp", "sig"]

        def messages(grams, owner, place, prints, sizes):
            gram, who, pos = np.concatenate(grams), np.repeat(np.arange(len(owner)), owner), np.concatenate(place)
            bucket = (gram % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            key = (gram // np.uint64(buckets)).astype(np.uint32)
            fp, n_of = np.frombuffer(b"".join(prints), np.uint64).reshape(-1, 2), np.array(sizes, np.uint32)
            full = np.flatnonzero(np.diff(edges)).tolist()
            out = []
            for b in full:
                x = order[edges[b] : edges[b + 1]]
                own, which = np.unique(who[x], return_inverse=True)
                head = np.array([len(x), len(own)], "<u4").tobytes() + key[x].tobytes() + fp[own].tobytes()
                out.append(head + press(n_of[own].tobytes() + which.astype(np.uint32).tobytes() + pos[x].astype(np.uint32).tobytes()))
            none = lambda kind: pa.nulls(len(full), kind)
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(out, pa.binary()), none(pa.int64()), none(pa.int64()), none(pa.binary()), none(pa.binary())], names)

        grams, owner, place, prints, sizes, known, held = [], [], [], [], [], set(), 0
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in slices(at):
                ns, fps, sigs = [], [], []
                for s in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], n):
                    ns.append(len(s))
                    if not len(s):
                        fps.append(None)
                        sigs.append(None)
                        continue
                    fp = fingerprint(s)
                    fps.append(fp)
                    sigs.append(_signature(s))
                    if fp in known:
                        continue
                    known.add(fp)
                    p = len(s) + (-percent * len(s) // 100) + 1
                    order = np.lexsort((s, count[(s >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)]))[:p]
                    grams.append(s[order])
                    owner.append(p)
                    place.append(np.arange(p))
                    prints.append(fp)
                    sizes.append(len(s))
                    held += p
                k = j - i
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), batch.column(0).slice(i, k), pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], names)
                if held > 1 << 18:
                    yield messages(grams, owner, place, prints, sizes)
                    grams, owner, place, prints, sizes, known, held = [], [], [], [], [], set(), 0
        if held:
            yield messages(grams, owner, place, prints, sizes)

    both = materialize(rows.mapInArrow(prefixes, "bucket int, message binary, doc long, n long, fp binary, sig binary"), "prefixes")
    sets = both.where("bucket is null").select("doc", "n", "fp", "sig")
    classes = sets.where("fp is not null").groupBy("fp").agg(F.min("doc").alias("rep"), F.first("sig").alias("sig"))

    def shared(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress

        def opened(held):
            """(n-gram, set, size, place) of the entries of messages."""
            keys, prints, sizes, places = [], [], [], []
            for m in held:
                k, docs_ = np.frombuffer(m[:8], "<u4").tolist()
                tail = open_(m[8 + 4 * k + 16 * docs_ :])
                which = np.frombuffer(tail, np.uint32, k, 4 * docs_)
                keys.append(np.frombuffer(m, np.uint32, k, 8))
                prints.append(np.frombuffer(m[8 + 4 * k : 8 + 4 * k + 16 * docs_], np.uint64).reshape(-1, 2)[which])
                sizes.append(np.frombuffer(tail, np.uint32, docs_)[which])
                places.append(np.frombuffer(tail, np.uint32, k, 4 * docs_ + 4 * k))
            return keys, prints, sizes, places

        def groups(bucket, kept, held, least):
            """Rows of the n-grams of ``least`` sets or more, each with its hub, and then the entries to keep: all others, and those hubs."""
            key, fp, size_, place = (np.concatenate([a, *b]) if len(a) else np.concatenate(b) for a, b in zip(kept, opened(held), strict=True))
            order = np.lexsort((fp[:, 1], fp[:, 0], place, key))
            key, fp, size_, place = key[order], fp[order], size_[order], place[order]
            # of equal sets (their places agree) one is left
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]).any(1) | (place[1:] != place[:-1])
            key, fp, size_, place = key[new], fp[new], size_[new], place[new]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            group = np.cumsum(first) - 1
            many = np.bincount(group)[group] >= least
            hub = np.flatnonzero(first)[group]
            gram = key.astype(np.int64) * buckets + bucket
            told = np.flatnonzero(many)
            for a in range(0, len(told), 1 << 16):
                x = told[a : a + (1 << 16)]
                y = hub[x]
                number = lambda v: pa.array(v.astype(np.int64))
                yield pa.RecordBatch.from_arrays([number(gram[x]), _binary(fp[x]), number(size_[x]), number(place[x]), _binary(fp[y]), number(size_[y]), number(place[y])], ["gram", "fp", "n", "pos", "hub", "hub_n", "hub_pos"])
            stay = ~many | first
            return key[stay], fp[stay], size_[stay], place[stay]

        nothing = (np.empty(0, np.uint32),) * 4
        here, kept, held, size = None, nothing, [], 0
        for batch in batches:
            for bucket, message in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != here and held:
                    yield from groups(here, kept, held, 2)
                    kept, held, size = nothing, [], 0
                here = bucket
                held.append(message.as_py())
                size += len(held[-1])
                if size > HELD_BYTES:
                    kept = yield from groups(here, kept, held, HOT)
                    held, size = [], 0
        if held or len(kept[0]):
            yield from groups(here, kept, held, 2)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 8)
    dealt = both.where("bucket is not null").select("bucket", "message").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    entries = materialize(dealt.mapInArrow(shared, "gram long, fp binary, n long, pos long, hub binary, hub_n long, hub_pos long"), "entries")

    def possible(n1, p1, n2, p2):
        """Length and positional filter: the first n-gram in common can still be followed by enough others."""
        least = F.expr(f"ceil({percent} * ({n1} + {n2}) / {100 + percent}.0)")
        return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2)) >= least)

    def whole(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, at = utf8(batch.column(0))
            for i, j in slices(at):
                found = [s for s in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], n) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in found], pa.binary()), pa.array([_signature(s, FINE_PIVOTS) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["fp", "sig", "grams"])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The links (a, b) among the pairs: the filter on counts by range, then the suffix filter and the intersection of the whole sets."""

        def signed(rows: DataFrame, sigs: DataFrame) -> DataFrame:
            return rows.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")

        near = materialize(histogram_filter(signed(pairs, classes.select("fp", "sig")), percent, PIVOTS), f"{name}-pairs")
        # whole sets of one document for each set in question, straight from the scan; the few others that the bitmap lets through meet no pair
        ends = near.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(classes, "fp")
        texts = within(rows.withColumn("h", F.xxhash64("doc")), bitmap(ends.select(F.xxhash64("rep").alias("h")))).where("__in").select("body")
        grams = materialize(texts.mapInArrow(whole, "fp binary, sig binary, grams binary"), f"{name}-sets")
        close = histogram_filter(signed(near, grams.select("fp", "sig")), percent, FINE_PIVOTS)

        def alike(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    small, large = (x, y) if len(x) < len(y) else (y, x)
                    least = int(least_overlap(len(x), len(y), percent))
                    if suffix_bound(small, large, len(x) + len(y) - 2 * least) > len(x) + len(y) - 2 * least:
                        keep.append(False)
                        continue
                    found = large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small
                    common = int(found.sum())
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

        b = grams.select(F.col("fp").alias("b"), F.col("grams").alias("grams_b"))
        a = grams.select(F.col("fp").alias("a"), F.col("grams").alias("grams_a"))
        full = close.join(b, "b").join(a, "a").select("a", "b", "grams_a", "grams_b")
        out = materialize(full.mapInArrow(alike, "a binary, b binary").distinct(), name)
        discard(near, grams)
        return out

    star = entries.where("fp <> hub").where(possible("n", "pos", "hub_n", "hub_pos"))
    star = star.groupBy("fp", "n", "hub", "hub_n").agg(F.count("*").alias("common"))
    star = star.groupBy("fp", "n").agg(F.max_by(F.struct("hub", "hub_n"), F.struct("common", "hub")).alias("best"))
    star = star.select(F.col("fp").alias("a"), F.col("best.hub").alias("b"), F.col("n").alias("n_a"), F.col("best.hub_n").alias("n_b"))
    star = materialize(star, "tried")
    links = verified(star, "star")
    first = components(links)

    # what is left: n-grams whose sets lie in several components
    labelled = entries.select("gram", "fp", "n", "pos").join(first.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    labelled = materialize(labelled, "labelled")
    mixed = labelled.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gram")
    rest = labelled.join(mixed, "gram")
    x = rest.select("gram", F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("p_a"), F.col("label").alias("l_a"))
    y = rest.select("gram", F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("p_b"), F.col("label").alias("l_b"))
    pairs = x.join(y, "gram").where("l_a < l_b").where(possible("n_a", "p_a", "n_b", "p_b")).select("a", "b", "n_a", "n_b").distinct()
    # no pair is verified again
    tried = star.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("pair")).select("pair.*")
    pairs = pairs.join(tried, ["a", "b"], "left_anti")
    links = materialize(first.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(verified(pairs, "rest")), "links")
    discard(entries, labelled, star)
    found = components(links).select(F.col("node").alias("fp"), "label")

    reached = classes.select("fp", "rep").join(found, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = reached.groupBy("label").agg(F.min("rep").alias("component_id"))
    reached = reached.join(least, "label").select("fp", "component_id")
    out = sets.join(reached, "fp", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("fp").isNotNull(), F.col("component_id")), F.col("doc")).alias("component_id"))
