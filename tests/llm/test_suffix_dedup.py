"""Suffix-array dedup against a brute force over all strings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import suffix_dedup as S

LENGTH = 50


def brute(rows):
    """Removed flags of each (id, bytes)."""
    least = {}
    key = lambda i: float("inf") if i is None else i
    for i, t in rows:
        for p in range(len(t) - LENGTH + 1):
            w = t[p : p + LENGTH]
            least[w] = min(least.get(w, float("inf")), key(i))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - LENGTH + 1):
            if least[t[p : p + LENGTH]] < key(i):
                gone[p : p + LENGTH] = True
        out.append(gone)
    return out


def local(rows, per_chunk, buckets=5):
    """The operator's steps without Spark, chunk by chunk."""
    import zstandard

    chunks = []
    for i in range(0, len(rows), per_chunk):
        part = rows[i : i + per_chunk]
        at = np.concatenate([[0], np.cumsum([len(t) for _, t in part])]).astype(np.int64)
        chunks.append(S.Regions([i for i, _ in part], at.tobytes(), zstandard.ZstdCompressor().compress(b"".join(t for _, t in part)), LENGTH, buckets))

    def deal(messages, answer):
        by = {}
        for c, found in enumerate(messages):
            for b, m in found:
                by.setdefault(b, []).append((c, m))
        out = [{} for _ in chunks]
        for b, held in by.items():
            for (c, _), r in zip(held, answer([m for _, m in held]), strict=True):
                out[c][b] = r
        return out

    replies = deal([list(c.messages()) for c in chunks], S.judge)
    verdicts = [c.verdicts(r) for c, r in zip(chunks, replies, strict=True)]
    parts = deal([list(c.part_messages(v)) for c, v in zip(chunks, verdicts, strict=True)], lambda m: S.sort_parts(m, LENGTH))
    hot = []
    for c, v in zip(chunks, verdicts, strict=True):
        leads, sizes = c.hot_regions(v)
        hot.append([(c.data[p : p + n + LENGTH - 1].tobytes(), int(d)) for p, n, d in zip(c.first[leads].tolist(), sizes.tolist(), c.doc[leads].tolist(), strict=True)])
    strings = lambda region: [region[i : i + LENGTH] for i in range(len(region) - LENGTH + 1)]
    least = {}
    for held in hot:
        for region, d in held:
            for x in strings(region):
                least[x] = min(d, least.get(x, d))
    out = []
    for c, v, r, held in zip(chunks, verdicts, parts, hot, strict=True):
        gone = c.removed(v, r, [{"number": k, "gone": [least[x] < d for x in strings(region)]} for k, (region, d) in enumerate(held)])
        out += [gone[a:b] for a, b in zip(c.at[:-1], c.at[1:], strict=True)]
    return out


def corpus(rng, n, letters):
    base = [bytes(rng.choice(list(letters), int(rng.integers(0, 200)))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(int(rng.integers(0, 4))):
            t = base[int(rng.integers(len(base)))]
            a, b = sorted(rng.integers(0, len(t) + 1, 2).tolist())
            parts.append(t if rng.random() < 0.4 else t[a:b])
            if rng.random() < 0.3:
                parts.append(bytes(rng.choice(list(letters), int(rng.integers(0, 30)))))
        rows.append((int(rng.integers(0, n)), b"".join(parts)))
    return rows


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("hot", [False, True])
def test_against_brute_force(seed, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(S, "HOT_HERE", 2)
        monkeypatch.setattr(S, "HOT", 3)
    rng = np.random.default_rng(seed)
    rows = corpus(rng, 40, [b"ab", b"abcdefgh", b"a"][seed % 3])
    for per_chunk in (3, 40):
        for got, want in zip(local(rows, per_chunk), brute(rows), strict=True):
            assert (got == want).all()


def test_equal_hashes(monkeypatch):
    """Where every hash of a region and every polynomial agrees, bytes alone decide."""
    rng = np.random.default_rng(5)
    rows = corpus(rng, 40, b"ab")
    real = S.range_hash
    monkeypatch.setattr(S, "range_hash", lambda h, a, b: real(h, a, b) * np.uint64(0))
    for got, want in zip(local(rows, 3), brute(rows), strict=True):
        assert (got == want).all()


def test_blocks(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 64)
    rng = np.random.default_rng(6)
    rows = corpus(rng, 40, b"abcdefgh")
    for got, want in zip(local(rows, 10), brute(rows), strict=True):
        assert (got == want).all()


def test_suffix_order():
    rng = np.random.default_rng(1)
    text = rng.choice(np.frombuffer(b"ab", np.uint8), 400)
    start = rng.integers(0, 350, 200)
    group = np.sort(rng.integers(0, 5, 200))
    order, same = S.suffix_order(text, start, group, LENGTH)
    cut = [text[s : s + LENGTH].tobytes() for s in start]
    assert (np.sort(order) == np.arange(200)).all() and (group[order] == group).all()
    for i in range(1, 200):
        if group[i] == group[i - 1]:
            a, b = cut[order[i - 1]], cut[order[i]]
            assert a <= b
            assert same[i] == next((k for k in range(LENGTH) if a[k] != b[k]), LENGTH)


def results(rows, docs):
    """What the operator must return for (id, text): id, n_bytes, n_removed, n_spans, kept."""
    out = []
    for (i, t), g in zip(rows, brute(rows), strict=True):
        spans = int((g & ~np.concatenate([[False], g[:-1]])).sum())
        out.append((str(i), len(t), int(g.sum()), spans, bytes(b for b, x in zip(t, g, strict=True) if not x)))
    got = [(str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in docs]
    return sorted(got), sorted(out)


def test_operator(spark):
    rng = np.random.default_rng(3)
    rows = [(i, t.decode(), f"s{i}") for i, t in corpus(rng, 60, b"abcdefgh")]
    rows += [(100, None, "x"), (None, rows[0][1], None), (101, "", "y"), rows[1], (102, "é" * 60, "z"), (103, "x" + "é" * 60, "z")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, source string, kept string").withColumns({"n_bytes": F.lit("q"), "__id": F.lit(7)}).repartition(3)
    out = S.remove_repeats(df)
    assert out.columns == ["doc_id", "source", "__id", "n_bytes", "n_removed", "n_spans", "kept"]
    out = out.collect()
    got, want = results([(r[0], (r[1] or "").encode()) for r in rows], out)
    assert got == want
    assert sorted((str(r["doc_id"]), str(r["source"])) for r in out) == sorted((str(r[0]), str(r[2])) for r in rows) and {r["__id"] for r in out} == {7}
    assert S.remove_repeats(df.limit(0)).collect() == []


def test_slices(spark, monkeypatch):
    """Documents longer than a chunk, cut and joined again; characters cut in two go only where that is asked for."""
    monkeypatch.setattr(S, "CHUNK_BYTES", 300)
    rng = np.random.default_rng(4)
    texts = [t.decode() for _, t in corpus(rng, 30, b"abcdefgh")]
    rows = [(i, "".join(rng.choice(texts, int(rng.integers(0, 12)))) + "é€" * int(rng.integers(0, 200))) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    plain = [(i, t.encode()) for i, t in rows]
    got, want = results(plain, S.remove_repeats(df).collect())
    assert got == want
    for r, g in zip(sorted(S.remove_repeats(df, whole_characters=True).collect(), key=lambda r: r["doc_id"]), brute(plain), strict=True):
        text, at, left = rows[r["doc_id"]][1], 0, ""
        for c in text:
            n = len(c.encode())
            left += "" if g[at : at + n].any() else c
            at += n
        assert bytes(r["kept"]).decode() == left and r["n_removed"] == int(g.sum())


def test_hot_anchors(spark):
    """A passage before many different endings: its last strings have one anchor and more regions than a chunk sends."""
    rng = np.random.default_rng(8)
    letters = list("abcdefghij ")
    passage = "".join(rng.choice(letters, 90))
    endings = ["".join(rng.choice(letters, 40)) for _ in range(100)]
    rows = [(i, "".join(rng.choice(letters, 30)) + passage + endings[i % 100]) for i in range(300)]
    chunk = S.Regions([i for i, _ in rows], np.cumsum([0] + [len(t) for _, t in rows]).astype(np.int64).tobytes(), __import__("zstandard").ZstdCompressor().compress("".join(t for _, t in rows).encode()), LENGTH, 24)
    answers = {b: S.judge([m])[0] for b, m in chunk.messages()}
    assert (chunk.verdicts(answers) == S.HOT_PART).any()
    got, want = results([(i, t.encode()) for i, t in rows], S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect())
    assert got == want


def test_hot_anchors_deal_no_text(spark):
    """Chunks are dealt to the answers of their two messages, and not once more for the hot anchors of a few."""
    rng = np.random.default_rng(10)
    letters = np.arange(33, 127, dtype=np.uint8)
    text = lambda n: rng.choice(letters, n).tobytes().decode()
    cold = [(1000 + i, text(20_000)) for i in range(200)]
    passage, endings = text(90), [text(40) for _ in range(100)]
    hot = [(i, text(30) + passage + endings[i % 100]) for i in range(300)]
    scala = spark.sparkContext._jsc.sc()

    def written():
        """Bytes that each stage wrote for a shuffle."""
        scala.listenerBus().waitUntilEmpty(30_000)
        stages = scala.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        out = S.remove_repeats(spark.createDataFrame(cold + hot, "doc_id long, text string")).collect()
        sizes = [n for k, n in written().items() if k not in before]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    got, want = results([(i, t.encode()) for i, t in hot], [r for r in out if r["doc_id"] < 1000])
    assert got == want and sum(r["n_removed"] for r in out if r["doc_id"] >= 1000) == 0
    # random letters keep over 0.8 of their bytes; the messages on anchors have less than half
    assert len([n for n in sizes if n > 0.7 * 200 * 20_000]) == 2


def test_memory_of_a_long_document():
    """One document of 20 MB: what a worker holds stays within a few chunks."""
    import tracemalloc

    rng = np.random.default_rng(9)
    text = rng.integers(97, 123, 20 << 20, dtype=np.uint8)
    tracemalloc.start()
    for a in range(0, len(text), S.CHUNK_BYTES):
        part = text[max(0, a - 54) : a + S.CHUNK_BYTES + 54]
        import zstandard

        found = S.Regions([1], np.array([0, len(part)], np.int64).tobytes(), zstandard.ZstdCompressor().compress(part.tobytes()), LENGTH, 24)
        sum(len(m) for _, m in found.messages())
        if a >= 2 * S.CHUNK_BYTES:
            break
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()
