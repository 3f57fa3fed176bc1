"""Importance resampling against a plain count of the same n-grams."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tributary.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most=2):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)], len(words)


def expected(docs, target, percent=25, least=20, buckets=10000, most=2):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(of, features(text, most)[0]))
    for text in target:
        t.update(map(of, features(text, most)[0]))
    n, m = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        found, words = features(text, most)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in map(of, found))
        weight = total // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


def invented(seed, n=150):
    rng = random.Random(seed)
    words = ["Über", "naïve", "ROW", "a", "b1", "2", "Zahl", "日本", "x" * 30, "el", "Éa", "end"]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ", ", "-", " ", "_"]) for _ in range(k))
    docs = [(i, text(rng.choice([0, 1, 5, 19, 20, 21, 60]))) for i in range(n)]
    docs += [(None, text(30)), (None, None), (n, ""), (n + 1, "..."), docs[3], docs[3], (n + 2, text(4000)), (-4, "w" * 9000)]
    return docs, [text(12) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("seed", [1, 2])
def test_resampled(spark, seed):
    docs, target = invented(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, weight string").repartition(3)
    got = importance.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs, target)


@pytest.mark.parametrize("size", [7, 64, 500])
@pytest.mark.parametrize("most", [1, 2, 3])
def test_slices(monkeypatch, size, most):
    """Slices of any size give the same features, also when the tables start anew; each tuple is hashed once while they last."""
    docs, _ = invented(size, 40)
    raw = [(t or "").encode() for _, t in docs]
    at = [0]
    for x in raw:
        at.append(at[-1] + len(x))
    for table in (importance.TABLE, 5):
        monkeypatch.setattr(importance, "SLICE", size)
        monkeypatch.setattr(importance, "TABLE", table)
        f = importance.Features(most, 10000)
        found, words = Counter(), Counter()
        for of, sizes, who, buckets in f.slices(b"".join(raw), at):
            words.update(dict(zip(of.tolist(), sizes.tolist(), strict=True)))
            found.update(zip(who.tolist(), buckets.tolist(), strict=True))
        want = Counter((i, zlib.crc32(x.encode()) % 10000) for i, (_, t) in enumerate(docs) for x in features(t, most)[0])
        assert found == want
        assert all(words[i] == features(t)[1] for i, (_, t) in enumerate(docs))


def test_each_tuple_is_hashed_once():
    docs, _ = invented(3, 40)
    raw = [(t or "").encode() for _, t in docs]
    at = [sum(map(len, raw[:i])) for i in range(len(raw) + 1)]
    f = importance.Features(2, 10000)
    assert len(list(f.slices(b"".join(raw), at))) == 1
    assert f.hashed == len({x for _, t in docs for x in features(t)[0]})


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resampled(none, none).collect() == []
    one = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert [r["rank"] for r in importance.resampled(one, none, percent=100).collect()] == [1]
