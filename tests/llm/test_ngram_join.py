"""N-gram Jaccard join against all pairs."""

import random
import re

import numpy as np

from tributary.llm import ngram_join


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((str(d), len(sets[i]), str(min(ids)) if ids else "None"))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, bases = [], []
    for _ in range(12):
        bases.append([rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))])
    for i in range(140):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i * 3 % 140, rng.choice([" ", "\t", "\n "]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return [*rows, (900, None), (901, ""), (902, " \n "), (None, rows[0][1]), rows[1], (903, "é É"), (904, "é é")]


def test_against_all_pairs(spark):
    for seed, n, percent in ((1, 4, 85), (2, 5, 80), (3, 2, 60)):
        rows = corpus(seed)
        df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(3)
        out = ngram_join.ngram_components(df, n, percent).collect()
        assert sorted((str(a), b, str(c)) for a, b, c in out) == brute(rows, n, percent)
    assert ngram_join.ngram_components(df.limit(0)).collect() == []


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += "".join("b" if c == "a" else "a" for c in x)
    return x


def test_texts_that_polynomials_confuse(spark):
    rows = []
    for k, n in enumerate((1024, 2048, 4096)):
        word = thue_morse(n)
        rows += [(10 * k, word), (10 * k + 1, word.translate(str.maketrans("ab", "ba")))]
    out = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert all(r["component_id"] == r["doc_id"] and r["n_shingles"] == 1 for r in out)


def test_hot_ngrams_in_portions(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HELD_BYTES", 1)
    monkeypatch.setattr(ngram_join, "HOT", 3)
    rows = corpus(4)
    out = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 85).collect()
    assert sorted((str(a), b, str(c)) for a, b, c in out) == brute(rows, 4, 85)


def test_long_text(spark):
    words = [f"w{i}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1000])), (3, "x" * 1_000_000), (4, " ".join(reversed(words)))]
    out = {r["doc_id"]: r for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert out[1]["n_shingles"] == 199_996 and [out[d]["component_id"] for d in (1, 2, 3, 4)] == [1, 1, 3, 4]


def test_suffix_bound():
    rng = np.random.default_rng(0)
    for _ in range(500):
        x, y = (np.unique(rng.integers(0, 200, int(rng.integers(0, 60))).astype(np.uint64)) for _ in range(2))
        apart = len(np.setxor1d(x, y))
        for most in (0, 5, 1000):
            assert ngram_join.suffix_bound(x, y, most) <= apart
        assert ngram_join.suffix_bound(x, x, 0) == 0
