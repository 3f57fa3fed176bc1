"""Both classifiers: held-out accuracy on invented texts, and odd inputs."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tributary.llm import learning, quality, toxicity

WORDS = [f"{a}{b}{c}" for a in ("lo", "mi", "ra") for b in ("ne", "tu", "so", "pa") for c in ("", "m", "ri", "ks")]


def sentence(rng, extra=None):
    w = [rng.choice(WORDS) for _ in range(rng.randint(4, 12))]
    if extra:
        w.insert(rng.randrange(len(w)), extra)
    return " ".join(w).capitalize() + "."


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        parts = [sentence(rng) for _ in range(rng.randint(1, 9))]
        if bad:
            parts[rng.randrange(len(parts))] = sentence(rng, rng.choice(["vile", "Grotty", "nasty"]))
        rows.append((i, " ".join(parts), "x"))
        labels.append((i, int(bad)))
    rows += [(700, None, None), (701, "", "x"), (None, rows[0][1], "x"), rows[1]]
    labels += [(700, None), (None, 1), labels[0], (9999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = toxicity.flagged(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(x for x in labels if x[0] is not None)
    assert len(out) == len(rows)
    seen = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert sum(a == b for a, b in seen) >= 0.97 * len(seen) and len(seen) > 150
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (700, 701):
            assert r["score"] == 0 and r["n_sentences"] == 0 and r["offending"] == []
        for x in r["offending"]:
            part = r["text"].encode()[x["begin"] : x["end"]].decode().lower()
            assert any(w in part for w in ("vile", "grotty", "nasty"))
    assert toxicity.flagged(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).collect() == []


def test_quality(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        good = rng.random() < 0.7
        parts = [sentence(rng) for _ in range(rng.randint(2, 12))]
        if not good:
            kind = rng.randrange(3)
            parts[rng.randrange(len(parts))] = " ".join(["BUY!!"] * 40) if kind == 0 else " | ".join(rng.choice(WORDS) for _ in range(60)) if kind == 1 else " ".join(f"{rng.choice(WORDS)}$$$" for _ in range(50))
        rows.append((i, "\n".join(parts)))
        labels.append((i, int(good)))
    rows += [(700, None), (701, ""), (702, " \n "), (None, rows[0][1]), (703, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality.rated(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    truth = dict(labels)
    seen = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(out) == len(rows) and sum(a == b for a, b in seen) >= 0.95 * len(seen)
    for r in out:
        assert 0 <= r["score"] <= 1 and r["n_passages"] >= 1 and 0 <= r["top_passage"] < r["n_passages"]
    assert quality.rated(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_attention_gradient():
    """Every parameter's gradient against central differences of the loss."""
    rng = np.random.default_rng(3)
    f, h, g = 6, quality.HIDDEN, quality.GATE
    m = {"W": rng.normal(0, 0.4, (f, h)), "b": rng.normal(0, 0.2, h), "V": rng.normal(0, 0.4, (h, g)), "U": rng.normal(0, 0.4, (h, g)), "w": rng.normal(0, 1.0, g), "c": rng.normal(0, 0.5, h), "d": np.array([0.1])}
    doc, y = np.array([0, 0, 0, 1, 2, 2, 3]), np.array([1.0, 0.0, 1.0, 0.0])
    x, weight = rng.standard_normal((len(doc), f)), np.array([0.5, 2.0, 1.0, 0.7])

    def loss():
        *_, p = quality._forward(m, x, doc, len(y))
        return float((weight * -(y * np.log(p) + (1 - y) * np.log(1 - p))).mean() + quality.DECAY / 2 * ((m["W"] ** 2).sum() + (m["c"] ** 2).sum()))

    found = quality.gradients(m, x, doc, y, weight)
    assert found.keys() == m.keys()
    for name, value in m.items():
        flat, slope = value.reshape(-1), found[name].reshape(-1)
        for k in rng.permutation(len(flat))[:12]:
            was = flat[k]
            flat[k] = was + 1e-5
            up = loss()
            flat[k] = was - 1e-5
            down = loss()
            flat[k] = was
            assert abs((up - down) / 2e-5 - slope[k]) < 1e-7, name


def test_attention_learns():
    texts = ["a b c", "A!! B!! C!! D!!"] * 30
    y = np.array([1.0, 0.0] * 30)
    model = dict(np.load(__import__("io").BytesIO(quality.train(texts, y, epochs=30))))
    x, document = quality.passages(*learning.joined(texts))
    *_, p = quality._forward(model, np.clip((x - model["mean"]) / model["spread"], -8, 8), document, len(texts))
    assert (p[y == 1] > 0.9).all() and (p[y == 0] < 0.1).all()


def test_fold(spark):
    rows = spark.range(50).select(F.col("id"), learning.fold("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_plain_noisy_or(spark):
    """Scores anew, sentence by sentence, from the weights: words and their beginnings once a sentence, one bias a document."""
    import math
    import re

    rng = random.Random(6)
    texts = [" ".join(sentence(rng, rng.choice([None, "vile"])) for _ in range(rng.randint(1, 6))) for _ in range(200)]
    y = np.array([float("vile" in t) for t in texts])
    w = np.frombuffer(toxicity.train(texts, y), np.float32)
    docs = spark.createDataFrame(list(enumerate(texts[:40])), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, w.tobytes()).collect()}
    logistic = lambda v: 1 / (1 + math.exp(-v))
    bias = float(w[1 << toxicity.SLOTS_LOG2])
    for d, t in enumerate(texts[:40]):
        clean = math.log1p(-logistic(bias))
        for part in re.findall(r"[^.!?\n]+", t):
            found = re.findall(r"[a-z]+", part.lower())
            slots = {int(s) for x in found for s in toxicity.sentences(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))[0]}
            if found:
                clean += math.log1p(-logistic(sum(float(w[s]) for s in slots) + bias)) - math.log1p(-logistic(bias))
        odds = math.log(max(-math.expm1(clean), 1e-9)) - clean
        assert abs(got[d] - logistic(float(w[-2]) * odds + float(w[-1]))) < 1e-4


def test_plain_attention(spark):
    """Scores anew, document by document, from the passages and the model's numbers."""
    import io

    rng = random.Random(7)
    texts = [" ".join(sentence(rng) for _ in range(rng.randint(1, 30))) for _ in range(30)] + ["BUY!! " * 60] * 30
    model = quality.train(texts, np.array([1.0] * 30 + [0.0] * 30), epochs=5)
    m = dict(np.load(io.BytesIO(model)))
    got = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for d, t in enumerate(texts):
        x, _ = quality.passages(*learning.joined([t]))
        hidden = np.tanh(np.clip((x - m["mean"]) / m["spread"], -8, 8) @ m["W"] + m["b"])
        s = (np.tanh(hidden @ m["V"]) / (1 + np.exp(-(hidden @ m["U"])))) @ m["w"]
        a = np.exp(s) / np.exp(s).sum()
        p = 1 / (1 + np.exp(-((a @ hidden) @ m["c"] + m["d"][0])))
        assert abs(got[d]["score"] - p) < 1e-6 and got[d]["n_passages"] == len(x) and abs(got[d]["top_weight"] - a.max()) < 1e-6
