"""Length alone makes no document toxic."""

import random

import numpy as np
from test_classifiers import sentence

from tributary.llm import learning, toxicity


def test_length():
    rng, texts, labels = random.Random(8), [], []
    for _ in range(400):
        bad = rng.random() < 0.3
        parts = [sentence(rng) for _ in range(rng.randint(1, 9))]
        if bad:
            parts[rng.randrange(len(parts))] = sentence(rng, rng.choice(["vile", "nasty"]))
        texts.append(" ".join(parts))
        labels.append(int(bad))
    w = np.frombuffer(toxicity.train(texts, np.array(labels, np.float64)), np.float32)
    lengths = (1, 1000, 5000, 20_000, 50_000)
    some = [sentence(rng) for _ in range(500)]
    clean = [" ".join(some[i % 500] for i in range(n)) for n in lengths]
    bad = [t + " " + sentence(rng, "vile") for t in clean]
    data, at = learning.joined([*clean, *bad])
    slot, owner, _, _, document = toxicity.sentences(data, at)
    slot, owner = toxicity._distinct(slot, owner)
    assert np.bincount(document).tolist() == [*lengths, *[n + 1 for n in lengths]]
    score = learning.sigmoid(w[-2] * toxicity._logit(toxicity._clean(w, slot, owner, document, 10)[1]) + w[-1])
    assert (score[:5] < 0.7).all() and np.ptp(score[:5]) < 1e-6
    assert (score[5:] >= 0.7).all() and np.ptp(score[5:]) < 1e-6
