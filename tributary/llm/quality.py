"""Quality by attention-based multiple-instance learning.

Every passage of a text is encoded: rates of character classes, statistics of its words, and rates of hashed character pairs, through a
learned layer. Gated attention, learned from the documents' labels, weighs the passages, and the weighted representation is scored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, slices, utf8
from .learning import Adam, fit_in_task, fold, hashes, joined, lower, runs, sample, sigmoid

#: Words of a passage.
PASSAGE = 48
PAIRS_LOG2 = 5
HIDDEN, GATE = 24, 12
#: Labelled documents that training uses at most, by label.
MOST = {1: 6000, 0: 6000}
#: Bytes of a document that may teach (longer ones are scored, but don't teach), so that the one training task is bounded; and the weight decay.
TAUGHT_BYTES, DECAY = 1 << 18, 1e-4
EPOCHS, BATCH = 40, 256

_CLASSES = np.zeros(256, np.uint8)
for _k, _group in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".", b",", b"!?", b"|", b"$%&#*", b"<>{}[]()", b"@/\\:;=_-+~^", b"'\"`"), 1):
    _CLASSES[list(_group)] = _k
_CLASSES[128:] = 14
N_CLASSES = 15


def passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features float32, document) of all passages; a text without words is one empty passage."""
    docs, n = len(at) - 1, len(data)
    start, end = runs(~SPACE[data], at)
    owner = np.searchsorted(at, start, "right") - 1
    first = np.searchsorted(start, at)
    count = np.diff(first)
    within = np.arange(len(start)) - first[owner]
    parts = np.maximum(1, -(-count // PASSAGE))
    base = np.cumsum(parts) - parts
    total = int(parts.sum())
    passage = base[owner] + within // PASSAGE  # of each word
    document = np.repeat(np.arange(docs), parts)
    # a byte belongs to the passage of the last word that began
    of_byte = np.repeat(base, np.diff(at)) if n else np.empty(0, np.int64)
    if len(start):
        at_byte = np.zeros(n, np.int64)
        at_byte[start] = 1
        seen = np.cumsum(at_byte)
        has = seen > first[:-1].repeat(np.diff(at))
        of_byte[has] = passage[seen[has] - 1]
    classes = np.bincount(of_byte * N_CLASSES + _CLASSES[data], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    size = classes.sum(1, keepdims=True)
    text = lower(data)
    pair = np.zeros(n, np.int64)
    if n > 1:
        pair[:-1] = (((text[:-1].astype(np.uint32) << np.uint32(8)) | text[1:]) * np.uint32(2654435761)) >> np.uint32(32 - PAIRS_LOG2)
        pair[at[1:][np.diff(at) > 0] - 1] = 0  # a text's last byte has no pair in the next text
    pairs = np.bincount((of_byte << PAIRS_LOG2) + pair, minlength=total << PAIRS_LOG2).reshape(total, 1 << PAIRS_LOG2)
    words = np.bincount(passage, minlength=total)
    some = np.maximum(1, words)
    length = (end - start).astype(np.float64)
    mean = lambda x: np.bincount(passage, x, total) / some
    h = hashes(text, start, end)
    again = np.zeros(len(start), bool)
    if len(start):
        again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        mixed = h ^ (passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        here = np.zeros(len(start), bool)
        here[np.unique(mixed, return_index=True)[1]] = True
        mixed = h ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        new = np.zeros(len(start), bool)
        new[np.unique(mixed, return_index=True)[1]] = True
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        letters = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128))])
        shout = (upper[end] - upper[start] >= 2) & (upper[end] - upper[start] >= 0.6 * (letters[end] - letters[start]))
        odd = (end - start) - (letters[end] - letters[start])
    else:
        here = new = shout = np.zeros(0, bool)
        odd = np.zeros(0)
    features = [classes / np.maximum(1, size), pairs / np.maximum(1, size)]
    features += [x[:, None] for x in (np.log1p(words), mean(length), np.sqrt(mean(length**2)), mean(again), mean(here), mean(new), mean(shout), mean(odd >= 2), mean(odd), mean(length <= 3), words == 0)]
    return np.concatenate(features, 1).astype(np.float32), document


def _forward(m: dict[str, np.ndarray], x: np.ndarray, document: np.ndarray, docs: int):
    hidden = np.tanh(x @ m["W"] + m["b"])
    tanh, gate = np.tanh(hidden @ m["V"]), sigmoid(hidden @ m["U"])
    s = np.clip((tanh * gate) @ m["w"], -30, 30)
    e = np.exp(s)
    a = e / np.bincount(document, e, docs)[document]
    z = np.zeros((docs, hidden.shape[1]))
    np.add.at(z, document, a[:, None] * hidden)
    return hidden, tanh, gate, a, z, sigmoid(z @ m["c"] + m["d"][0])


def gradients(m: dict[str, np.ndarray], x: np.ndarray, doc: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean weighted log loss (with the weight decay of W and c), by parameter, for passages ``x`` of documents 0, 1, ... with ``labels``."""
    n = len(labels)
    hidden, tanh, gate, a, z, p = _forward(m, x, doc, n)
    d_logit = (p - labels) * weight / n
    dz = d_logit[:, None] * m["c"]
    da = (dz[doc] * hidden).sum(1)
    dh = a[:, None] * dz[doc]
    ds = a * (da - np.bincount(doc, a * da, n)[doc])
    dtg = ds[:, None] * m["w"]
    dt, dg = dtg * gate * (1 - tanh**2), dtg * tanh * gate * (1 - gate)
    dh += dt @ m["V"].T + dg @ m["U"].T
    pre = dh * (1 - hidden**2)
    return {"W": x.T @ pre + DECAY * m["W"], "b": pre.sum(0), "V": hidden.T @ dt, "U": hidden.T @ dg, "w": (tanh * gate).T @ ds, "c": z.T @ d_logit + DECAY * m["c"], "d": np.array([d_logit.sum()])}


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> bytes:
    """The model as an .npz, by Adam on the log loss, each label with half the weight."""
    rng = np.random.default_rng(seed)
    parts, owners, k = [], [], 0
    data, at = joined(texts)
    for i, j in slices(at):
        x, document = passages(data[at[i] : at[j]], at[i : j + 1] - at[i])
        parts.append(x)
        owners.append(document + k)
        k += j - i
    x = np.concatenate(parts) if parts else np.zeros((1, N_CLASSES + (1 << PAIRS_LOG2) + 11), np.float32)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    mean, spread_ = x.mean(0), x.std(0) + 1e-3
    f = x.shape[1]
    m = {"W": rng.normal(0, f**-0.5, (f, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1)}
    adam = Adam(m, 0.004)
    edge = np.searchsorted(owner, np.arange(k + 1))
    balance = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * max(1, len(labels))
    x = ((x - mean) / spread_).astype(np.float32)
    for _ in range(epochs if k and 0 < labels.sum() < k else 0):
        order = rng.permutation(k)
        for a0 in range(0, k, BATCH):
            pick = order[a0 : a0 + BATCH]
            rows = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in pick])
            doc = np.repeat(np.arange(len(pick)), edge[pick + 1] - edge[pick])
            xb = np.clip(x[rows].astype(np.float64), -8, 8)
            adam.step(gradients(m, xb, doc, labels[pick], balance[pick]))
    out = io.BytesIO()
    np.savez(out, mean=mean, spread=spread_, **m)
    return out.getvalue()


def fit(docs: DataFrame, labels: DataFrame, allowed, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> bytes:
    """A model from at most MOST labelled documents of at most TAUGHT_BYTES each; ``allowed`` is a condition on the ids that may teach. Without labels of both kinds scores say nothing."""
    docs = docs.where(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) <= TAUGHT_BYTES)
    return fit_in_task(sample(docs, labels, MOST, id_col, text_col, label_col, allowed), train)


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1), n_passages, and the passage of most attention: its number from 0, and its weight.

    A null or empty text is one empty passage; rows and other columns stay as they are, but columns named like the results are
    replaced; an empty table gives an empty result.
    """
    from pyspark.sql.types import DoubleType, LongType, StructType

    docs = docs.drop("score", "n_passages", "top_passage", "top_weight")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields]).add("score", DoubleType()).add("n_passages", LongType()).add("top_passage", LongType()).add("top_weight", DoubleType())
    place = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = dict(np.load(io.BytesIO(sent.value)))
        for batch in batches:
            data, at = utf8(batch.column(place).cast(pa.string()))
            for i, j in slices(at):
                x, document = passages(data[at[i] : at[j]], at[i : j + 1] - at[i])
                x = np.clip((x - m["mean"]) / m["spread"], -8, 8)
                *_, a, _, p = _forward(m, x, document, j - i)
                count = np.bincount(document, minlength=j - i)
                order = np.lexsort((-a, document))
                top = order[np.cumsum(count) - count]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(p), pa.array(count), pa.array(top - (np.cumsum(count) - count)), pa.array(a[top])], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """The fifth of the ids that never teaches."""
    return fold(id_col, 5) == 0


def rated(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with held_out, score, predicted (1 from ``threshold``), n_passages, top_passage, top_weight."""
    found = score(docs.drop("held_out", "predicted"), fit(docs, labels, ~held_out(id_col), id_col, text_col), id_col=id_col, text_col=text_col)
    return found.withColumn("held_out", held_out(id_col)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
