"""Toxicity by multiple-instance learning: sentences are scored, a document's score is their noisy-or.

Labels are of documents only. A sentence's score is the logistic function of the weights of its words and their beginnings (hashed), the document's
1 - product(1 - score), where of the sentences' common bias one share is left, however many they are; the weights are learned from the documents' labels and then tell which sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, mix, slices, utf8
from .learning import fit_in_task, fold, hashes, joined, lower, runs, sample, sigmoid

#: Weights, by the first bits of a word's hash.
SLOTS_LOG2 = 18
#: Beginnings of words, in bytes, that are features like whole words.
STEMS = (4, 6)
#: Labelled documents that training uses at most, by label.
MOST = {1: 4000, 0: 8000}
EPOCHS, STEP = 200, 0.5
EVIDENCE, LIFT = 0.5, 3.0
#: Logit of a sentence, and of a document, without telling words: such sentences add nothing, so that length alone never makes a document toxic.
BIAS = -7.0
#: Weight of label 0 against label 1 where scores are calibrated.
PRIOR = 1.0


def sentences(data: np.ndarray, at: np.ndarray):
    """Slots of all words, the sentence of each, sentences' first bytes and documents. A sentence ends with . ! ? or a line break."""
    text = lower(data)
    inside = (text >= 0x80) | ((text >= 97) & (text <= 122))
    start, end = runs(inside, at)
    stop = np.isin(data, np.frombuffer(b".!?\n", np.uint8))
    before = np.concatenate([[0], np.cumsum(stop)])
    document = np.searchsorted(at, start, "right") - 1
    new = np.ones(len(start), bool)
    if len(start):
        new[1:] = (before[start[1:]] != before[end[:-1]]) | (document[1:] != document[:-1])
    slot = (hashes(text, start, end) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)
    last = np.flatnonzero(np.concatenate([new[1:], [True]])) if len(start) else np.empty(0, np.int64)
    sentence = np.cumsum(new) - 1
    # the beginnings of longer words too: related words have them in common
    slots, owners = [slot], [sentence]
    for k in STEMS:
        long = np.flatnonzero(end - start > k)
        # the length is in the hash, so a beginning isn't the word of the same letters
        slots.append((mix(hashes(text, start[long], start[long] + k) ^ np.uint64(k)) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64))
        owners.append(sentence[long])
    return np.concatenate(slots), np.concatenate(owners), start[new], end[last], document[new]


def _distinct(slot: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word counts once in a sentence."""
    key = distinct((sentence << SLOTS_LOG2) | slot)
    return key & ((1 << SLOTS_LOG2) - 1), key >> SLOTS_LOG2


def _weights(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by slot (float32, the bias last), by proximal gradient steps on the log loss of the noisy-or with an L1 penalty."""
    data, at = joined(texts)
    # only words that speak for label 1 have weights: in two of its documents at least, and LIFT times as often as under label 0
    often, other = np.zeros(1 << SLOTS_LOG2, np.int64), np.zeros(1 << SLOTS_LOG2, np.int64)

    def parts():
        for i, j in slices(at):
            slot, sentence, _, _, document = sentences(data[at[i] : at[j]], at[i : j + 1] - at[i])
            yield (*_distinct(slot, sentence), document + i)

    for slot, sentence, document in parts():
        pair = distinct((document[sentence].astype(np.int64) << SLOTS_LOG2) | slot)
        word, positive = pair & ((1 << SLOTS_LOG2) - 1), labels[pair >> SLOTS_LOG2] > 0
        often += np.bincount(word[positive], minlength=1 << SLOTS_LOG2)
        other += np.bincount(word[~positive], minlength=1 << SLOTS_LOG2)
    telling = (often >= 2) & (often * max(1, (1 - labels).sum()) >= LIFT * other * max(1, labels.sum()))
    slots, owners, documents, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for slot, sentence, document in parts():
        keep = telling[slot]
        slots.append(slot[keep])
        owners.append(sentence[keep] + n)
        documents.append(document)
        n += len(document)
    slot, sentence, document = np.concatenate(slots), np.concatenate(owners), np.concatenate(documents)
    used, where = np.unique(slot, return_inverse=True)
    live, sentence_of = np.unique(sentence, return_inverse=True)
    docs, n, b = len(texts), len(live), BIAS
    # a document has the bias once, and of its sentences what they have beyond it
    alone = np.log1p(-sigmoid(np.array(b)))
    document, w = document[live], np.zeros(len(used))
    balance = np.full(docs, 1 / max(1, docs))
    # the penalty: the loss of EVIDENCE documents
    penalty = EVIDENCE / max(1, docs)
    for turn in range(epochs if docs and n and 0 < labels.sum() < docs else 0):
        p = sigmoid(np.bincount(sentence_of, w[where], n) + b)
        clean = alone + np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-12)) - alone, docs)
        some = np.maximum(-np.expm1(clean), 1e-12)
        # d loss / d logit of a sentence: its score, times 1 for label 0 and -(1 - P) / P for label 1
        g = (balance * np.where(labels > 0, -(1 - some) / some, 1.0))[document] * p
        if turn % 5 == 0:  # curvature bounds, for steps of each weight's own size
            bend = balance[document] * np.minimum(0.25, p * (1 - p) + 0.02)
            step = STEP / (np.bincount(where, bend[sentence_of], len(used)) + 1e-6)
        w -= step * np.bincount(where, g[sentence_of], len(used))
        w = np.maximum(w - step * penalty, 0)
    out = np.zeros((1 << SLOTS_LOG2) + 1, np.float32)
    out[used], out[-1] = w, b
    return out


def _clean(w: np.ndarray, slot: np.ndarray, sentence: np.ndarray, document: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Each sentence's score, and each document's log probability of having no offending sentence: the bias's once, and what its sentences have beyond it."""
    p = sigmoid(np.bincount(sentence, w[slot], len(document)) + w[1 << SLOTS_LOG2])
    alone = np.log1p(-sigmoid(np.float64(w[1 << SLOTS_LOG2])))
    return p, alone + np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-12)) - alone, docs)


def _logit(clean: np.ndarray) -> np.ndarray:
    """Log odds of the noisy-or."""
    return np.log(np.maximum(-np.expm1(clean), 1e-9)) - clean


def train(texts: list[str], labels: np.ndarray) -> bytes:
    """The weights, and after them the slope and shift that calibrate the noisy-or's log odds.

    Each half of the sample is scored by weights learned from the other, and the two numbers are fitted to these honest scores by
    logistic regression, label 0 with PRIOR times the weight of label 1; so the threshold means the same whatever the size of the sample.
    """
    w = _weights(texts, labels)
    x, y = [], []
    half = np.arange(len(texts)) % 2
    for k in (0, 1):
        learn, ask = np.flatnonzero(half != k), np.flatnonzero(half == k)
        other = _weights([texts[i] for i in learn], labels[learn])
        data, at = joined([texts[i] for i in ask])
        for i, j in slices(at):
            slot, sentence, _, _, document = sentences(data[at[i] : at[j]], at[i : j + 1] - at[i])
            x.append(_logit(_clean(other, *_distinct(slot, sentence), document, j - i)[1]))
        y.append(labels[ask])
    x, y = (np.concatenate(v) if v else np.empty(0) for v in (x, y))
    scale = np.array([1.0, 0.0])
    if len(y) and min(y.sum(), (1 - y).sum()) >= 10:
        weight = np.where(y > 0, 1 / y.sum(), PRIOR / (1 - y).sum())
        both = np.stack([x, np.ones(len(x))], 1)
        for _ in range(30):
            p = sigmoid(both @ scale)
            slope = both.T @ (weight * (p - y)) + 0.05 * (scale - [1.0, 0.0])
            bend = both.T @ (both * (weight * p * (1 - p))[:, None]) + 0.05 * np.eye(2)
            scale = scale - np.clip(np.linalg.solve(bend, slope), -0.5, 0.5)
        scale[0] = np.clip(scale[0], 0.3, 2.0)
    return np.concatenate([w, scale.astype(np.float32)]).tobytes()


def fit(docs: DataFrame, labels: DataFrame, allowed, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> bytes:
    """Weights from at most MOST labelled documents; ``allowed`` is a condition on the ids that may teach. Without labels of both kinds every score is near 0."""
    return fit_in_task(sample(docs, labels, MOST, id_col, text_col, label_col, allowed), train)


def score(docs: DataFrame, model: bytes, offending: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1), n_sentences and offending (array of the sentences whose own score is ``offending`` or more: begin, end in UTF-8 bytes, score).

    A null or empty text, and one without words, has no sentence and score 0; rows and other columns stay as they are, but
    columns named like the results are replaced; an empty table gives an empty result.
    """
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

    docs = docs.drop("score", "n_sentences", "offending")
    sent = docs.sparkSession.sparkContext.broadcast(np.frombuffer(model, np.float32))
    schema = StructType([*docs.schema.fields]).add("score", DoubleType()).add("n_sentences", LongType())
    schema = schema.add("offending", ArrayType(StructType().add("begin", LongType()).add("end", LongType()).add("score", DoubleType())))
    place = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        w = sent.value
        for batch in batches:
            data, at = utf8(batch.column(place).cast(pa.string()))
            for i, j in slices(at):
                here = at[i : j + 1] - at[i]
                slot, sentence, begin, end, document = sentences(data[at[i] : at[j]], here)
                slot, sentence = _distinct(slot, sentence)
                p, clean = _clean(w, slot, sentence, document, j - i)
                count = np.bincount(document, minlength=j - i)
                whole = np.where(count > 0, sigmoid(w[-2] * _logit(clean) + w[-1]), 0.0)
                bad = np.flatnonzero(p >= offending)
                lists = [[] for _ in range(j - i)]
                for k in bad.tolist():
                    d = int(document[k])
                    lists[d].append({"begin": int(begin[k] - here[d]), "end": int(end[k] - here[d]), "score": float(p[k])})
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(whole), pa.array(count), pa.array(lists, kind)], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """The third of the ids that never teaches."""
    return fold(id_col, 3) == 1


def flagged(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with held_out, score, predicted (1 from ``threshold``), n_sentences, offending."""
    found = score(docs.drop("held_out", "predicted"), fit(docs, labels, ~held_out(id_col), id_col, text_col), id_col=id_col, text_col=text_col)
    return found.withColumn("held_out", held_out(id_col)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
