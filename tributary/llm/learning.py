"""What the two classifiers share: bounded labelled samples, lower-cased words, and training in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_hash


def fold(id_col: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(parts)), F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, most: dict[int, int], id_col: str, text_col: str, label_col: str, allowed) -> DataFrame:
    """(label int, body) of at most ``most[label]`` documents of each label, those with the least hash of the id; ``allowed`` is a condition on the id.

    The ids chosen are bounded by ``most``, hence broadcast; null labels are ignored, of several labels of one id the largest counts.
    """
    rows = labels.where(allowed & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    order = [F.xxhash64("__id"), F.col("__id")]
    chosen = None
    for label, n in most.items():
        part = rows.where(F.col("label") == label).orderBy(*order).limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("body")).join(F.broadcast(chosen), "__id")
    return found.select("__id", "label", F.coalesce("body", F.lit("")).alias("body"))


def fit_in_task(rows: DataFrame, fit: Callable[[list[str], np.ndarray], bytes]) -> bytes:
    """``fit(texts, labels)`` in one task on the (bounded) sample, in the order of the ids; the model as bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, labels, texts = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            texts += batch.column(2).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], labels[i], texts[i]))
        model = fit([texts[i] for i in order], np.array([labels[i] for i in order], np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    return bytes(found[0]) if found else fit([], np.empty(0))


def lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capital letters of Latin-1 in lower case."""
    out = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``; runs end with their document."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[:-1][np.diff(at) > 0]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return byte_hash(data, start, end)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Adam:
    def __init__(self, parameters: dict[str, np.ndarray], rate: float):
        self.of, self.rate, self.t = parameters, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.v = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, gradient: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in gradient.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.of[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
