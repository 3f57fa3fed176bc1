"""Columns of the user's that are called like working columns come out as they went in."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from tributary.llm import line_dedup, packing

NAMES = ("__hash", "hash", "gone", "own", "row", "id", "doc", "mark", "number", "at", "component_id", "__in", "h", "n_shingles")


def documents(spark):
    line = "The same line stands in more than one of the documents here."
    rows = [(1, f"{line}\nfirst of its own, and long enough to count"), (2, f"{line}\nsecond of its own, and long enough to count"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("doc_id", "text", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


def unchanged(out, ids):
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == ids
    for r in rows:
        assert all(r[n] == f"{n} of {r['doc_id']}" for n in NAMES)
    return {r["doc_id"]: r for r in rows}


def test_line_dedup(spark):
    rows = unchanged(line_dedup.deduplicate_lines(documents(spark), short=True), [1, 2, 3])
    assert [rows[i]["n_removed"] for i in (1, 2, 3)] == [0, 1, 0]
    assert rows[2]["text"] == "second of its own, and long enough to count" and rows[3]["text"] is None


def test_ngram_stage(spark):
    docs = documents(spark)
    again = docs.where("doc_id = 1").withColumn("doc_id", F.lit(9).cast("long"))
    for n in NAMES:
        again = again.withColumn(n, F.lit(f"{n} of 9"))
    unchanged(P.ngram_join_stage(spark, docs.unionByName(again), ""), [1, 2, 3])


def test_packing_is_no_worse_than_best_fit(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    sizes = np.concatenate([rng.integers(1, 2048, 300), rng.integers(680, 690, 60), np.full(5, 2048)])
    bins = []
    packing.best_fit(sizes.tolist(), np.argsort(-sizes, kind="stable").tolist(), bins, [], 2048)
    out = packing.pack(spark.createDataFrame([(int(s),) for s in sizes], "length int"))
    assert out.select("sequence_id").distinct().count() <= len(bins)
    assert packing.evolve(sizes.tolist(), 2048, 1, [], generations=0, population=1) == bins
