"""The n-gram stage keeps one row of each group, whatever the ids."""

import corpus_pipeline as P


def test_null_and_repeated_ids(spark):
    text = [" ".join(f"{w}{i}" for i in range(60)) for w in "abcdef"]
    near = text[0] + " end"
    rows = [
        (1, text[0]), (2, near), (2, text[1]),  # the other row of id 2 has no link
        (3, text[2]), (3, text[2]), (3, text[2]),
        (None, text[3]), (None, text[3]), (None, text[3] + " end"),
        (None, text[4]), (9, text[4]),
        (4, text[5]), (4, text[5] + " end"),
        (5, ""), (5, ""), (6, None), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = [tuple(r) for r in P.ngram_join_stage(spark, docs, "").collect()]
    sure = [(1, text[0]), (2, text[1]), (3, text[2]), (9, text[4]), (5, ""), (5, ""), (6, None), (None, None)]
    rest = [r for r in out if r not in sure]
    assert sorted((r for r in out if r in sure), key=str) == sorted(sure, key=str)
    assert sorted(r[0] is None for r in rest) == [False, True]
    assert all(r in rows and r[1][:2] == ("d0" if r[0] is None else "f0") for r in rest)


def test_rows_whose_numbers_collide_stay(spark, monkeypatch):
    """Were the 64 bits of all rows equal, none would be lost; of equal rows one stays as ever where the bits are a row's own."""
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in "abc"]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[0] + " end"), (3, texts[1]), (None, texts[2])], "doc_id long, text string")
    from pyspark.sql import functions as F

    monkeypatch.setattr(P, "_number", lambda mark: F.lit(7).cast("long"))
    assert sorted(r["doc_id"] or 0 for r in P.ngram_join_stage(spark, docs, "").collect()) == [0, 1, 2, 3]
