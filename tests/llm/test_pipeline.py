"""The pipeline's stages on a small table: each against what its operator must do to its own input."""

import pytest


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as P
    from tributary.llm.common import materialize

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    for df in stages[1:5]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes
        for r in df.collect():
            assert r["n_chars"] == len(r["text"])


def test_toxicity(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    clean = [d for d in before if labels.get(d) == 0]
    assert all(after[d]["text"] == before[d]["text"] for d in after) and sum(d in after for d in clean) >= 0.98 * len(clean)


def test_lines(stages):
    from test_line_dedup import brute
    from test_short_lines import whole

    before, after = rows(stages[1]), rows(stages[2])
    texts = [(d, r["text"]) for d, r in before.items()]
    # the stage's whole job: near copies of long lines, and exact repeats of short ones
    want = {int(d): (t, gone) for d, t, _, gone in whole(texts, brute(texts, 2, 24), 24)}
    assert {d: r["text"] for d, r in after.items()} == {d: t for d, (t, gone) in want.items() if not gone or t.strip()}


def test_near_copies(stages):
    from test_ngram_join import brute

    before, after = rows(stages[2]), rows(stages[3])
    want = brute([(d, r["text"]) for d, r in before.items()], 5, 80)
    assert sorted(after) == sorted(int(d) for d, _, c in want if d == c)


def test_passages(stages):
    from test_suffix_dedup import brute

    before, after = stages[3].collect(), rows(stages[4])
    gone = brute([(r["doc_id"], r["text"].encode()) for r in before])
    for r, g in zip(before, gone, strict=True):
        at, kept = 0, ""
        for c in r["text"]:
            n = len(c.encode())
            kept += "" if g[at : at + n].any() else c
            at += n
        if not g.any() or kept.strip():
            assert after[r["doc_id"]]["text"] == kept
        else:
            assert r["doc_id"] not in after


def test_packed(stages):
    texts, packed = rows(stages[4]), stages[5].collect()
    assert {r["doc_id"] for r in packed} == set(texts)
    used = {}
    for r in packed:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 3


def odd_rows():
    """Null and repeated ids, null and empty texts, repeated rows, a character U+FFFD of the author's own."""
    words = [f"word{i}" for i in range(80)]
    long = " ".join(words)
    texts = [(1, long), (1, "other text of its own " + " ".join(reversed(words))), (2, long), (2, long), (None, long), (None, "alone"), (3, None), (4, ""), (5, "a \ufffd mark " + " ".join(words[:30])), (None, None)]
    return [(d, t, "en", "web", len(t or ""), "more") for d, t in texts]


def test_odd_rows(spark, tmp_path):
    import corpus_pipeline as P
    from tributary.llm.common import materialize

    schema = "doc_id long, text string, lang string, source string, n_chars long, label string"
    spark.createDataFrame([(9, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, left = spark.createDataFrame(odd_rows(), schema), []
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        left.append(docs.collect())
    assert [len(x) for x in left[:1]] == [len(odd_rows())]
    text = {r["doc_id"]: r["text"] for r in left[3]}
    assert "\ufffd" in text[5]  # the author's own mark stays
    assert sum(r["text"] == odd_rows()[0][1] for r in left[3]) == 1 and any(r["text"] == "alone" for r in left[3])
    empty = spark.createDataFrame([], schema)
    for name, stage in P.STAGES:
        empty = materialize(stage(spark, empty, str(tmp_path)), name)
        assert empty.count() == 0
