"""Python in tasks holds a few rows of an Arrow batch as objects, not the whole batch."""

import tracemalloc

import pyarrow as pa

from tributary.functions import text, udfs


def _peak(udf, x):
    tracemalloc.start()
    try:
        got = udf.func(x)
        return got, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_labels_of_a_large_batch():
    rows = [[f"ﬁ{i % 7}{j}" for j in range(200)] + ["fi00", None] for i in range(5000)]
    got, peak = _peak(udfs.first_spellings, pa.array(rows))
    # 10^6 texts; all of them as objects are some 80 MB
    assert peak < 10
    assert got.to_pylist()[:8] == [r[: 200 if i % 7 == 0 else 201] for i, r in enumerate(rows[:8])]


def test_texts_of_a_large_batch():
    rows = [None if i % 100 == 7 else "Ａ" * 2000 for i in range(5000)]
    got, peak = _peak(udfs.nfkc, pa.array(rows))
    assert peak < 10
    assert got.to_pylist() == [t and "A" * 2000 for t in rows]


def test_labels_over_many_rows(spark):
    n = 3 * udfs.ROWS + 1
    df = spark.createDataFrame([(i, [" Film ", "film", None, "ＦＩＬＭ", f"x{i}"] if i % 5 else None) for i in range(n)], "i int, v array<string>").coalesce(1)
    got = {r[0]: r[1] for r in df.select("i", text.clean_labels("v")).collect()}
    assert got == {i: ["Film", f"x{i}"] if i % 5 else None for i in range(n)}


def test_waves_of_an_archive_double(spark, tmp_path, monkeypatch):
    import json

    from tributary.sources import archive

    for i in range(40):
        folder = tmp_path / f"page={i:02d}"
        folder.mkdir()
        post = {"id": i + 1, "type": "podcast", "title": "t", "date_ms": 1000 - i}
        (folder / "part-0.json").write_text(json.dumps([post]) if i < 32 else "no list")
    waves = []
    monkeypatch.setattr(archive, "settled", lambda df, name: waves.append(df.count()) or df)
    # pages from 32 on can't be read, but page 31 lies before the window
    found = archive.scan(spark, archive.names(spark, f"{tmp_path}/page=*/part-*"), from_ms=970, wave=2)
    assert waves == [2, 2, 4, 8, 16]
    assert sorted(r["post_id"] for r in found.collect()) == list(range(1, 32))


def test_rules_of_a_large_batch(spark, monkeypatch):
    from tributary.operators import joins

    sent = []
    texts = spark.createDataFrame([(1, "x")], "story_id long, value string")
    monkeypatch.setattr(type(texts), "mapInArrow", lambda df, run, schema: sent.append(run) or df)
    joins._by_automaton(texts, spark.createDataFrame([(f"r{i}", f"ab{i}") for i in range(10)], "rule_id string, needle string"))
    batch = pa.RecordBatch.from_pydict({"story_id": list(range(5000)), "value": ["ab1 ab2 ab3 " * 100] * 5000})
    pages = list(sent[0](iter([batch])))
    # matches leave with the few rows that they are of
    assert max(p.num_rows for p in pages) == 3 * udfs.ROWS
    assert sum(p.num_rows for p in pages) == 15000
