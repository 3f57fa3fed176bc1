"""Exact repeats of lines too short for the edit join, in the operator, op3 and the pipeline's stage."""

import hashlib

import pytest
from test_line_dedup import brute, corpus

from tributary.llm import line_dedup


def whole(rows, left, least):
    """``left`` (id, text, n_lines, n_removed: what goes of the lines of ``least`` characters and more) less every shorter line that is not blank and equal to an earlier one."""
    seen, out = set(), []
    left = {str(d): (t, gone) for d, t, _, gone in left}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        text, gone = left[str(d)]
        keep = []
        for x in [] if text is None else text.split("\n"):
            if len(x) < least and x.strip():
                if x in seen:
                    continue
                seen.add(x)
            keep.append(x)
        gone += 0 if text is None else len(text.split("\n")) - len(keep)
        out.append((str(d), None if text is None else "\n".join(keep), 0 if t is None else len(t.split("\n")), gone))
    return sorted(out, key=str)


def test_against_all_lines(spark):
    for seed, edits, least in ((1, 2, 24), (2, 1, 15)):
        rows = [*corpus(seed), (200, "ok\n \nAll rights reserved.\n\t\r\n　"), (201, "All rights reserved.\n \n\t\r\nok\nAll rights reserved.\n　\nend")]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        out = line_dedup.deduplicate_lines(df, edits, least, short=True).collect()
        got = sorted(((str(r["doc_id"]), r["text"], r["n_lines"], r["n_removed"]) for r in out), key=str)
        assert got == whole(rows, brute(rows, edits, least), least)
        assert next(t for d, t, *_ in got if d == "201") == " \n\t\r\n　\nend"


@pytest.fixture(scope="module")
def table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.deduplicate_lines(docs).collect()]
    return sf_dir, docs, whole([(r["doc_id"], r["text"]) for r in docs.collect()], left, line_dedup.MIN_CHARS)


def test_query(spark, table):
    from tributary.llm.queries import op3_line_dedup

    sf_dir, _, want = table
    got = sorted(((str(r["doc_id"]), r["text_sha256"], r["n_lines"], r["n_removed"]) for r in op3_line_dedup(spark, sf_dir).collect()), key=str)
    assert got == sorted(((d, hashlib.sha256(t.encode()).hexdigest(), n, gone) for d, t, n, gone in want), key=str)


def test_stage(spark, table):
    import corpus_pipeline as P

    sf_dir, docs, want = table
    got = {str(r["doc_id"]): r["text"] for r in P.line_dedup_stage(spark, docs, sf_dir).collect()}
    assert got == {d: t for d, t, _, gone in want if not gone or t.strip()}
