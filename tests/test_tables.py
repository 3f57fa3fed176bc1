"""The bucketed table, its stream, upserts by period and cascades."""

import pytest
from pyspark.sql import functions as F

from tributary.operators import cascades, merges
from tributary.streaming import buckets, programs

SCHEMA = "k long, text string, at long"


def upsert(old, new):
    return merges.upsert_items(old, new, ["k"], ["text"], "at")


def files(spark, table):
    fs, path = table._fs(f"{table.root}/data/version=*/__bucket=*")
    return sorted(tuple(int(p.getName().split("=")[1]) for p in (x.getPath().getParent(), x.getPath())) for x in fs.globStatus(path) or [])


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = buckets.BucketTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, ["k"], buckets=16)
    assert t.read().collect() == [] and t.versions() == []
    whole = t.merge(spark.range(1000).selectExpr("id AS k", "'a' AS text", "1L AS at"), 0, upsert)
    assert whole == list(range(16)) and t.versions() == [0]
    few = spark.createDataFrame([(5, "b", 2), (6, "a", 2), (2000, "c", 2)], SCHEMA)
    touched = t.merge(few, 1, upsert)
    assert 1 <= len(touched) <= 3
    held = t.manifest()
    assert {b for b, (v, _) in held.items() if v == 1} == set(touched) and sum(n for _, n in held.values()) == 1001
    got = {r["k"]: (r["text"], r["at"]) for r in t.read().collect()}
    assert len(got) == 1001 and got[5] == ("b", 2) and got[6] == ("a", 1) and got[2000] == ("c", 2) and got[7] == ("a", 1)
    assert {r["k"]: r["text"] for r in t.read(0).collect()}[5] == "a"  # the version before is still whole
    before = files(spark, t)
    assert t.merge(few.withColumn("text", F.lit("z")), 1, upsert) == [] and t.merge(few, 0, upsert) == []
    assert files(spark, t) == before and {r["k"]: r["text"] for r in t.read().collect()}[5] == "b"


def test_versions_expire_and_broken_merges_are_overwritten(spark, tmp_path):
    t = buckets.BucketTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, ["k"], buckets=4)
    t.merge(spark.range(40).selectExpr("id AS k", "'a' AS text", "1L AS at"), 0, upsert)
    for n in (1, 2, 3):
        t.merge(spark.createDataFrame([(1, f"v{n}", n)], SCHEMA), n, upsert)
    assert t.versions() == [2, 3]
    bucket = [b for b, (v, _) in t.manifest().items() if v == 3][0]
    assert sorted(v for v, b in files(spark, t) if b == bucket) == [2, 3]  # what versions 2 and 3 name, no more
    # data without a manifest is a merge that broke off
    spark.createDataFrame([(9, "torn", 9)], SCHEMA).withColumn("__bucket", F.lit(0)).write.partitionBy("__bucket").parquet(f"{t.root}/data/version=4")
    assert {r["k"]: r["text"] for r in t.read().collect()}[9] == "a"
    t.merge(spark.createDataFrame([(9, "whole", 4)], SCHEMA), 4, upsert)
    assert {r["k"]: r["text"] for r in t.read().collect()}[9] == "whole" and t.read().count() == 40
    # a transition may empty a bucket, and a batch may be empty
    t.merge(spark.createDataFrame([(k, "", 5) for k in range(40)], SCHEMA), 5, lambda old, new: old.join(new, "k", "left_anti"))
    assert t.read().collect() == []
    assert t.merge(spark.createDataFrame([], SCHEMA), 6, upsert) == [] and t.versions()[-1] == 6


def test_stream_replay(spark, tmp_path):
    src, root = str(tmp_path / "in"), f"file://{tmp_path}/out"
    run = lambda: programs.upsert_stream(programs.read(spark, src, spark.createDataFrame([], SCHEMA).schema), root, ["k"], ["text"], "at", [F.desc("at")])
    spark.createDataFrame([(1, "a", 10), (2, "b", 10)], SCHEMA).coalesce(1).write.parquet(src)
    run()
    spark.createDataFrame([(1, "a", 20), (2, "c", 20), (3, "d", 20)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    want = [(1, "a", 10), (2, "c", 20), (3, "d", 20)]
    t = run()
    assert sorted(map(tuple, t.read().collect())) == want and len(t.versions()) == 2
    assert sorted(map(tuple, run().read().collect())) == want and len(t.versions()) == 2


def test_cascades(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "user": make([(1, 0), (2, 1)], "id long, bad int"),
        "digest": make([(10, 1), (11, 2), (12, None)], "id long, user long"),
        "run": make([(20, 10, 1), (21, 11, 2), (22, 11, 1), (23, 99, None)], "id long, digest long, user long"),
        "note": make([(1, None, 20), (2, 1, 21), (3, 2, None), (4, 3, 20), (5, None, None)], "id long, reply long, run long"),
    }
    K = cascades.ForeignKey
    keys = (K("digest", "user", "user", "id"), K("run", "digest", "digest", "id", "set_null"), K("run", "user", "user", "id"), K("note", "run", "run", "id"), K("note", "reply", "note", "id"))
    left = cascades.deleted(tables, keys, {"user": F.col("bad") == 1})
    got = {n: sorted((tuple(r) for r in df.collect()), key=str) for n, df in left.items()}
    assert got["user"] == [(1, 0)] and got["digest"] == [(10, 1), (12, None)]
    # a run of the deleted user goes; another loses its digest; a reference to nothing stays
    assert got["run"] == [(20, 10, 1), (22, None, 1), (23, 99, None)]
    # note 2 goes with its run, then the replies to it, one after another
    assert got["note"] == [(1, None, 20), (5, None, None)]
    with pytest.raises(ValueError, match="circle"):
        cascades.levels(["a", "b"], (K("a", "x", "b", "id"), K("b", "y", "a", "id")))
    with pytest.raises(ValueError, match="no action"):
        K("a", "x", "b", "id", "restrict")


def test_upsert_periods(spark):
    schema = "u long, p string, id string, status string, at long"
    none = spark.createDataFrame([], "u long, p string, id string, status string, created_at long, updated_at long")
    a = merges.upsert_periods(none, spark.createDataFrame([(1, "x", "a", "running", 5), (1, "x", "b", "failed", 7)], schema), ["u", "p"], "id", "status", "at")
    assert [tuple(r) for r in a.collect()] == [(1, "x", "a", "failed", 5, 7)]
    b = merges.upsert_periods(a, spark.createDataFrame([(1, "x", "c", "completed", 9), (2, "x", "d", "running", 9)], schema), ["u", "p"], "id", "status", "at")
    assert sorted(tuple(r) for r in b.collect()) == [(1, "x", "a", "completed", 5, 9), (2, "x", "d", "running", 9, 9)]
