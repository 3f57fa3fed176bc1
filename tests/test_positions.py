"""Places in a total order, dealt over ranges."""

from pyspark.sql import functions as F

from tributary.operators import positions


def test_numbered(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), F.xxhash64("id").alias("x"), F.lit("v").alias("v"))
    got = positions.numbered(rows, [F.desc("k"), F.asc("x")], "place").collect()
    want = sorted(rows.collect(), key=lambda r: (-r["k"], r["x"]))
    assert [(r["k"], r["x"]) for r in sorted(got, key=lambda r: r["place"])] == [(r["k"], r["x"]) for r in want]
    assert sorted(r["place"] for r in got) == list(range(1, 5001))
    assert got[0].asDict().keys() == {"k", "x", "v", "place"}
    assert positions.numbered(rows.limit(0), [F.asc("x")]).collect() == []
