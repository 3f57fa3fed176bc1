"""The scan's five ends one by one, and digest pages with long lines and one large digest."""

from pyspark.sql import functions as F

from tributary.operators import folds
from tributary.plans import digest

LOG = "k string, round int, added int, stop boolean, moved boolean, edge boolean, at_edge boolean"


def test_scan_stops(spark):
    def log(key, *rounds):
        return [(key, i, *r) for i, r in enumerate(rounds)]

    go, idle, stuck = (1, False, True, False, None), (0, False, True, False, None), (0, None, False, False, None)
    rows = [
        *log("condition", go, (0, True, True, False, None), go),
        *log("items", go, go, go, go),
        *log("stalls", go, stuck, stuck),
        # moved windows without anything new, then a probe that can't move
        *log("proof", go, idle, stuck),
        *log("pinned", go, idle, idle, go),
        *log("late end", go, idle, (0, False, True, False, True), stuck),
        # an edge is given one round to settle
        *log("edge", go, idle, (0, False, False, True, None), stuck),
        *log("rounds", go, idle, go, idle, go),
        *log("open", go, idle),
    ]
    got = {r["k"]: (r["stop_reason"], r["stopped_at"], r["items"]) for r in folds.scan_stops(spark.createDataFrame(rows, LOG), "k", 5, 2, 4).collect()}
    assert got == {
        "condition": ("condition", 1, 1), "items": ("max_items", 3, 4), "stalls": ("boundary", 2, 1), "proof": ("boundary", 2, 1), "pinned": ("no_progress", 2, 1),
        "late end": ("boundary", 3, 1), "edge": ("boundary", 3, 1), "rounds": ("max_rounds", 4, 3), "open": (None, 1, 1),
    }


def test_pages(spark):
    point = "array<struct<text string, author string, viewer boolean>>"
    source = "array<struct<title string, feed string, url string>>"
    stories = spark.createDataFrame([("d", 1, "A *b*", [("x", " Ann‮", True), ("y" * 90, None, False)], [(None, "feed_1", "javascript:x"), ("t", "f", "https://h/>")]), ("e", 1, "", [], [])], f"digest string, place long, title string, points {point.replace(' string', ':string').replace(' boolean', ':boolean')}, sources {source.replace(' string', ':string')}")
    lines = digest.story_lines(stories)
    got = {(r["digest"], r["page"]): r["markdown"] for r in digest.pages(lines, 40).collect()}
    assert all(len(x.encode()) <= 40 for x in got.values())
    whole = "".join(got["d", i] for i in range(len([k for k in got if k[0] == "d"])))
    said = "## A \\*b\\*\n\n- **Ann:** `SELF` x\n- " + "y" * 37 + "\n" + "y" * 39 + "\n" + "y" * 14 + "\n\n### Sources\n- feed\\_1 — feed\\_1\n- [t](<https://h/%3E>) — f\n"
    assert whole == said
    one = {r["digest"]: r["markdown"] for r in digest.pages(lines).collect()}
    assert one["e"] == "## \n\n- Nothing to report.\n\n### Sources\n"
    assert digest.pages(lines.limit(0)).collect() == []


def test_a_large_digest_is_many_pages(spark):
    n = 20_000
    lines = spark.range(n).select(F.lit("d").alias("digest"), F.struct(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c")).alias("at"), F.concat(F.lit("- "), F.col("id").cast("string")).alias("line"))
    got = sorted(digest.pages(lines, 5000).collect(), key=lambda r: r["page"])
    assert [r["page"] for r in got] == list(range(len(got))) and max(len(r["markdown"]) for r in got) <= 5000
    assert "".join(r["markdown"] for r in got) == "".join(f"- {i}\n" for i in range(n))
