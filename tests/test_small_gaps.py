"""Repaired JSON, NFKC labels, discovered links, lookups, points that are used again, isolated failures."""

import json

import pytest
from pyspark.sql import functions as F

from tributary.functions import text, udfs, urls
from tributary.operators import discovery, joins, merges


def test_repaired_json():
    cases = {
        '{"a": 1}': {"a": 1}, "{'a': 'it\\'s \"x\"'}": {"a": 'it\'s "x"'}, "{a: 1, b: [1, 2,], }": {"a": 1, "b": [1, 2]}, '{"a": [1, {"b": "c': {"a": [1, {"b": "c"}]}, '{"a":': {"a": None},
        "[True, None, undefined, -1.5e3]": [True, None, None, -1500.0], '{"a": 1 /* x */, // y\n "b": 2}': {"a": 1, "b": 2}, '{"a": "line\nfeed"}': {"a": "line\nfeed"}, "[1, 2}": [1, 2], '{"a": {"b": 1]}': {"a": {"b": 1}},
    }
    for raw, want in cases.items():
        assert json.loads(udfs._repaired(raw)) == want, raw
    for raw in ("no json at: all {", "{{}}", "a b", ""):
        assert udfs._repaired(raw) is None, raw
    assert udfs._repaired(None) is None


def test_labels(spark):
    df = spark.createDataFrame([(["ﬁne ", "FINE", " ", "x" * 201, "\tＡ", "a", None, "b"],)], "v array<string>")
    assert df.select(text.clean_labels("v")).first()[0] == ["ﬁne", "Ａ", "b"]
    assert spark.createDataFrame([(" \u3000Ｆoo\n\tBAR ",)], "v string").select(text.interest_label("v")).first()[0] == "foo bar"


def test_links(spark):
    rows = [(1, "/i/lists/5", None), (2, "https://x.com/i/lists/5?x=1", "Five"), (3, "/i/lists/5", "Other"), (4, "//x.com/home", "n"), (5, "http://x.com/home", "n"), (6, "/home\x00", "n"), (7, "/i/chat/settings", "n"), (8, "/i/chat/abc#x", "  "), (9, "/home", ""), (10, None, "n"), (11, "/i/lists/5/members", "n")]
    links = spark.createDataFrame(rows, "place long, href string, name string")
    got = discovery.discovered(links).orderBy(*discovery.menu_order()).collect()
    assert [tuple(r) for r in got] == [("x:following", "news", "Following", 9), ("x:list:5", "news", "Five", 1), ("x:chat:abc", "discussion", "Chat abc", 8)]
    assert links.select(urls.link_target("href").alias("t")).where("t IS NOT NULL").count() == 5


def test_lookups(spark):
    posts = spark.createDataFrame([(1, "p"), (2, "p")], "id long, pub string")
    ok = spark.createDataFrame([(1, 1, "p")], "asked long, id long, pub string")
    assert {r["id"]: r["entitlement"] for r in joins.entitled(posts, ok, "id", "pub").collect()} == {1: "full", 2: "denied"}
    for wrong in ((1, 7, "p"), (1, 1, "q"), (1, None, "p")):
        with pytest.raises(Exception, match="another post came back for 1"):
            joins.entitled(posts, spark.createDataFrame([wrong], "asked long, id long, pub string"), "id", "pub").collect()


def test_points(spark):
    schema = "s long, v int, points string, at long"
    history = spark.createDataFrame([(1, 1, "old", 1), (1, 1, "newer", 2), (2, 1, "two", 1)], schema)
    current = spark.createDataFrame([(1, 1, "now", 9), (3, 1, "stale", 9)], schema)
    selected = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "s long, v int")
    out = joins.reused_points(selected, current, history, ["s", "v"], [F.desc("at")]).collect()
    assert sorted(tuple(r) for r in out) == [(1, 1, "now", "current"), (2, 1, "two", "history"), (3, 2, None, None)]


def test_isolation_and_warmup(spark):
    items = spark.createDataFrame([("s", "a", 1, False), ("s", "b", 2, True), ("s", "b", 3, False), ("t", "c", 4, False)], "source string, feed string, item long, bad boolean")
    runs = spark.createDataFrame([("s", "a", 5, None), ("s", "b", 5, None), ("s", "x", 5, "refused"), ("s", "empty", 5, None), ("t", "c", 99, None)], "source string, feed string, took_ms long, error string")
    outcomes, kept = discovery.ingested(items, runs, 50)
    assert {r["feed"]: (r["failure"], r["fetched"]) for r in outcomes.collect()} == {"a": (None, 1), "b": ("an invalid item", 0), "x": ("refused", 0), "empty": (None, 0), "c": ("connector deadline exceeded", 0)}
    assert [r["item"] for r in kept.collect()] == [1]
    sources = spark.createDataFrame([("s", 1), ("t", 3), ("u", 0)], "k string, negatives int")
    events = spark.createDataFrame([("s", 1), ("s", 1), ("s", 5), ("s", 9), ("t", 2), ("z", 1)], "k string, e long")
    assert sorted(tuple(r) for r in merges.warmed(sources, events, "k", "e", 3).collect()) == [("s", 3, True, 5), ("t", 3, False, None)]
