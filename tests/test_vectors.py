"""Literal cases, and random sequences against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tributary.functions import dates, text, udfs, urls
from tributary.operators import filters, folds, graph, joins, merges, paging, requests, units, usage
from tributary.sources import connectors
from tributary.streaming import programs

MINUTE = 60_000


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'long'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, text.slug("a"), a="  Stable Aurora! ") == "stable-aurora"
    assert one(spark, text.slug(udfs.nfkc("a")), a="Ｆｉｌｍ ﬁn") == "film-fin"
    assert one(spark, text.slug("a"), a=" -- ") is None
    assert one(spark, text.clean_labels("a"), a=[" Film ", "film", "", "FILM", "x"]) == ["Film", "x"]
    assert one(spark, text.utf8_head("a", 5), a="aé😀b") == "aé" and one(spark, text.utf8_tail("a", 4), a="aé😀b") == "b"
    assert one(spark, text.evidence("a", F.lit("one two three")), a=["two", " two ", "four", "😀" * 101]) == ["two"]
    assert one(spark, text.boilerplate("a"), a="\r\n x \t\r\ny  \n\n") == " x\ny"
    assert one(spark, text.first_text("a", "b"), a=" ", b="y") == "y"
    assert one(spark, text.redact("a"), a="cookie: abc\nGET https://u:p@h.test gsk_12345678\nparams: 1") == "cookie: [REDACTED]\nGET https://[REDACTED]@h.test [REDACTED]"
    assert one(spark, text.markdown("a"), a="a*b‮ [c]") == "a\\*b \\[c\\]"
    assert one(spark, text.duration(F.lit(3723))) == "1h 2m 3s" and one(spark, text.duration(F.lit(59))) == "59s"
    assert one(spark, text.backoff_ms(F.lit(3), 500)) == 4000
    assert one(spark, text.cleaned_json("a"), a="<think>no</think>```json\n{}\n```") == "{}"
    assert one(spark, udfs.utf8_split("a", F.lit(3)), a="aé😀b") == ["aé", "😀", "b"] and one(spark, udfs.utf8_split("a", F.lit(3)), a="") == [""]
    assert one(spark, udfs.html_text("a"), a="<p>Hi <a href='x'>there</a></p><script>no</script><p>End</p>") == "Hi there\nEnd"
    long = "x" * 3000 + "y" * 6000
    assert one(spark, text.compact(F.lit("T"), F.lit(long), F.array(F.lit("e1"), F.lit("e2")))) == "T\ne1\ne2\n" + "x" * 2000 + "\n" + "y" * 2000


def test_urls(spark):
    assert one(spark, urls.normalized("a"), a="https://H.Test/a/?q=1#f") == "https://h.test/a?q=1"
    assert one(spark, urls.normalized("a"), a="https://H.Test") == "https://h.test/" and one(spark, urls.normalized("a"), a="nope") is None
    assert one(spark, urls.publication_origin("a"), a="http://News.Test/p") == "https://news.test"
    for bad in ("https://u:p@h.test", "https://h.test:1", "https://127.0.0.1/", "https://localhost/", "ftp://h.test", "https://h.test/" + "x" * 2048):
        assert one(spark, urls.publication_origin("a"), a=bad) is None
    assert one(spark, urls.safe("a"), a="javascript:x") is None


def test_dates(spark):
    day = lambda label, today: str(one(spark, dates.relative_day(F.lit(label), F.lit(today).cast("date"))))
    assert day("Today", "2024-03-06") == "2024-03-06" and day("yesterday", "2024-03-01") == "2024-02-29"
    assert day("Wednesday", "2024-03-06") == "2024-02-28" and day("Tuesday", "2024-03-06") == "2024-03-05"
    assert day("Mar 7", "2024-03-06") == "2023-03-07" and day("Mar 5", "2024-03-06") == "2024-03-05" and day("Dec 24, 2020", "2024-03-06") == "2020-12-24"
    assert one(spark, dates.client_address(F.lit("1.1.1.1, 2.2.2.2, 3.3.3.3"), F.lit("d"), 1)) == "2.2.2.2"
    assert one(spark, dates.client_address(F.lit("1.1.1.1"), F.lit("d"), 1)) == "d"


def test_modes(spark):
    rows = [("inherit", "include_all", False), ("personalized", "include_all", True), ("inherit", "inherit", True), (None, "inherit", False)]
    df = spark.createDataFrame(rows, "f string, s string, w boolean").withColumn("u", F.lit("personalized"))
    assert [r[0] for r in df.select(filters.effective_mode("f", "s", "w", "u")).collect()] == ["include_all", "personalized", "include_all", "personalized"]


def test_usage(spark):
    c = [F.lit(x).cast("long") for x in (1_000_000, 600_000, 400_000, 250_000)]
    cost = one(spark, usage.micro_cost(*c, F.lit(2.0), F.lit(0.5), F.lit(4.0)))
    assert 2 * cost / 1e6 == pytest.approx(4.2)
    df = spark.createDataFrame([(2**53 - 2,), (5,)], "v long")
    assert df.agg(usage.saturating_sum("v"), usage.saturated("v")).first()[:] == (2**53 - 1, True)
    known = spark.createDataFrame([(1, True), (None, False)], "v long, k boolean").agg(usage.poisoned_sum(F.col("v"), F.col("k"))).first()[0]
    assert known is None


def loop_units(items, root_gap, root_cap, gap, cap):
    """Units item by item, as a message stream would make them."""
    made, by_root, out = [], {}, {}
    for x in items:
        unit = None
        if x["root"] is not None:
            u = by_root.get((x["feed"], x["root"]))
            if u and len(u) < root_cap and abs(x["date"] - u[-1]["date"]) <= root_gap:
                unit = u
        elif x["group"] and x["author"] and made:
            u = made[-1]
            if len(u) < cap and u[-1]["root"] is None and u[-1]["feed"] == x["feed"] and u[-1]["author"] == x["author"] and abs(x["date"] - u[-1]["date"]) <= gap:
                unit = u
        if unit is None:
            unit = []
            made.append(unit)
            if x["root"] is not None:
                by_root[(x["feed"], x["root"])] = unit
        unit.append(x)
        out[x["pos"]] = unit[0]["pos"]
    return out


def test_thread_units(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for scope in range(40):
        t, items = 0, []
        for pos in range(rng.randint(1, 60)):
            t += rng.choice([0, 1, 2, 2, 3, 10, 31]) * MINUTE
            items.append({"pos": pos, "feed": rng.choice("ab"), "root": rng.choice([None, None, "r", "s"]), "group": rng.random() < 0.8, "author": rng.choice(["x", "x", "y", "", None]), "date": t})
        want |= {(scope, p): u for p, u in loop_units(items, 30 * MINUTE, 8, 2 * MINUTE, 4).items()}
        rows += [(scope, x["pos"], x["feed"], x["root"], x["group"], x["author"], x["date"]) for x in items]
    df = spark.createDataFrame(rows, "scope int, pos long, feed_id string, root string, is_group boolean, author string, date_ms long")
    assert {(r["scope"], r["pos"]): r["unit"] for r in units.thread_units(df, ["scope"]).collect()} == want


def test_packing(spark):
    def sizes(n, cap):
        df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("pos"), F.lit(10).cast("long").alias("size"))
        out = folds.next_fit(df, ["k"], "pos", "size", cap, 10**9)
        return [r["count"] for r in out.groupBy("batch").count().orderBy("batch").collect()]

    assert sizes(737, 50) == [50] * 14 + [37] and sizes(25, 12) == [12, 12, 1] and sizes(203, 17) == [17] * 11 + [16]
    rng = random.Random(3)
    rows = [(k, p, rng.randint(1, 60), rng.choice("ab")) for k in range(9) for p in range(rng.randint(1, 80))]
    df = spark.createDataFrame(rows, "k int, pos long, size long, kind string").repartition(5)
    want, state = [], {}
    for k, p, size, kind in sorted(rows):
        batch, n, total, last = state.get(k, (-1, 6, 0, None))
        if n >= 6 or total + size > 100 or kind != last:
            batch, n, total = batch + 1, 0, 0
        state[k] = (batch, n + 1, total + size, kind)
        want.append((k, p, batch))
    assert sorted(map(tuple, folds.next_fit(df, ["k"], "pos", "size", 6, 100, same="kind").collect())) == want
    odd = spark.createDataFrame([(1, 1, None, None), (1, 2, 5, None), (1, 3, 5, "a"), (2, 1, 500, "a"), (2, 2, 1, "a")], "k int, pos long, size long, kind string")
    assert sorted(map(tuple, folds.next_fit(odd, ["k"], "pos", "size", 6, 100, same="kind").collect())) == [(1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 1, 0), (2, 2, 1)]


def test_fixed_window(spark):
    rng = random.Random(8)
    rows = [(k, p, rng.choice([None, p * 3 + rng.randint(0, 9)])) for k in range(7) for p in range(rng.randint(1, 60))]
    want, state = [], {}
    for k, p, t in sorted(rows, key=lambda r: r[:2]):
        n, resets = state.get(k, (0, 0))
        n, resets = (n + 1, resets) if n and (t is None or resets > t) else (1, (t or 0) + 20)
        state[k] = (n, resets)
        want.append((k, p, n, n <= 3))
    df = spark.createDataFrame(rows, "k int, pos long, t long").repartition(3)
    assert sorted(map(tuple, folds.fixed_window(df, ["k"], "pos", "t", 20, 3).collect())) == want


def test_targets(spark):
    def both(u):
        t = one(spark, urls.target("a"), a=u)
        return t and (t["kind"], t["id"])

    assert both("https://x.com/home") == ("following", None) and both("https://x.com/i/lists/12") == ("list", "12") and both("https://x.com/i/chat/a_B-1") == ("chat", "a_B-1")
    for bad in ("https://x.com/i/chat/Compose", "https://x.com/i/chat/settings", "https://x.com/i/lists/012", "https://x.com/i/lists/" + "1" * 33, "https://x.com/i/chat/" + "a" * 129, "https://x.com/home\n", "https://x.com/home/", "http://x.com/home", " https://x.com/home", "https://x.com/i/chat/_a", ""):
        assert both(bad) is None, bad
    assert one(spark, urls.target("a"), a=None) is None
    for feed in ("x:following", "x:list:7", "x:chat:abc"):
        assert one(spark, urls.target_feed(urls.target(urls.target_url(urls.feed_target("a")))), a=feed) == feed
    assert one(spark, urls.feed_target("a"), a="x:chat:new") is None and one(spark, urls.feed_target("a"), a="x:list:0") is None


def test_utf8_ends(spark):
    rng = random.Random(4)
    texts = ["", "a", "\ufffd" * 5, "é\ufffd😀\ufffd"] + ["".join(rng.choice("ab é€😀\ufffd") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3, 4, 5, 7, 12):
        for r in df.select("t", text.utf8_head("t", n).alias("head"), text.utf8_tail("t", n).alias("tail")).collect():
            raw = r["t"].encode()
            assert r["head"] == raw[:n].decode(errors="ignore") and r["tail"] == raw[max(0, len(raw) - n) :].decode(errors="ignore"), (r, n)


def test_fingerprint(spark):
    df = spark.sql("SELECT named_struct('b', 1, 'a', CAST(NULL AS STRING), 'c', array(named_struct('z', 'x\"', 'y', true))) AS s, map('k2', 2, 'K1', 1) AS m, CAST(NULL AS STRUCT<q: INT>) AS nothing")
    want = json.dumps({"m": {"K1": 1, "k2": 2}, "nothing": None, "s": {"a": None, "b": 1, "c": [{"y": True, "z": 'x"'}]}}, separators=(",", ":"))
    assert df.select(text.canonical_json(df, "s", "nothing", "m")).first()[0] == want
    assert df.select(text.fingerprint(df, "m", "s", "nothing") == text.fingerprint(df, "nothing", "s", "m")).first()[0]


def test_fallback_identity(spark):
    df = spark.sql("SELECT 'post' AS k, CAST(NULL AS LONG) AS d, 'a\"b' AS w, CAST(NULL AS STRING) AS loc, 2L AS n, true AS v")
    got = df.select(text.identity_parts("k", "d", "w", F.lit("text"), "loc"), text.identity_parts("k", "d", "w", F.lit("text"), "loc", "n", "v")).first()
    assert list(got) == ['["post",null,"a\\"b","text",null]', '["post",null,"a\\"b","text",null,2,"viewer"]']


def test_rules(spark):
    rules = spark.createDataFrame([("t", "topic", " Ｆilm "), ("e", "entity", "Ann"), ("y", "story_type", "launch"), ("p", "phrase", "NEW Film"), ("q", "phrase", "é"), ("empty", "phrase", "  "), ("null", "phrase", None), ("long", "phrase", "a new film opens"), ("other", "color", "film")], "rule_id string, kind string, label string")
    stories = spark.createDataFrame([(1, ["film"], ["ann "], ["Launch"], ["A new ﬁlm opens", None]), (2, ["films"], None, [], ["", "ne", "café"]), (3, None, None, None, None)], "story_id int, topics array<string>, entities array<string>, types array<string>, texts array<string>")
    got = sorted(map(tuple, joins.rule_matches(stories, rules).collect()))
    assert got == [(1, "e"), (1, "long"), (1, "p"), (1, "t"), (1, "y"), (2, "q")]
    assert joins.rule_matches(stories, rules.limit(0)).collect() == [] and joins.rule_matches(stories.limit(0), rules).collect() == []


def test_scopes_and_periods(spark):
    parents = spark.createDataFrame([(1, "u"), (2, "v"), (None, "u")], "source_id int, user_id string")
    children = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 9)], "id int, source_id int")
    assert [r["source_id"] for r in filters.owned(parents, "v").collect()] == [2]
    assert [r["id"] for r in filters.owned_through(children, parents, ["source_id"], "u").collect()] == [1]
    for a, b, wrong in ((None, None, False), (1, 2, False), (2, 2, False), (3, 2, True), (1, None, True), (None, 1, True), (-1, 2, True)):
        df = spark.createDataFrame([(a, b)], "a long, b long")
        assert (df.select(filters.period_error(F.col("a"), F.col("b"))).first()[0] is not None) == wrong, (a, b)


def test_summary_jobs(spark):
    rows = [(1, 1, "brief", None, 5, 5), (1, 2, "brief", False, None, None), (1, 3, "thorough", False, 5, 5), (1, 4, "brief", True, 5, 5), (1, 5, "brief", False, 5, 11), (1, 6, "brief", False, 5, 5), (1, 7, "brief", False, 1, 1), (1, 8, None, False, 1, 1), (2, 1, "normal", False, 1, 1)]
    df = spark.createDataFrame(rows, "k int, pos long, detail string, has_media boolean, raw_bytes long, input_bytes long")
    got = {(r["k"], r["pos"]): (r["kind"], r["batch"]) for r in requests.summary_jobs(df, ["k"], "pos", 10).collect()}
    single = ("single", None)
    assert got == {(1, 1): ("batch", 0), (1, 2): ("batch", 0), (1, 3): single, (1, 4): single, (1, 5): single, (1, 6): ("batch", 0), (1, 7): ("batch", 1), (1, 8): ("batch", 2), (2, 1): ("batch", 0)}


def test_usage_rollup(spark):
    big = 2**53 - 10
    rows = [("s", "m", "success", 5, big, 1, 2, 3, None), ("s", "m", "retry", 7, 20, 1, 2, None, 4), ("s", None, "failure", 1, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "stage string, model string, status string, duration_ms long, prompt long, completion long, total long, hit long, miss long")
    got = {(r["stage"], r["model"]): r for r in usage.rollup(df).collect()}
    assert set(got) == {(None, None), ("s", "m"), ("s", "unknown")}
    total = got[None, None]
    assert [total[c] for c in usage.COUNTERS] == [3, 13, 2, 2**53 - 1, 2, 4, 3, 4, 1, 1, 1] and total["saturated"] and not got["s", "unknown"]["saturated"]
    assert [got["s", "unknown"][c] for c in usage.COUNTERS] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 1]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(80), f"k{rng.randrange(60)}") for _ in range(90)] + [(i, f"c{j}") for i in range(100, 140) for j in (i, i + 1)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for i, k in pairs:
        root[find(k)] = find(i)
    groups = {}
    for i, _ in pairs:
        groups.setdefault(find(i), set()).add(i)
    want = {i: min(g) for g in groups.values() for i in g}
    got = graph.key_components(spark.createDataFrame(pairs, "item long, key string")).collect()
    assert {r["item"]: r["component"] for r in got} == want


def test_upsert_and_cursor(spark):
    schema = "f string, e string, text string, at long"
    old = spark.createDataFrame([("f", "1", "Before", 10), ("f", "2", None, 10)], schema)
    new = spark.createDataFrame([("f", "1", "After", 20), ("f", "2", None, 20), ("f", "3", "x", 20)], schema)
    out = sorted(merges.upsert_items(old, new, ["f", "e"], ["text"], "at").collect())
    assert [tuple(r) for r in out] == [("f", "1", "After", 20), ("f", "2", None, 10), ("f", "3", "x", 20)]
    c = spark.createDataFrame([("a", 5), ("b", None)], "feed string, at long")
    s = spark.createDataFrame([("a", 3), ("b", 4), ("c", 7)], "feed string, at long")
    assert dict(merges.advance_cursors(c, s, "feed", "at").collect()) == {"a": 5, "b": 4, "c": 7}


def test_story_versions(spark):
    """Replay 1, later date 1, other title 2, another member and development 3, another fingerprint 4, an item moved away 5."""
    S, D, M = "story string, title string, labels string", "story string, dev string, kind string, title string, occurred_at long", "story string, dev string, item string, fingerprint string"
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    state = (make([], S + ", version int"), make([], D + ", version int"), make([], M))
    steps = [
        ([("s", "T", "l")], [("s", "d", "k", "D", 100)], [("s", "d", "i1", "p1")], 1),
        ([("s", "T", "l")], [("s", "d", "k", "D", 100)], [("s", "d", "i1", "p1")], 1),
        ([("s", "T", "l")], [("s", "d", "k", "D", 200)], [("s", "d", "i1", "p1")], 1),
        ([("s", "T2", "l")], [("s", "d", "k", "D2", 100)], [("s", "d", "i1", "p1")], 2),
        ([("s", "T2", "l")], [("s", "d", "k", "D2", 100), ("s", "e", "k", "E", 150)], [("s", "e", "i2", "p2")], 3),
        ([("s", "T2", "l")], [("s", "d", "k", "D2", 100)], [("s", "d", "i1", "p9")], 4),
        ([("z", "Z", "l")], [("z", "d", "k", "D", 100)], [("z", "d", "i1", "p9")], 5),
    ]
    for stories, developments, members, version in steps:
        out = merges.story_versions(*state, make(stories, S), make(developments, D), make(members, M))
        rows = [x.collect() for x in out]
        state = (make(rows[0], S + ", version int"), make(rows[1], D + ", version int"), make([(r["story"], r["dev"], r["item"], r["fingerprint"]) for r in rows[2]], M))
        assert {r["story"]: r["version"] for r in rows[0]}["s"] == version
    assert {(r["story"], r["dev"]): r["occurred_at"] for r in rows[1]}[("s", "d")] == 100


def test_replace_once_rules(spark):
    old = spark.createDataFrame([("a", 1, "id1"), ("b", 1, "id2")], "story string, version int, id string")
    new = spark.createDataFrame([("a", 1, "n1"), ("b", 2, "n2")], "story string, version int, id string")
    assert sorted(r["id"] for r in merges.replace_set(old, new, ["story", "version"], "id").collect()) == ["id1", "n2"]
    rules = spark.createDataFrame([("r", "explicit", "active", 100, 1), ("q", "inferred", "dismissed", 50, 3)], "rule string, origin string, state string, strength int, version int")
    arrived = spark.createDataFrame([("r", "inferred", "active", 50), ("q", "inferred", "active", 50), ("n", "inferred", "active", 50)], "rule string, origin string, state string, strength int")
    assert {r["rule"]: (r["origin"], r["version"]) for r in merges.apply_rules(rules, arrived, ["rule"]).collect()} == {"r": ("explicit", 1), "q": ("inferred", 3), "n": ("inferred", 1)}


def test_pages(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(20)], "id long, at long")
    for direction in ("asc", "desc"):
        after, seen = None, []
        while True:
            rows = paging.page(df, "at", "id", direction, 7, after).collect()
            seen += [r["id"] for r in rows[:7]]
            if len(rows) <= 7:
                break
            cursor = paging.encode_cursor(direction, rows[6]["at"], rows[6]["id"])
            after = paging.decode_cursor(cursor, direction)
            with pytest.raises(ValueError):
                paging.decode_cursor(cursor, "other")
        assert seen == (list(range(20)) if direction == "asc" else list(range(19, -1, -1)))
    for bad in (0, 101, True, "5"):
        with pytest.raises(ValueError):
            paging.page_limit(bad)
    assert paging.page_limit(None) == 20


def test_phrases_and_quotes(spark):
    df = spark.createDataFrame([("Secret launch details",), ("nothing",)], "t string")
    assert [r["rule_id"] for r in joins.phrase_matches(df, [("m1", "secret launch")], "t").collect()] == ["m1"]
    m = spark.createDataFrame([("c", 1, None, "hi"), ("c", 2, 1, "yes"), ("c", 3, 9, "no")], "c string, n long, r long, t string")
    assert [r["rendered"] for r in joins.quoted(m, ["c"], "r", "n", "t").orderBy("n").collect()] == ["hi", "[QUOTED_MESSAGE]\nhi\n[/QUOTED_MESSAGE]\nyes", "no"]


def test_archive(spark, tmp_path):
    posts = [[{"id": 3, "type": "newsletter", "title": "c", "date_ms": 30}, {"id": 2, "type": "podcast", "title": "b", "date_ms": 20}], [{"id": 2, "type": "podcast", "title": "b", "date_ms": 20}, {"id": 1, "type": "thread", "title": "a", "date_ms": 10}]]
    paths = []
    for i, page in enumerate(posts):
        (tmp_path / f"{i}.json").write_text(json.dumps(page))
        paths.append(str(tmp_path / f"{i}.json"))
    items = connectors.scan(spark, "archive", {"pages": ",".join(paths), "from_ms": "15", "feed_id": "f"})
    assert sorted(r["external_id"] for r in items.collect()) == ["2", "3"]
    assert connectors.violations(items.withColumn("external_id", F.lit(""))).select("rule").distinct().collect()[0][0] == "external_id is empty"
    with pytest.raises(Exception, match="an invalid item"):
        connectors.checked(items.withColumn("external_id", F.lit(""))).collect()
    with pytest.raises(Exception, match="repeats page"):
        connectors.scan(spark, "archive", {"pages": ",".join([paths[0], paths[0]])}).collect()
    (tmp_path / "bad.json").write_text('[{"id": 0}]')
    with pytest.raises(Exception, match="invalid post"):
        connectors.scan(spark, "archive", {"pages": str(tmp_path / "bad.json")}).collect()
    with pytest.raises(ValueError, match="no connector"):
        connectors.scan(spark, "fax", {})


def test_archive_stops_before_the_window(spark, tmp_path):
    from tributary.sources import archive

    for i in range(9):
        page = [{"id": 100 - 10 * i - k, "type": "podcast", "title": "t", "date_ms": 1000 - 100 * i - k} for k in range(3)]
        (tmp_path / f"p{i}.json").write_text(json.dumps(page) if i < 5 else "no list")
    paths = archive.names(spark, f"file://{tmp_path}/p*.json")
    # the pages from 5 on can't be read, but page 3 lies before the window
    found = archive.scan(spark, paths, from_ms=798, wave=2)
    assert sorted(r["post_id"] for r in found.collect()) == [78 + 0, 79, 80, 88, 89, 90, 98, 99, 100]
    with pytest.raises(ValueError, match="invalid post in .*p5"):
        archive.scan(spark, paths, from_ms=0, wave=2)
    (tmp_path / "p4.json").write_text((tmp_path / "p1.json").read_text())
    with pytest.raises(ValueError, match="p4.json repeats page .*p1"):
        archive.scan(spark, paths[:5], from_ms=0, wave=2)
    assert archive.scan(spark, []).collect() == []
    rows = archive.stream(spark, f"{tmp_path}/p[0-3].json", from_ms=798)
    from tributary.streaming import programs

    assert sorted(r["post_id"] for r in programs.to_table(rows, f"{tmp_path}/out").collect()) == [78, 79, 80, 88, 89, 90, 98, 99, 100]


def test_rules_with_white_space_and_many_rules(spark):
    stories = spark.createDataFrame([("s1", [" News\u00a0"], None, None, ["The WORLD cup\nfinal", None]), ("s2", None, ["sport"], None, ["worldwide"])], "story_id string, topics array<string>, entities array<string>, types array<string>, texts array<string>")
    rules = spark.createDataFrame([("r1", "topic", "\tnews\n"), ("r2", "phrase", "world\n"), ("r3", "phrase", "WORLD CUP"), ("r4", "phrase", " \n\u00a0"), ("r5", "entity", "\u2003sport"), ("r6", "phrase", "world")], "rule_id string, kind string, label string")
    want = [("s1", "r1"), ("s1", "r2"), ("s1", "r3"), ("s1", "r6"), ("s2", "r2"), ("s2", "r5"), ("s2", "r6")]
    for most in (joins.AUTOMATON_BYTES, 0):
        assert sorted(map(tuple, joins.rule_matches(stories, rules, most).collect())) == want
    many = spark.range(3000).selectExpr("cast(id AS string) AS rule_id", "'phrase' AS kind", "concat('word', id) AS label")
    texts = spark.createDataFrame([(1, None, None, None, ["word7 and word2999!"])], "story_id long, topics array<string>, entities array<string>, types array<string>, texts array<string>")
    assert sorted(r["rule_id"] for r in joins.rule_matches(texts, many).collect()) == ["2", "29", "299", "2999", "7"]


def test_windows_filter_items_first(spark):
    items = spark.createDataFrame([("a", 5), ("a", 50), ("b", 7), ("c", 6)], "feed_id string, date_ms long")
    windows = spark.createDataFrame([("a", 4, 10), ("b", 8, 12)], "feed_id string, from_ms long, to_ms long")
    out = joins.windowed(items, windows)
    assert [tuple(r)[:2] for r in out.collect()] == [("a", 5)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "(date_ms" in plan and "<= 12" in plan and ">= 4" in plan
    assert joins.windowed(items, windows.limit(0)).collect() == []


def test_streams(spark, tmp_path):
    schema = "k long, text string, at long"
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a", 10), (2, "b", 10)], schema).coalesce(1).write.mode("append").parquet(src)
    read = lambda: programs.read(spark, src, spark.createDataFrame([], schema).schema)
    programs.upsert_stream(read(), root, ["k"], ["text"], "at", [F.desc("at")])
    spark.createDataFrame([(1, "a", 20), (2, "c", 20), (3, "d", 20)], schema).coalesce(1).write.mode("append").parquet(src)
    found = programs.upsert_stream(read(), root, ["k"], ["text"], "at", [F.desc("at")])
    assert sorted(tuple(r) for r in found.read().collect()) == [(1, "a", 10), (2, "c", 20), (3, "d", 20)]
    events = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:01:00"), ("u", "2024-01-01 01:00:00"), ("u", "2024-01-02 00:00:00")], "user string, ts string").select("user", F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    sessions = programs.session_counts(programs.read(spark, str(tmp_path / "ev"), events.schema), ["user"], "ts", "10 minutes", "1 minute")
    assert sorted(r["n"] for r in programs.to_table(sessions, str(tmp_path / "sessions")).collect()) in ([1, 2], [1, 1, 2])


def test_every_kind_of_secret(spark):
    from tributary.functions import text

    cases = {
        "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- x": "[REDACTED] x",
        "Authorization: bearer a.b-c=": "Authorization: Bearer [REDACTED]",
        "sk_live_abcdefghij and xai-1": "[REDACTED] and [REDACTED]",
        "AIzaX gsk_y": "[REDACTED] [REDACTED]",
        "Cookie=session=1; b=2\nnext": "Cookie=[REDACTED]\nnext",
        'api_key: "a b", auth_token=abc123; ct0=deadbeef pin: 1234': "api_key: [REDACTED], auth_token=[REDACTED]; ct0=[REDACTED] pin: [REDACTED]",
        "https://onlytoken@host/x": "https://[REDACTED]@host/x",
        "failed\nparams: secret": "failed",
        "y" * 600: "y" * 497 + "...",
    }
    found = spark.createDataFrame([(x,) for x in cases], "raw string").select("raw", text.redact("raw").alias("clean")).collect()
    assert {r["raw"]: r["clean"] for r in found} == cases
