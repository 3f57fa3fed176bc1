"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, joins
from ..registry import query
from ..sources.tables import EVENT_ITEMS, event_items, table
from .scalars import WHITE_SQL
from .scans import DAY, START


@query("SELECT n.n_nationkey AS feed_id, n.n_name AS feed, r.r_name AS source FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def join_feeds_sources(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("feed_id"), F.col("n_name").alias("feed"), F.col("r_name").alias("source"))


@query("""SELECT c_custkey, n_name, r_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE c_acctbal > 0 ORDER BY r_name, n_name, c_mktsegment, c_custkey""")
def join_three_way(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    joined = c.where("c_acctbal > 0").join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select("c_custkey", "n_name", "r_name", "c_mktsegment").orderBy("r_name", "n_name", "c_mktsegment", "c_custkey")


@query("""SELECT o_orderkey AS story_id, l_linenumber AS development_id, p_name AS item, c_custkey AS user_id FROM customer JOIN orders ON c_custkey = o_custkey
    JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'P'""")
def story_members(spark, sf_dir):
    c, o, l, p = (table(spark, sf_dir, x) for x in ("customer", "orders", "lineitem", "part"))
    joined = o.where("o_orderstatus = 'P'").join(l, o.o_orderkey == l.l_orderkey).join(c, o.o_custkey == c.c_custkey).join(p, l.l_partkey == p.p_partkey)
    return joined.select(F.col("o_orderkey").alias("story_id"), F.col("l_linenumber").alias("development_id"), F.col("p_name").alias("item"), F.col("c_custkey").alias("user_id"))


@query("""SELECT o_custkey AS user_id, count(*) AS stories, count(DISTINCT l_orderkey) AS digests FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY o_custkey""")
def digest_story_list(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return o.join(l, o.o_orderkey == l.l_orderkey).groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("stories"), F.countDistinct("l_orderkey").alias("digests"))


@query("""SELECT a.event_id, b.event_id AS other_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.event_id = a.event_id + 3""")
def join_multi_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    b = e.select(F.col("event_id").alias("other_id"), "user_id", "event_type", (F.col("event_id") - 3).alias("key"))
    return e.withColumn("key", F.col("event_id")).join(b, ["user_id", "event_type", "key"]).select("event_id", "other_id")


@query("""SELECT o_custkey AS run, o_orderstatus AS status, count(*) AS feeds, cast(sum(l_linenumber) AS BIGINT) AS stage_sum FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def run_feeds(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return l.join(o, l.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("run"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("feeds"), F.sum("l_linenumber").alias("stage_sum"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_in_subquery(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_missing_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.missing_keys(c, o, ["c_custkey"])


@query("""SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)""")
def ownership_violations(spark, sf_dir):
    owned = table(spark, sf_dir, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("l_suppkey"))
    return joins.missing_keys(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), owned, ["l_suppkey"])


@query("""WITH requests AS (SELECT l_orderkey AS item, l_linenumber AS version, l_returnflag AS fingerprint, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal FROM lineitem),
    cache AS (SELECT o_orderkey AS item, 1 AS version, 'R' AS fingerprint, o_orderpriority AS analysis FROM orders)
    SELECT ordinal, item, analysis FROM requests LEFT JOIN cache USING (item, version, fingerprint) ORDER BY item, ordinal""")
def tuple_cache_lookup(spark, sf_dir):
    from pyspark.sql import Window

    l = table(spark, sf_dir, "lineitem")
    ordinal = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    requests = l.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("version"), F.col("l_returnflag").alias("fingerprint"), ordinal.alias("ordinal"))
    cache = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.lit(1).alias("version"), F.lit("R").alias("fingerprint"), F.col("o_orderpriority").alias("analysis"))
    return joins.tuple_lookup(requests, cache, ["item", "version", "fingerprint"]).select("ordinal", "item", "analysis").orderBy("item", "ordinal")


@query("""SELECT conv_id, turn, turn % 3 <> 1 AS hit, bool_or(turn % 3 = 1) OVER (PARTITION BY conv_id) AS miss FROM conversations""")
def unit_cache_miss(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return joins.unit_misses(c, c.where("turn % 3 <> 1"), ["conv_id", "turn"], ["conv_id"])


@query("""SELECT l_returnflag, s_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def broadcast_lookup(spark, sf_dir):
    """The small side is Spark's to broadcast where its size allows; it is pre-aggregated either way."""
    l, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    counts = l.groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    return counts.join(s, counts.l_suppkey == s.s_suppkey).groupBy("l_returnflag", "s_name").agg(F.sum("n").alias("n"))


@query("""SELECT a.conv_id, a.turn, CASE WHEN coalesce(b.text, '') <> '' THEN concat('[QUOTED_MESSAGE]', chr(10), b.text, chr(10), '[/QUOTED_MESSAGE]', chr(10), a.text) ELSE a.text END AS rendered
    FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""")
def quote_self_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("reply_to", F.col("turn") - 1)
    return joins.quoted(c, ["conv_id"], "reply_to", "turn", "text").select("conv_id", "turn", "rendered")


@query(f"""WITH {EVENT_ITEMS}, windows AS (SELECT feed_id, min(date_ms) + length(feed_id) * {DAY} AS from_ms, max(date_ms) - {DAY} AS to_ms FROM items GROUP BY feed_id)
    SELECT i.item_id, i.feed_id FROM items i JOIN windows w ON i.feed_id = w.feed_id AND i.date_ms BETWEEN w.from_ms AND w.to_ms""")
def per_feed_window_join(spark, sf_dir):
    items = event_items(spark, sf_dir)
    windows = items.groupBy("feed_id").agg((F.min("date_ms") + F.char_length("feed_id") * DAY).alias("from_ms"), (F.max("date_ms") - DAY).alias("to_ms"))
    return joins.windowed(items, windows).select("item_id", "feed_id")


RULES = [("r1", "licensed under"), ("r2", "idiot"), ("r3", "of the and"), ("r4", "$$$")]


@query("""SELECT doc_id, rule_id FROM documents, (VALUES ('r1', 'licensed under'), ('r2', 'idiot'), ('r3', 'of the and'), ('r4', '$$$')) r(rule_id, phrase) WHERE contains(lower(text), phrase)""")
def mute_rule_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return joins.phrase_matches(docs, RULES, "text").select("doc_id", "rule_id")


@query(f"""WITH r AS (SELECT DISTINCT concat('t', source) AS rule_id, 'topic' AS kind, upper(source) AS label FROM documents UNION ALL SELECT DISTINCT concat('e', lang), 'entity', concat(chr(9), lang, chr(10)) FROM documents
      UNION ALL SELECT DISTINCT concat('y', doc_id % 3), 'story_type', concat('Type', doc_id % 3) FROM documents UNION ALL SELECT concat('p', item_id), 'phrase', concat(chr(160), chr(10), substr(text, 3, 30), chr(9)) FROM benchmark UNION ALL SELECT concat('w', item_id), 'phrase', substr(text, 1, 2 + item_id % 6) FROM benchmark),
    n AS (SELECT rule_id, kind, lower(trim(label, {WHITE_SQL})) AS needle FROM r WHERE trim(label, {WHITE_SQL}) <> '')
    SELECT DISTINCT doc_id AS story_id, rule_id FROM documents, n WHERE (kind = 'topic' AND lower(source) = needle) OR (kind = 'entity' AND lower(lang) = needle) OR (kind = 'story_type' AND concat('type', doc_id % 7) = needle) OR (kind = 'phrase' AND contains(lower(text), needle))""")
def rule_table_match(spark, sf_dir):
    """Rules of every kind, as a table: the documents' sources, languages and types, and phrases from the benchmark."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rule = lambda df, kind, key, label: df.select(key.alias("rule_id"), F.lit(kind).alias("kind"), label.alias("label"))
    named = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    item, third = F.col("item_id"), F.col("doc_id") % 3
    rules = rule(d, "topic", named("t", F.col("source")), F.upper("source")).union(rule(d, "entity", named("e", F.col("lang")), F.concat(F.lit("\t"), "lang", F.lit("\n")))).union(rule(d, "story_type", named("y", third), named("Type", third))).distinct()
    rules = rules.union(rule(b, "phrase", named("p", item), F.concat(F.lit("\u00a0\n"), F.substring("text", 3, 30), F.lit("\t")))).union(rule(b, "phrase", named("w", item), F.substring(F.col("text"), F.lit(1), (2 + item % 6).cast("int"))))
    stories = d.select(F.col("doc_id").alias("story_id"), F.array("source").alias("topics"), F.array("lang").alias("entities"), F.array(named("Type", F.col("doc_id") % 7)).alias("types"), F.array("text").alias("texts"))
    return joins.rule_matches(stories, rules)


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)""")
def owner_scope(spark, sf_dir):
    """Lines of one customer's orders: of other owners' nothing is seen."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return filters.owned_through(table(spark, sf_dir, "lineitem"), orders, ["l_orderkey"], 7, "o_custkey").select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"""WITH {EVENT_ITEMS}, p AS (SELECT item_id, CASE WHEN item_id % 5 <> 0 THEN date_ms - {START + 3 * DAY} END AS a, CASE WHEN item_id % 7 <> 0 THEN (item_id % 20) * {DAY} END AS b FROM items)
    SELECT item_id, CASE WHEN (a IS NULL) <> (b IS NULL) THEN 'both ends or neither' WHEN a < 0 OR b < 0 THEN 'negative' WHEN a > b THEN 'start after end' END AS error FROM p""")
def period_validation(spark, sf_dir):
    item = F.col("item_id")
    start, end = F.when(item % 5 != 0, F.col("date_ms") - (START + 3 * DAY)), F.when(item % 7 != 0, item % 20 * DAY)
    return event_items(spark, sf_dir).select("item_id", filters.period_error(start, end).alias("error"))


@query(f"""WITH {EVENT_ITEMS}, d AS (SELECT item_id, user_id, CASE WHEN item_id % 3 = 0 THEN date_ms END AS date_ms FROM items)
    SELECT item_id, CASE WHEN date_ms IS NULL THEN last_value(date_ms IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS lower_ms,
      CASE WHEN date_ms IS NULL THEN first_value(date_ms IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY item_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) + 59999 END AS upper_ms FROM d""")
def neighbor_bounds(spark, sf_dir):
    rows = event_items(spark, sf_dir).select("item_id", "user_id", F.when(F.col("item_id") % 3 == 0, F.col("date_ms")).alias("date_ms"))
    return joins.neighbor_bounds(rows, ["user_id"], [F.asc("item_id")]).select("item_id", "lower_ms", "upper_ms")


@query("""SELECT p_partkey AS post_id, CASE WHEN l.n IS NULL THEN 'denied' ELSE 'full' END AS entitlement, coalesce(l.n, 0) AS n FROM part
    LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey) l ON p_partkey = l_partkey""")
def entitlement_lookup_join(spark, sf_dir):
    p, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(F.count("*").alias("n"))
    lookups = l.select(F.col("l_partkey").alias("asked"), F.col("l_partkey").alias("post_id"), F.lit("p").alias("publication"), "n")
    posts = p.select(F.col("p_partkey").alias("post_id"), F.lit("p").alias("publication"))
    found = joins.entitled(posts, lookups, "post_id", "publication")
    return found.join(lookups.select("post_id", "n"), "post_id", "left").select("post_id", "entitlement", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"""WITH {EVENT_ITEMS}, ref AS (SELECT feed_id AS key, max(date_ms) AS last_ms FROM items WHERE feed_id <> 'view' GROUP BY feed_id),
    k AS (SELECT DISTINCT user_id, feed_id AS key FROM items WHERE feed_id <> 'click')
    SELECT user_id, key, last_ms FROM k JOIN ref USING (key) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_ms DESC, key) = 1""")
def reference_match(spark, sf_dir):
    items = event_items(spark, sf_dir)
    ref = items.where("feed_id <> 'view'").groupBy(F.col("feed_id").alias("key")).agg(F.max("date_ms").alias("last_ms"))
    keys = items.where("feed_id <> 'click'").select("user_id", F.col("feed_id").alias("key"))
    return joins.newest_reference(keys, ref, "user_id").select("user_id", "key", "last_ms")


@query(f"""WITH {EVENT_ITEMS}, delivered AS (SELECT user_id, count(*) % 6 AS version FROM items WHERE date_ms < {START + 10 * DAY} GROUP BY user_id),
    cur AS (SELECT user_id, feed_id, count(*) % 5 AS version FROM items GROUP BY ALL)
    SELECT c.user_id, c.feed_id, c.version FROM cur c LEFT JOIN delivered d USING (user_id) WHERE d.version IS NULL OR d.version < c.version""")
def suppress_delivered(spark, sf_dir):
    items = event_items(spark, sf_dir)
    delivered = items.where(F.col("date_ms") < START + 10 * DAY).groupBy("user_id").agg((F.count("*") % 6).alias("delivered"))
    current = items.groupBy("user_id", "feed_id").agg((F.count("*") % 5).alias("version"))
    return current.join(delivered, "user_id", "left").where("delivered IS NULL OR delivered < version").select("user_id", "feed_id", "version")
