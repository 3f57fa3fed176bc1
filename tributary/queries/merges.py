"""State transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascades, merges
from ..registry import query
from ..sources.tables import EVENT_ITEMS, event_items, table
from .scans import DAY, START

#: The total order that stands for arrival in the line items, whose keys repeat.
ARRIVAL = "l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC"


def arrival():
    return [F.desc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]


@query(f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ARRIVAL}) = 1),
    old AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag, 10::BIGINT AS fetched_at FROM b WHERE l_orderkey % 3 <> 0),
    new AS (SELECT *, 20::BIGINT AS fetched_at FROM b WHERE l_orderkey % 5 <> 0)
    SELECT coalesce(o.l_orderkey, n.l_orderkey) AS l_orderkey, coalesce(o.l_linenumber, n.l_linenumber) AS l_linenumber, CASE WHEN n.fetched_at IS NOT NULL THEN n.l_partkey ELSE o.l_partkey END AS l_partkey,
      CASE WHEN n.fetched_at IS NOT NULL THEN n.l_returnflag ELSE o.l_returnflag END AS l_returnflag,
      CASE WHEN n.fetched_at IS NULL THEN o.fetched_at WHEN o.fetched_at IS NULL OR n.l_returnflag IS DISTINCT FROM o.l_returnflag OR n.l_partkey IS DISTINCT FROM o.l_partkey THEN n.fetched_at ELSE o.fetched_at END AS fetched_at
    FROM old o FULL JOIN new n ON o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber""")
def upsert_items(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber"]
    b = merges.last_of_batch(table(spark, sf_dir, "lineitem"), keys, arrival()).select(*keys, "l_partkey", "l_returnflag")
    old = b.where("l_orderkey % 3 <> 0").withColumn("l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, "X").otherwise(F.col("l_returnflag"))).withColumn("fetched_at", F.lit(10).cast("long"))
    new = b.where("l_orderkey % 5 <> 0").withColumn("fetched_at", F.lit(20).cast("long"))
    return merges.upsert_items(old, new, keys, ["l_partkey", "l_returnflag"], "fetched_at")


@query("""SELECT doc_id AS item, n_chars % 97 AS analysis FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1000 + n_chars % 97 FROM documents WHERE doc_id % 2 = 1""")
def upsert_analysis(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), (F.col("n_chars") % 97).alias("analysis"), F.lit(1).alias("at"))
    new = d.where("item % 2 = 1").select("item", (F.col("analysis") + 1000).alias("analysis"), F.lit(2).alias("at"))
    return merges.upsert_items(d, new, ["item"], ["analysis"], "at").select("item", "analysis")


@query("""WITH o AS (SELECT o_custkey AS user_id, date_trunc('month', o_orderdate)::DATE AS period, o_orderkey AS id, o_orderstatus AS status, epoch_ms(o_orderdate) AS made, day(o_orderdate) > 15 AS second FROM orders)
    SELECT user_id, period, arg_min(id, made * 1000000 + id) AS digest, arg_max(status, made * 1000000 + id) AS status, min(made) AS created_at, max(made) AS updated_at FROM o GROUP BY 1, 2""")
def upsert_digest(spark, sf_dir):
    """Two batches, the halves of the months: a digest keeps the id and the time that it was made with, and takes the last status."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.trunc("o_orderdate", "month").alias("period"), F.col("o_orderkey").alias("digest"), F.col("o_orderstatus").alias("status"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at"), (F.dayofmonth("o_orderdate") > 15).alias("second"))
    keys = ["user_id", "period"]
    none = spark.createDataFrame([], "user_id long, period date, digest long, status string, created_at long, updated_at long")
    first = merges.upsert_periods(none, o.where("NOT second"), keys, "digest", "status", "at")
    return merges.upsert_periods(first, o.where("second"), keys, "digest", "status", "at")


@query("""WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1), c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (FROM n)), o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
    SELECT 'nation' AS level, n_nationkey AS id, NULL::BIGINT AS line, NULL::BIGINT AS parent FROM n UNION ALL SELECT 'customer', c_custkey, NULL, c_nationkey FROM c UNION ALL SELECT 'orders', o_orderkey, NULL, o_custkey FROM o
    UNION ALL SELECT 'lineitem', l_partkey, l_linenumber, CASE WHEN l_orderkey IN (SELECT o_orderkey FROM o) THEN l_orderkey END FROM lineitem""")
def delete_cascade(spark, sf_dir):
    """The nations of a region go: with them their customers and these customers' orders; line items stay, without their order."""
    tables = {n: table(spark, sf_dir, n) for n in ("nation", "customer", "orders", "lineitem")}
    keys = (
        cascades.ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
        cascades.ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
        cascades.ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey", "set_null"),
    )
    left = cascades.deleted(tables, keys, {"nation": F.col("n_regionkey") == 1})
    columns = (("nation", "n_nationkey", None, None), ("customer", "c_custkey", None, "c_nationkey"), ("orders", "o_orderkey", None, "o_custkey"), ("lineitem", "l_partkey", "l_linenumber", "l_orderkey"))
    out = None
    for name, *of in columns:
        part = left[name].select(F.lit(name).alias("level"), *[(F.col(c) if c else F.lit(None)).cast("long").alias(a) for c, a in zip(of, ("id", "line", "parent"), strict=True)])
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {EVENT_ITEMS}, c AS (SELECT user_id, max(date_ms) AS cursor_ms FROM items WHERE item_id % 3 = 0 AND user_id % 4 <> 0 GROUP BY user_id),
    s AS (SELECT user_id, max(date_ms) - {DAY} AS seen FROM items WHERE user_id % 5 <> 0 GROUP BY user_id)
    SELECT coalesce(c.user_id, s.user_id) AS user_id, CASE WHEN cursor_ms IS NULL THEN seen WHEN seen IS NULL THEN cursor_ms ELSE greatest(cursor_ms, seen) END AS cursor_ms FROM c FULL JOIN s ON c.user_id = s.user_id""")
def monotone_cursor(spark, sf_dir):
    items = event_items(spark, sf_dir)
    cursors = items.where("item_id % 3 = 0 AND user_id % 4 <> 0").groupBy("user_id").agg(F.max("date_ms").alias("cursor_ms"))
    seen = items.where("user_id % 5 <> 0").select("user_id", (F.col("date_ms") - DAY).alias("cursor_ms"))
    return merges.advance_cursors(cursors, seen, "user_id", "cursor_ms")


@query("""WITH f AS (SELECT o_orderkey AS feed, o_orderpriority AS name, CASE WHEN o_orderstatus = 'F' THEN 5::BIGINT END AS deleted_at FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT o_orderkey AS feed FROM orders WHERE o_orderkey % 2 = 0)
    SELECT coalesce(f.feed, r.feed) AS feed, CASE WHEN r.feed IS NOT NULL AND (f.feed IS NULL OR deleted_at IS NOT NULL) THEN 'default' ELSE name END AS name,
      CASE WHEN NOT (r.feed IS NOT NULL AND (f.feed IS NULL OR deleted_at IS NOT NULL)) THEN deleted_at END AS deleted_at,
      CASE WHEN r.feed IS NULL THEN 'untouched' WHEN f.feed IS NULL THEN 'created' WHEN deleted_at IS NOT NULL THEN 'revived' ELSE 'existing' END AS outcome FROM f FULL JOIN r ON f.feed = r.feed""")
def create_or_revive(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    feeds = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("feed"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "F", F.lit(5).cast("long")).alias("deleted_at"))
    return merges.create_or_revive(feeds, o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("feed")), "feed", {"name": F.lit("default")})


@query("""WITH old AS (SELECT doc_id AS story, quality AS version, concat('old', doc_id) AS id FROM labels WHERE doc_id % 3 <> 0), new AS (SELECT doc_id AS story, 1 AS version, concat('new', doc_id) AS id FROM labels WHERE doc_id % 2 = 0)
    SELECT n.story, n.version, coalesce(o.id, n.id) AS id FROM new n LEFT JOIN old o USING (story, version)""")
def replace_digest_stories(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    story = F.col("doc_id").alias("story")
    old = l.where("doc_id % 3 <> 0").select(story, F.col("quality").cast("int").alias("version"), F.concat(F.lit("old"), F.col("doc_id").cast("string")).alias("id"))
    new = l.where("doc_id % 2 = 0").select(story, F.lit(1).alias("version"), F.concat(F.lit("new"), F.col("doc_id").cast("string")).alias("id"))
    return merges.replace_set(old, new, ["story", "version"], "id")


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL) SELECT user_id, event_type, CASE WHEN user_id % 4 = 0 AND event_type = 'view' THEN -1 ELSE event_id END AS event_id FROM f""")
def insert_once(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    old = e.where("user_id % 4 = 0 AND event_type = 'view'").select("user_id", "event_type").distinct().withColumn("event_id", F.lit(-1).cast("long"))
    return merges.insert_once(old, e, ["user_id", "event_type"], [F.asc("event_id")])


@query("""WITH d AS (SELECT doc_id, source, lang, quality, toxic FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT source AS scope, lang AS label, CASE WHEN toxic = 1 THEN 'mute' WHEN quality = 0 THEN 'show_less' ELSE 'prioritize' END AS disposition, CASE WHEN toxic = 1 OR quality = 0 THEN 100 ELSE 50 END AS strength,
      CASE WHEN toxic = 1 OR quality = 0 THEN 'explicit' ELSE 'inferred' END AS origin, doc_id FROM d)
    SELECT scope, label, disposition, max(strength) AS strength, min(origin) AS origin, count(*) AS votes FROM r GROUP BY scope, label, disposition""")
def feedback_to_rules(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("scope"), F.col("lang").alias("label")).join(table(spark, sf_dir, "labels"), "doc_id")
    strong = (F.col("toxic") == 1) | (F.col("quality") == 0)
    disposition = F.when(F.col("toxic") == 1, "mute").when(F.col("quality") == 0, "show_less").otherwise("prioritize")
    rules = d.select("scope", "label", disposition.alias("disposition"), F.when(strong, 100).otherwise(50).alias("strength"), F.when(strong, "explicit").otherwise("inferred").alias("origin"))
    return rules.groupBy("scope", "label", "disposition").agg(F.max("strength").alias("strength"), F.min("origin").alias("origin"), F.count("*").alias("votes"))


@query("""WITH old AS (SELECT o_orderkey AS rule, CASE WHEN o_orderkey % 2 = 0 THEN 'explicit' ELSE 'inferred' END AS origin, CASE o_orderstatus WHEN 'P' THEN 'dismissed' ELSE 'active' END AS state, 50 AS strength, 1 AS version FROM orders WHERE o_orderkey % 4 <> 3),
    new AS (SELECT o_orderkey AS rule, CASE WHEN o_orderkey % 3 = 0 THEN 'explicit' ELSE 'inferred' END AS origin, 'active' AS state, CASE WHEN o_orderkey % 5 = 0 THEN 50 ELSE 100 END AS strength FROM orders WHERE o_orderkey % 7 <> 0),
    j AS (SELECT coalesce(o.rule, n.rule) AS rule, o.origin, o.state, o.strength, o.version, n.origin AS n_origin, n.state AS n_state, n.strength AS n_strength, n.rule IS NOT NULL AND NOT (n.origin = 'inferred' AND coalesce(o.origin = 'explicit' OR o.state = 'dismissed', false))
      AND NOT (o.rule IS NOT NULL AND o.origin = n.origin AND o.state = n.state AND o.strength = n.strength) AS take FROM old o FULL JOIN new n ON o.rule = n.rule)
    SELECT rule, CASE WHEN take THEN n_origin ELSE origin END AS origin, CASE WHEN take THEN n_state ELSE state END AS state, CASE WHEN take THEN n_strength ELSE strength END AS strength, coalesce(version, 0) + CASE WHEN take THEN 1 ELSE 0 END AS version FROM j""")
def apply_rule(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("rule", F.col("o_orderkey"))
    k = F.col("rule")
    old = o.where("rule % 4 <> 3").select("rule", F.when(k % 2 == 0, "explicit").otherwise("inferred").alias("origin"), F.when(F.col("o_orderstatus") == "P", "dismissed").otherwise("active").alias("state"), F.lit(50).alias("strength"), F.lit(1).alias("version"))
    new = o.where("rule % 7 <> 0").select("rule", F.when(k % 3 == 0, "explicit").otherwise("inferred").alias("origin"), F.lit("active").alias("state"), F.when(k % 5 == 0, 50).otherwise(100).alias("strength"))
    return merges.apply_rules(old, new, ["rule"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 10 = 0 AND l_returnflag <> 'R' THEN 99::BIGINT WHEN l_returnflag = 'R' THEN 1 END AS deleted_at FROM lineitem""")
def soft_delete_cascade(spark, sf_dir):
    children = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", F.lit(1).cast("long")).alias("deleted_at"))
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(None).cast("long").alias("deleted_at"))
    gone = children.where("l_orderkey % 10 = 0").select("l_orderkey")
    return merges.soft_delete(parents, children, gone, "l_orderkey", F.lit(99).cast("long"))[1]


@query("""SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'AUTOMOBILE' ELSE c_mktsegment END AS mode, cast(1 + CASE WHEN c_custkey % 3 = 0 AND c_mktsegment <> 'AUTOMOBILE' THEN 1 ELSE 0 END AS INTEGER) AS version FROM customer""")
def profile_version_bump(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("mode"), F.lit(1).alias("version"))
    return merges.bump_version(users, users.where("user_id % 3 = 0").select("user_id", F.lit("AUTOMOBILE").alias("mode")), "user_id", "mode", "version")


@query(f"""WITH {EVENT_ITEMS}, i AS (SELECT * FROM items),
    om AS (SELECT item_id, user_id AS story, feed_id AS dev FROM i WHERE date_ms < {START + 8 * DAY}), nm AS (SELECT item_id, user_id AS story, CASE WHEN item_id % 50 = 0 THEN 'moved' ELSE feed_id END AS dev FROM i WHERE date_ms >= {START + 5 * DAY}),
    touched AS (SELECT n.story, n.dev, o.story AS o_story, o.dev AS o_dev FROM nm n LEFT JOIN om o USING (item_id) WHERE o.story IS NULL OR o.dev <> n.dev),
    t AS (SELECT DISTINCT story, dev FROM (SELECT story, dev FROM touched UNION ALL SELECT o_story, o_dev FROM touched WHERE o_story IS NOT NULL)),
    od AS (SELECT DISTINCT story, dev FROM om), nd AS (SELECT DISTINCT story, dev FROM nm),
    changed AS (SELECT DISTINCT story FROM (SELECT story FROM t UNION ALL (SELECT story FROM (SELECT * FROM nd EXCEPT SELECT * FROM od)))),
    os AS (SELECT DISTINCT story FROM om), al AS (SELECT DISTINCT story FROM (SELECT story FROM om UNION ALL SELECT story FROM nm))
    SELECT al.story, cast(CASE WHEN os.story IS NULL THEN 1 WHEN c.story IS NOT NULL THEN 2 ELSE 1 END AS INTEGER) AS version FROM al LEFT JOIN os USING (story) LEFT JOIN changed c USING (story)""")
def story_version_upsert(spark, sf_dir):
    i = event_items(spark, sf_dir).withColumn("story", F.col("user_id"))

    def parts(rows, dev):
        m = rows.select("story", dev.alias("dev"), F.col("item_id").alias("item"), F.lit("p").alias("fingerprint"), "date_ms")
        d = m.groupBy("story", "dev").agg(F.min("date_ms").alias("occurred_at")).select("story", "dev", F.lit("k").alias("kind"), F.lit("t").alias("title"), "occurred_at")
        s = m.select("story").distinct().select("story", F.lit("t").alias("title"), F.lit("l").alias("labels"))
        return s, d, m.drop("date_ms")

    s, d, m = parts(i.where(F.col("date_ms") < START + 8 * DAY), F.col("feed_id"))
    new = parts(i.where(F.col("date_ms") >= START + 5 * DAY), F.when(F.col("item_id") % 50 == 0, "moved").otherwise(F.col("feed_id")))
    out, _, _ = merges.story_versions(s.withColumn("version", F.lit(1)), d.withColumn("version", F.lit(1)), m, *new)
    return out.select("story", "version")
